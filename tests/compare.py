"""Compare registered queries with their SQL in DuckDB: python -m tests.compare [sf_dir] [names]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, bool) or value is None:
        return str(value)
    return value if isinstance(value, int) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: [str(v) for v in r]
    )


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns, types of value and rows."""
    got = _rows(df.columns, df.collect())
    result = con.sql(sql)
    want = _rows(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} != {sorted(result.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} in SQL"
    for g, w in zip(got, want):
        if g != w:
            return f"{str(g)[:600]} != {str(w)[:600]}"
    return None if got else "no rows"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            if name in oracles:
                found = difference(df, con, oracles[name])
            else:
                found = None if df.count() else "no rows"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        state = "ok" if found is None else "BAD " + found
        print(f"{name:36s} {time.time() - start:6.2f}s {'' if name in oracles else 'rows '}{state}", flush=True)
    print(f"{bad} bad of {len(queries)}, {len(oracles)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(main())
