"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is first reduced to one row per
digest, then meets the index in a sort-merge anti-join that shuffles only the batch, and what
is new is appended. Built-in functions only.
"""

from __future__ import annotations

import hashlib
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinara.llm.common import join_groups, whole_text
from opinara.session import new_path, pin


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without blanks and the characters 9 to 13, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256))


def _normal(path: str) -> str:
    """A path in one form: with its scheme, without empty, `.` and `..` steps."""
    scheme, colon, rest = path.partition(":/")
    if not colon:
        scheme, rest = "file", path
    host = ""
    if colon and rest.startswith("/") and not rest.startswith("//"):
        host, _, rest = rest[1:].partition("/")
    return f"{scheme}://{host}{posixpath.normpath('/' + rest.lstrip('/'))}"


class DigestIndex:
    """Digests seen so far with the row that stays, in a bucketed and sorted table.

    `path` keeps the files; a later session opens them again by the same path and number of
    buckets. The table is named by a hash of the whole path, and one of that name that lies
    elsewhere is refused, so that no two indexes share a table. Choose `buckets` so that a
    bucket's digests fit a task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        path = _normal(path)
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest BINARY, keep_id BIGINT, batch STRING)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
            f" LOCATION '{path}'"
        )
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED `{self.name}`").filter("col_name = 'Location'").collect()
        if _normal(rows[0]["data_type"]) != path:
            raise ValueError(f"the table {self.name} lies at {rows[0]['data_type']}, not at {path}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame, batch: str) -> DataFrame:
        """Append the digests that are new; return `groups` with `keep_id` and `first_batch`.

        Running a batch again after a failure appends nothing twice, as the anti-join sees
        what has been committed.
        """
        known = self.table().select("digest")
        new = groups.hint("merge").join(known, "digest", "left_anti")
        new.select("digest", F.col("best.id").alias("keep_id"), F.lit(batch).alias("batch")).write.insertInto(
            self.name
        )
        self.spark.catalog.refreshTable(self.name)
        held = self.table().withColumnRenamed("batch", "first_batch")
        return groups.hint("merge").join(held, "digest")


def digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: `id`, `row` (its own number), `digest`, `characters`; a null text is empty."""
    text = whole_text(text_column)
    return df.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        text_digest(text).alias("digest"),
        F.length(text).cast("bigint").alias("characters"),
    )


def best_rows(rows: DataFrame) -> DataFrame:
    """Per digest: `best` (most characters, then smallest id, then first row) and `group_size`.

    Partial aggregation before the shuffle reduces copies, however many there are.
    """
    order = F.struct((-F.col("characters")).alias("less"), "id", "row")
    return rows.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))


def exact_duplicates(
    df: DataFrame,
    index: DigestIndex | None = None,
    batch: str = "1",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: `doc_id`, `keep_id`, `group_size` (in this batch), `kept`, `text_sha256`.

    Texts are equal if they are without blanks and the characters 9 to 13; null is empty and
    empty texts are equal to each other. The longest original stays, then the smallest id
    (null first); of rows alike in all that, exactly one. Against an index with earlier
    batches, the row of the first batch stays. Without an index, a new one is made. An empty table
    gives no rows; a very long text is hashed where it is read. Other columns are not read.
    """
    spark = df.sparkSession
    index = index or DigestIndex(spark, new_path(spark, "digest-index"))
    rows = pin(digests(df, id_column, text_column), "digests")
    groups = pin(best_rows(rows), "digest-groups")
    found = pin(index.add(groups, batch), "digest-found")
    result = join_groups(rows, found, "digest", "group_size", rows.count())
    return result.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("row") == F.col("best.row")) & (F.col("first_batch") == batch)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one_each(
    df: DataFrame,
    index: DigestIndex | None = None,
    batch: str = "1",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of `df`, all columns, that `exact_duplicates` keeps.

    Rows are found again by digest, length and id. Only where several rows of the best kind
    are alike in all three is one of them picked by a shuffle of their own. Columns of `df` may
    have any names; an empty table gives no rows.
    """
    spark = df.sparkSession
    index = index or DigestIndex(spark, new_path(spark, "digest-index"))
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    name = dict(zip(df.columns, plain.columns))
    alike = digests(plain, name[id_column], name[text_column]).groupBy("digest", "id", "characters").agg(
        F.count(F.lit(1)).alias("n")
    )
    order = F.struct((-F.col("characters")).alias("less"), "id", "n")
    groups = pin(alike.groupBy("digest").agg(F.min(order).alias("best")), "digest-groups")
    found = index.add(groups, batch).filter(F.col("first_batch") == batch)
    kept = pin(
        found.select(
            F.col("digest").alias("kept_digest"),
            F.col("best.id").alias("kept_id"),
            (-F.col("best.less")).alias("kept_characters"),
            F.col("best.n").alias("kept_n"),
        ),
        "digest-kept",
    )
    text = whole_text(name[text_column])
    rows = plain.withColumns({
        "own_digest": text_digest(text),
        "own_id": F.col(name[id_column]).cast("bigint"),
        "own_characters": F.length(text).cast("bigint"),
    })
    same = (
        (F.col("own_digest") == F.col("kept_digest"))
        & F.col("own_id").eqNullSafe(F.col("kept_id"))
        & (F.col("own_characters") == F.col("kept_characters"))
    )
    out = rows.join(kept.filter("kept_n = 1"), same, "left_semi")
    several = kept.filter("kept_n > 1")
    if not several.isEmpty():
        own = ["own_digest", "own_id", "own_characters"]
        out = out.unionByName(rows.join(several, same, "left_semi").dropDuplicates(own))
    return out.select(*plain.columns).toDF(*df.columns)
