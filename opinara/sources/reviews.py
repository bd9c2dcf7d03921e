"""Reading of review and training files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.sources.csv_ranges import RANGE_BYTES, Ranges
from opinara.vocab import NA_TOKENS

# Fixed value: the training file taken first.
TRAINING_FILE = "training_testing_data.csv"


def marked_missing(raw: DataFrame) -> DataFrame:
    """The same columns, null where a cell holds a missing mark."""
    return raw.select(
        *[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    )


def _csv(spark: SparkSession, path, multi_line: bool, **options) -> DataFrame:
    read = spark.read.options(header=True, multiLine=multi_line, escape='"', **options)
    return read.csv(path)


def _by_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame | None:
    """Records cut out of ranges of the files, parsed by Spark; None if that cannot be."""
    ranges = Ranges(spark, path, range_bytes)
    if not (ranges.tasks and ranges.possible):
        return None
    parts = []
    # One row per different header.
    for head in ranges.heads().orderBy("path").collect():
        names = _csv(spark, head["path"], True).columns
        schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
        row = F.from_csv("record", schema, {"escape": '"'})
        parts.append(marked_missing(ranges.records(head["head"]).select(row.alias("row")).select("row.*")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def read_reviews(
    spark: SparkSession, path: str, multi_line: bool = True, split_bytes: int | None = RANGE_BYTES
) -> DataFrame:
    """Reviews from CSV with a header; every column is a string, missing marks are null.

    Columns go by the header of each file: files of one header are read together, and columns
    that a file lacks are null. With `multi_line`, cells may hold quoted line breaks; large files
    are still read by many tasks, in ranges of `split_bytes`. Packed files, files in a store that
    only Spark reaches, and all files if `split_bytes` is None are read by one task each; convert
    such files once with `to_table`, and read the table from then on. Files whose lines end
    in a carriage return alone need `split_bytes=None`, too.
    """
    if multi_line and split_bytes is not None:
        found = _by_ranges(spark, path, split_bytes)
        if found is not None:
            return found
    # The listing alone, without content.
    if spark.read.format("binaryFile").load(path).select("path").limit(2).count() < 2:
        return marked_missing(_csv(spark, path, multi_line))
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    # One header per file, found in a split pass over the text; files are few next to rows.
    heads = lines.filter("file_block_start = 0").withColumn("at", F.monotonically_increasing_id())
    heads = heads.groupBy("file_path").agg(F.min_by("value", "at").alias("head"))
    alike = heads.groupBy("head").agg(F.sort_array(F.collect_list("file_path")).alias("files"))
    groups = alike.orderBy("head").collect()
    if len(groups) < 2:
        return marked_missing(_csv(spark, path, multi_line))
    parts = [marked_missing(_csv(spark, group["files"], multi_line)) for group in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_table(spark: SparkSession, csv_path: str, table_path: str, multi_line: bool = True) -> DataFrame:
    """Convert CSV files to a parquet table once, so that all later reads are split."""
    read_reviews(spark, csv_path, multi_line).write.mode("overwrite").parquet(table_path)
    return read_review_table(spark, table_path)


def read_review_table(spark: SparkSession, path: str) -> DataFrame:
    """Reviews that are already a parquet table."""
    return spark.read.parquet(path)


def resolve_training_file(spark: SparkSession, folder: str) -> str:
    """The training CSV of a folder: the fixed name, else the first by name.

    A CSV may be one file or a folder of part files, as Spark writes it.
    """
    # Only the listing is read, not the files' content.
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    inside = F.element_at(F.split("path", re.escape("/" + folder.strip("/").split("/")[-1] + "/"), 2), -1)
    name = F.split(inside, "/")[0]
    names = listing.select(name.alias("name")).filter(F.endswith("name", F.lit(".csv")))
    fixed = F.max(F.when(F.col("name") == TRAINING_FILE, F.col("name")))
    found = names.agg(F.coalesce(fixed, F.min("name"))).first()[0]
    if found is None:
        raise FileNotFoundError(f"no training CSV in {folder}")
    return f"{folder.rstrip('/')}/{found}"


def read_training(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    return read_reviews(spark, resolve_training_file(spark, folder), multi_line)
