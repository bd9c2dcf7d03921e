"""Writing of scored reviews and report tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_scored(df: DataFrame, path: str, partition_by: str = "predicted_sentiment") -> None:
    """Scored reviews as parquet, in one folder per predicted class."""
    df.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def write_report(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One parquet table per report section, under the section's name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
