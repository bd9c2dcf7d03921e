"""Session helpers: where intermediate tables go and how a frame is pinned there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    """A folder of this process for sessions that name none, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="opinara-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir` of the session.

    Only where that is unset and Spark runs in one process, as in tests, is it a folder of
    this process. On a cluster a missing setting is an error, since no executor could read
    another machine's local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


def run_dir(spark: SparkSession) -> str:
    """Folder of all intermediate tables of this application; see `clean_up`."""
    return f"{shared_dir(spark)}/opinara-{spark.conf.get('spark.app.id', 'run')}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[FileSystem, str]:
    """The file system of a folder of intermediate data, and the path there."""
    return FileSystem.from_uri(uri) if ":/" in uri else FileSystem.from_uri(f"file://{uri}")


def remove(uri: str) -> None:
    """Delete a folder of intermediate data, if it is there."""
    fs, path = file_system(uri)
    if fs.get_file_info(path).type == FileType.Directory:
        fs.delete_dir(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are stored."""
    remove(run_dir(spark))


def pin(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as parquet and read it back.

    Cuts the lineage in storage that survives lost executors, so every later read sees the
    same rows: needed after steps that may differ when run twice (partition positions,
    model calls) and cheaper than recomputing a frame that several jobs read.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A few rows made on the driver, given by column.

    Through Arrow they become part of the plan: no Python task makes them, and Spark knows
    their size when it chooses a join.
    """
    return spark.createDataFrame(pa.table(columns))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly to `spark.opinara.spread` partitions before costly row work.

    Unset, rows stay as they are read, unshuffled. Meant for inputs of fewer files than cores,
    which Spark cannot split.
    """
    partitions = df.sparkSession.conf.get("spark.opinara.spread", None)
    return df.repartition(int(partitions)) if partitions else df
