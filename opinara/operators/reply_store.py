"""Replies that have been paid for, kept between jobs.

The store is a table bucketed and sorted by a digest of the prompt. A job anti-joins its prompts
with it, asks for the rest, appends what was answered, and reads all its replies from the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.operators.ranking import unused
from opinara.operators.themes import PARALLEL_CALLS, written_replies
from opinara.session import pin


class ReplyStore:
    """A table of (digest, raw) below `path`; a later session opens it by the same path and buckets.

    Jobs that append at the same time may pay for a prompt twice; the smallest reply is then read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.path = path.rstrip("/")
        self.name = "reply_store_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest BINARY, raw STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def known(self) -> DataFrame:
        """One reply per digest. Buckets are read where they lie, so nothing is shuffled."""
        return self.spark.table(self.name).groupBy("digest").agg(F.min("raw").alias("raw"))

    def replies(
        self, prompts: DataFrame, ask: Callable[[str], str], parallel_calls: int = PARALLEL_CALLS, attempt: int = 0
    ) -> DataFrame:
        """`prompts` with `raw` and `error`, as `written_replies` gives them, paying only for new ones.

        Equal prompts are asked once. A further `attempt` is a question of its own, as the answer to
        the first one was no use. A call that failed is not stored and is asked again next time; a
        null prompt is one like others. An empty table makes no call.
        """
        digest, text = unused(prompts, "digest"), F.coalesce("prompt", F.lit(""))
        keyed = prompts.withColumn(digest, F.unhex(F.sha2(F.concat(F.lit(f"{attempt}:"), text), 256)))
        wanted = keyed.select(F.col(digest).alias("digest"), "prompt").dropDuplicates(["digest"])
        new = pin(wanted.join(self.known(), "digest", "left_anti"), "new-prompts")
        failed = None
        if not new.isEmpty():
            asked = written_replies(new, ask, parallel_calls)
            asked.filter("error IS NULL").select("digest", "raw").write.insertInto(self.name)
            self.spark.catalog.refreshTable(self.name)
            failed = asked.filter("error IS NOT NULL").select(F.col("digest").alias(digest), "error")
        found = keyed.join(self.known().withColumnRenamed("digest", digest), digest, "left")
        if failed is None:
            found = found.withColumn("error", F.lit(None).cast("string"))
        else:
            found = found.join(failed, digest, "left")
        return pin(found.select(*prompts.columns, "raw", "error"), "stored-replies")
