"""Training-data pipeline: documents in, packed sequences out.

Each stage applies one corpus operator to all that its predecessor kept. All but the last
return the columns of the documents they get.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm import exact_duplicates, near_duplicates, packing, personal_data, quality
from opinara.session import new_path, remove

WORD_VOCABULARY = "word_bpe_49k.json"
END_ID = 2


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group of equal texts."""
    return exact_duplicates.keep_one_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    return near_duplicates.keep_one_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in brackets in place of each piece of personal data."""
    redacted = personal_data.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_texts(docs, public_tokenizers.path(WORD_VOCABULARY), END_ID)


STAGES = [
    ("quality classifier", drop_bad),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("personal data", redact),
    ("packing", pack),
]

# SQL states neither the language model nor the signatures; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    before = None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < last:
            path = new_path(spark, "stage-" + name.replace(" ", "-"))
            docs.write.parquet(path)
            if before:
                remove(before)
            docs, before = spark.read.parquet(path), path
    return docs
