"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from opinara.llm import (
    byte_pairs, exact_duplicates, hard_negatives, licenses, merkle, near_duplicates, neighbours, packing,
    personal_data, quality, simhash, token_counts, token_files,
)
from opinara.llm.common import table
from opinara.session import new_path

WORD_VOCABULARY = "word_bpe_49k.json"
END_ID = 2

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_token_files")
def op1(spark, sf):
    path = new_path(spark, "token-files")
    vocabulary = public_tokenizers.path(WORD_VOCABULARY)
    token_files.write_token_files(table(spark, sf, "documents"), path, vocabulary, END_ID)
    return token_files.read_token_files(spark, path)


@query("op2_neighbours")
def op2(spark, sf):
    return neighbours.neighbours(table(spark, sf, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


@query("op3_near_dedup")
def op3(spark, sf):
    return near_duplicates.near_duplicates(table(spark, sf, "documents"))


@query("op4_quality")
def op4(spark, sf):
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_packing")
def op5(spark, sf):
    vocabulary = public_tokenizers.path(WORD_VOCABULARY)
    return packing.pack_texts(table(spark, sf, "documents"), vocabulary, END_ID).drop("ids")


@query("op6_license_scan", licenses.LICENSES_SQL)
def op6(spark, sf):
    return licenses.licenses(table(spark, sf, "documents"))


@query("op7_token_counts")
def op7(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, sf, "documents"), path, limit=4096)


@query("op8_byte_pairs")
def op8(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf, "documents")
    return byte_pairs.encode_and_decode(docs, path, public_tokenizers.PATTERN, at_blanks=True)


@query("op9_personal_data")
def op9(spark, sf):
    found = personal_data.personal_data(table(spark, sf, "documents"))

    def is_base(span):
        return span["kind"].isin(*personal_data.BASE_KINDS)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in personal_data.BASE_KINDS],
        F.sha2(personal_data.listed(F.filter("spans", is_base)), 256).alias("base_sha256"),
        personal_data.listed(F.col("spans")).alias("spans"),
    )


@query("op10_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM d),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
 count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""")
def op10(spark, sf):
    return exact_duplicates.exact_duplicates(table(spark, sf, "documents"))


@query("op11_simhash")
def op11(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op12_manifest", merkle.manifest_sql(
    "documents", ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", "text",
    f"translate(text, '{_UPPER}', '{_LOWER}')", 5,
))
def op12(spark, sf):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(tampered, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    docs = table(spark, sf, "documents")
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"text": text})


@query("op13_hard_negatives")
def op13(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label)
