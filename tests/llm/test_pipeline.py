"""The pipeline and the registered queries of the corpus operators."""

import shutil

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from opinara.llm import queries
from opinara.session import new_path
from tests.compare import connect, difference
from tests.llm.conftest import as_documents


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) is None


def test_pipeline_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := new_path(spark, "test-stage"))
        docs = spark.read.parquet(path)
        if number < 4:
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1] and counts[4] == counts[3]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.agg({"length": "sum"}).first() == docs.agg({"length": "sum"}).first()
    assert set(names) <= set(whole.columns)


def test_odd_rows_and_no_rows(spark, odd, none, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/labels.parquet", tmp_path)
    for number, docs in enumerate((odd, none, as_documents(spark, [(1, None, None)]))):
        for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert place == 4 or out.columns == docs.columns
            out.write.parquet(path := new_path(spark, f"odd-stage-{number}"))
            docs = spark.read.parquet(path)
