"""The manifest against a tree built in plain Python, and against SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from opinara.llm import merkle
from tests.llm.conftest import as_documents

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(digests):
    """Top of a tree, and per leaf its steps (left, right)."""
    steps = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for i, place in enumerate(at):
            begin = place // 16 * 16
            steps[i].append(("".join(digests[begin:place]), "".join(digests[place + 1:begin + 16])))
            at[i] = place // 16
        digests = [H(*digests[i:i + 16]) for i in range(0, len(digests), 16)]
    return digests[0], steps


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append((row, plain_leaf(row, row["text"])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0]["doc_id"] is not None, r[0]["doc_id"] or 0, r[1]))
        trees[name] = plain_tree([d for _, d in groups[name]])
    root, upper = plain_tree([trees[name][0] for name in names])
    out = []
    for name, above in zip(names, upper):
        for (row, own), steps in zip(groups[name], trees[name][1]):
            text, steps = row["text"], steps + above
            if row["doc_id"] is not None and text is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = plain_leaf(row, text)
            for left, right in steps:
                fold = H(left, fold, right)
            proof = H(*[x for step in steps for x in step])
            out.append((row["doc_id"], own, trees[name][0], root, proof, fold, fold == root))
    return sorted(out, key=str)


def found(df):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(touched, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    return sorted(map(tuple, merkle.manifest(df, COLUMNS, {"text": text}).collect()), key=str)


def with_sources(spark, odd, n):
    """`n` groups, the first of a third of all rows, one of them null."""
    own = F.when(F.col("doc_id") % 3 == 0, F.lit("big")).otherwise(F.concat(F.lit("é"), F.col("doc_id") % n))
    return odd.withColumn("source", F.when(F.col("doc_id") % 7 != 1, own))


@pytest.mark.parametrize("n", [1, 5, 400])
def test_odd_rows(spark, odd, n):
    docs = with_sources(spark, odd, n)
    rows = [r.asDict() for r in docs.select(*COLUMNS).collect()]
    got = found(docs)
    assert got == plain(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300])
def test_sizes(spark, n):
    docs = as_documents(spark, [(i, f"Text {i}", "en") for i in range(n)])
    assert found(docs) == plain([r.asDict() for r in docs.select(*COLUMNS).collect()])


def test_no_rows(spark, none):
    assert found(none) == []


def test_unchanged_is_verified(spark, odd):
    rows = merkle.manifest(odd, COLUMNS).collect()
    assert all(r.verified and r.folded_root == r.root for r in rows) and len(rows) == odd.count()
