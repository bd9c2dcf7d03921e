"""The inverted multi-index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n int"


def brute(rows, k):
    usable = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if v and None not in v}
    usable = {i: v for i, v in usable.items() if np.isfinite(v).all() and v.any() and i is not None}
    ids, matrix = np.array(list(usable)), np.array(list(usable.values()))
    out = {}
    for q, v in usable.items():
        if q % 20 == 0:
            scores = (matrix * v).sum(1)
            order = [x for x in np.lexsort((ids, -scores)) if ids[x] != q][:k]
            out[q] = [(r + 1, int(ids[x]), float(scores[x])) for r, x in enumerate(order)]
    return out


def search(spark, rows, k=20, **settings):
    given = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    found = neighbours.neighbours(given, F.pmod("vec_id", F.lit(20)) == 0, k, neighbours.Settings(**settings))
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]
    rows += [(500, None), (520, [0.0] * 8), (540, [float("nan")] + [1.0] * 7), (560, [None] + [1.0] * 7),
             (580, [float("inf")] * 8), (600, []), (None, rows[3][1]), (620, [-0.0] * 7 + [2.0]), (621, [0.0] * 7 + [2.0])]
    return rows


def test_all_gathered_is_exact(spark, odd_vectors):
    got = search(spark, odd_vectors, centroids=8, trials=500, recall=1.0, shard=16, visitors=5)
    assert got == brute(odd_vectors, 20)


def test_few_vectors(spark):
    rows = [(20 * i, [1.0 * i + 1, 2.0, 0.0]) for i in range(3)]
    assert search(spark, rows) == brute(rows, 20)
    assert search(spark, rows[:1]) == {}
    assert search(spark, []) == {}


def test_other_lengths_take_no_part(spark):
    rows = [(20 * i, [1.0 * i + 1, 2.0]) for i in range(4)] + [(500, [1.0, 2.0, 3.0])]
    assert search(spark, rows) == brute(rows[:4], 20)


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    index = neighbours.MultiIndex(6, rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    index.place(rng.integers(0, 3, 35), 4)
    query = rng.normal(size=6)
    sums = ((index.first @ query[:3])[:, None] + (index.second @ query[3:])[None, :]).ravel()
    want = [c for c in np.argsort(-sums, kind="stable").tolist() if index.counts[c]]
    assert index.walk(query, 10**9) == want
    assert sum(index.counts[c] for c in index.walk(query, 6)) >= 6


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    found = neighbours.neighbours(table, F.pmod("vec_id", F.lit(20)) == 0).select("query_id", "vec_id").collect()
    want = {(q, v) for q, own in brute(rows, 20).items() for _, v, _ in own}
    assert len(want & {tuple(r) for r in found}) >= 0.9 * len(want)
