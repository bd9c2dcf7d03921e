"""Strassen products, heaps and mined negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, row int, task int, score string"


def plain(rows):
    """(anchor, positive, rank, negative, two scores) of every anchor row."""
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = (label + 1) % 10 if vec_id % 7 == 0 else label
        usable.append((vec_id, [math.floor(256 * x) for x in vector], own))
    out = []
    for i, (anchor, vector, label) in enumerate(usable):
        if anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(vector, v)), k, own) for j, (k, v, own) in enumerate(usable) if j != i]
        positives = sorted((s, k) for s, k, own in scored if own == label)[:5]
        for p, positive in positives:
            near = sorted((s, k) for s, k, own in scored if own != label and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            out += [(anchor, positive, r + 1, k, -p, -s) for r, (s, k) in enumerate(near)]
    return sorted(out)


def found(df, **settings):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard.hard_negatives(df, F.col("vec_id") % 100 == 0, label, hard.Settings(**settings))
    return sorted(map(tuple, got.collect()))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 3, 4, "y") for i, v, l in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + 0.6).round(2).tolist(), int(i % 4)) for i in range(420)]
    rows += [(i, rows[9][1], 1) for i in range(420, 520)]
    rows += [(600, None, 1), (700, [1.0, None], 1), (800, [float("nan")] * 6, 1), (900, [1.0] * 6, None),
             (1000, [float("inf")] * 6, 2), (1100, [], 2), (1200, [0.0] * 6, 3), (1300, [1.0, 2.0], 3),
             (None, [1.0] * 6, 1), rows[100], rows[100], rows[33], (1400, [-1.0] * 6, 0)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"block": 2, "stripe": 50}])
def test_odd_vectors(spark, odd_vectors, settings):
    assert found(frame(spark, odd_vectors), **settings) == plain(odd_vectors)


def test_few_rows(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(100, [1.0], 1)])) == []
    assert found(frame(spark, [(100, [1.0], 1), (101, [1.0], 1)])) == []
    rows = [(100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2), (103, [0.91], 2)]
    assert found(frame(spark, rows)) == plain(rows)
    assert {r[3] for r in plain(rows)} == {102}


def test_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.select("vec_id", "embedding", "label").collect()]
    got = found(table)
    assert got == plain(rows) and got


def test_too_long_vectors_take_no_part(spark):
    rows = [(100, [1.0], 1), (101, [1.0], 1), (102, [0.8], 2)]
    assert found(frame(spark, rows + [(103, [1e30], 1), (104, [3e9], 2)])) == plain(rows)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (130, 97, 65), (256, 2048, 64), (40, 33, 0), (0, 5, 64)])
def test_strassen(shape):
    m, n, k = shape
    rng = np.random.default_rng(m + n + k)
    a, b = rng.integers(-1 << 27, 1 << 27, (m, k)), rng.integers(-1 << 27, 1 << 27, (n, k))
    assert (hard.strassen(a, b) == a @ b.T).all()


def test_strassen_recurses():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-9, 9, (128, 64)), rng.integers(-9, 9, (96, 64))
    assert (hard._strassen(a, b, 3) == a @ b.T).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(-5, 5, (3, 90)), np.arange(90)
    want = [sorted(zip((-s).tolist(), ids.tolist()))[:4] for s in scores]
    for parts in ([range(90)], [range(40, 90), range(2), range(2, 40)], [range(i, 90, 7) for i in range(7)]):
        heaps = hard.Heaps(3, 4)
        for part in parts:
            at = np.array(part)
            heaps.offer(np.arange(3), scores[:, at], ids[at], np.ones((3, len(at)), bool))
        assert [list(zip((-s).tolist(), i.tolist())) for s, i in zip(heaps.scores, heaps.ids)] == want


def test_windows():
    scores = np.array([0, 1, 7, 10, -3, 101, 1 << 60])
    low, high = hard.windows(scores, 30, 90)
    for s, a, b in zip(scores.tolist(), low.tolist(), high.tolist()):
        assert a == -(-30 * s // 100) and b == 90 * s // 100
