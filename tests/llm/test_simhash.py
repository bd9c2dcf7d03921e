"""Fingerprints and vantage-point trees against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opinara.llm import simhash
from tests.llm.conftest import as_documents, prose


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    """(id, fingerprint, smallest id reachable) of each row, by comparing all pairs."""
    points = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group):
        known = [x for x in (least.get(g), doc_id) if x is not None]
        least[g] = min(known) if known else None
    out = [(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, points, group)]
    return sorted(out, key=str)


def found(df, settings=simhash.Settings()):
    rows = simhash.near_duplicates(df, settings=settings).select("doc_id", "fingerprint", "component_id").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("settings", [simhash.Settings(), simhash.Settings(shard=4, leaf=2, sample=20)])
def test_odd_rows(spark, odd, rows, settings):
    assert found(odd, settings) == plain([(i, t) for i, t, _ in rows])


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, simhash.Settings(shard=16, leaf=4)) == plain(rows)


def test_no_rows(spark, none):
    assert found(none) == []


def test_long_text_and_native_hash(spark):
    text = prose(1, 30_000) + " É É"
    docs = as_documents(spark, [(1, text, "en"), (2, text.upper().replace("É", "É"), "en")])
    assert len({r[1] for r in found(docs)}) == 1
    own = spark.createDataFrame([("a b É",)], "t string").select(F.xxhash64("t")).first()[0]
    assert own == np.uint64(xxhash.xxh64_intdigest("a b É".encode(), 42)).view(np.int64)


def hard_points(seed, n):
    """Points of which many lie 1 to 4 bits from each other, and some far."""
    rng = np.random.default_rng(seed)
    points = list(rng.integers(0, 1 << 63, n // 4, dtype=np.uint64))
    while len(points) < n:
        flips = rng.choice(64, rng.integers(1, 5), replace=False)
        points.append(points[rng.integers(len(points))] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)))
    return np.unique(np.array(points))


@pytest.mark.parametrize("seed", range(4))
def test_walk_meets_every_pair(seed):
    points = hard_points(seed, 600)
    near = np.bitwise_count(points[:, None] ^ points) <= simhash.DISTANCE
    for tree in (simhash.VantageTree(points, 8), simhash.VantageTree(points[::9], 1, 7), simhash.VantageTree(points[:0], 1)):
        met = np.eye(len(points), dtype=bool)
        homes = np.zeros(len(points), int)
        for _, own, others in tree.walk(points, np.ones(len(points), bool), simhash.DISTANCE):
            homes[own] += 1
            met[np.ix_(own, np.r_[own, others])] = True
        assert (homes == 1).all() and (met | met.T)[near].all()


@pytest.mark.parametrize("seed", range(3))
def test_shard_links(seed):
    points = hard_points(seed, 500)
    home, guests = points[::2], points[1::2]
    group = {int(p): int(p) for p in points}

    def top(p):
        while group[p] != p:
            p = group[p]
        return p

    settings = simhash.Settings(leaf=16)
    n = 0
    for a, b in simhash.shard_links(home, iter([guests[:100], guests[100:]]), settings):
        assert (np.bitwise_count(a ^ b) <= simhash.DISTANCE).all()
        n += len(a)
        for x, y in zip(a.tolist(), b.tolist()):
            group[top(x)] = top(y)
    assert n <= 2 * len(points)
    near = np.bitwise_count(home[:, None] ^ points) <= simhash.DISTANCE
    for i, j in zip(*np.nonzero(near)):
        assert top(int(home[i])) == top(int(points[j]))


def test_unsplittable_points():
    assert simhash.VantageTree(np.zeros(5, np.uint64), 1).leaves == 1
    one_bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    tree = simhash.VantageTree(one_bit, 4)
    assert sum(len(own) for _, own, _ in tree.walk(one_bit, np.ones(64, bool), 3)) == 64
