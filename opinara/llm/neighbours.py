"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Both halves of a vector are quantised on their own, so a pair of centroids names a cell. A
query ranks the centroids of each half by inner product and walks the pairs in order of their
sum with a heap, until it has gathered enough entries; these are ranked again by the exact
product. How many are enough is measured on a sample of queries against all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from opinara.llm.common import in_parts, join_groups
from opinara.session import pin


@dataclass(frozen=True)
class Settings:
    """Parameters of the index.

    `centroids` per half, fitted on `sample` vectors; the number of entries that a query gathers
    is the least with which `recall` of the true neighbours of `trials` sampled queries are met.
    `shard` entries are ranked at a time, for `visitors` queries at a time. Equal vectors are one
    entry.
    """

    centroids: int = 128
    sample: int = 20_000
    rounds: int = 10
    trials: int = 128
    recall: float = 0.96
    shard: int = 512
    visitors: int = 4096


def vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows (vec_id, key, vector): usable vectors as bytes of doubles; equal ones have one key.

    Null and zero vectors and those with null or non-finite components are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            ids, keys, data = [], [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec_id is None or not vector or None in vector:
                    continue
                own = np.array(vector, np.float64) + 0.0
                if np.isfinite(own).all() and own.any():
                    ids.append(vec_id)
                    data.append(own.tobytes())
                    keys.append(xxhash.xxh3_128_digest(data[-1]))
            yield pa.RecordBatch.from_pydict({
                "vec_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary()),
                "vector": pa.array(data, pa.binary()),
            })

    rows = df.select(F.col(id_column).cast("bigint"), F.col(vector_column).cast("array<double>"))
    return rows.mapInArrow(run, "vec_id bigint, key binary, vector binary")


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors (key, vector, ids): of equal ones the `keep` smallest ids.

    No more of them can be among the neighbours, as ties go to the smaller id. Each task
    reduces its own copies first, so a vector of any number of copies is no hot key.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[bytes, list[int]]] = {}

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "key": pa.array(list(held), pa.binary()),
                "vector": pa.array([v for v, _ in held.values()], pa.binary()),
                "ids": pa.array([sorted(i)[:keep] for _, i in held.values()], pa.list_(pa.int64())),
            })

        for batch in batches:
            for vec_id, key, vector in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                ids = held.setdefault(key, (vector, []))[1]
                ids.append(vec_id)
                if len(ids) > 64 * keep:
                    ids[:] = sorted(ids)[:keep]
            if len(held) > 1 << 15:
                yield made()
                held.clear()
        if held:
            yield made()

    part = rows.mapInArrow(run, "key binary, vector binary, ids array<bigint>")
    ids = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep)
    return part.groupBy("key").agg(F.first("vector").alias("vector"), ids.alias("ids"))


def _matrix(data: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(-1, size)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * points @ centroids.T).argmin(1)


def fit_centroids(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """K-means from evenly spaced rows; a centroid without points stays."""
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(points, centroids)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centroids


class MultiIndex:
    """Centroids, entries per cell, and how cells lie in shards. Bounded by `centroids` squared."""

    def __init__(self, size: int, first: np.ndarray, second: np.ndarray):
        self.size, self.first, self.second = size, first, second
        self.counts = np.zeros(len(first) * len(second), np.int64)

    def cells(self, points: np.ndarray) -> np.ndarray:
        half = self.size // 2
        return _nearest(points[:, :half], self.first) * len(self.second) + _nearest(points[:, half:], self.second)

    def place(self, counts: np.ndarray, shard: int) -> None:
        """Lay cells side by side in shards; a cell above the size of a shard gets several."""
        self.counts = counts
        self.pieces = np.maximum(1, -(-counts // shard))
        self.start = np.zeros(len(counts), np.int64)
        now, filled = 0, 0
        for cell in np.flatnonzero(counts).tolist():
            n = int(counts[cell])
            if filled and filled + n > shard:
                now, filled = now + 1, 0
            self.start[cell] = now
            if n > shard:
                now, filled = now + int(self.pieces[cell]), 0
            else:
                filled += n

    def walk(self, query: np.ndarray, enough: int) -> list[int]:
        """Cells that hold entries, by falling sum of both products, until `enough` are gathered.

        Pair (i, j) of the two rankings is reached from (i, j - 1), and (i, 0) from (i - 1, 0), so
        every pair enters the heap once and after all that come before it.
        """
        half = self.size // 2
        a, b = self.first @ query[:half], self.second @ query[half:]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = (-a[by_a]).tolist(), (-b[by_b]).tolist()
        cells = [(x * len(b)) for x in by_a.tolist()]
        by_b = by_b.tolist()
        heap, found, gathered = [(a[0] + b[0], 0, 0)], [], 0
        while heap and gathered < enough:
            _, i, j = heap[0]
            if j + 1 < len(b):
                heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            cell = cells[i] + by_b[j]
            if n := self.of_cell[cell]:
                found.append(cell)
                gathered += n
        return found

    @property
    def of_cell(self) -> list[int]:
        if not hasattr(self, "_of_cell"):
            self._of_cell = self.counts.tolist()
        return self._of_cell


def fit(rows: DataFrame, size: int, settings: Settings) -> MultiIndex:
    """Centroids from at most `sample` entries, those with the smallest hashes."""
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(settings.sample).select("vector").toArrow()
    points = _matrix(sample.column("vector").to_pylist(), size)
    k, half = min(settings.centroids, len(points)), size // 2
    return MultiIndex(
        size, fit_centroids(points[:, :half], k, settings.rounds), fit_centroids(points[:, half:], k, settings.rounds)
    )


def with_cells(rows: DataFrame, index: MultiIndex) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            if batch.num_rows:
                cells = index.cells(_matrix(batch.column(1).to_pylist(), index.size))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], ["key", "vector", "ids", "cell"])

    return rows.select("key", "vector", "ids").mapInArrow(run, "key binary, vector binary, ids array<bigint>, cell bigint")


def enough_entries(indexed: DataFrame, index: MultiIndex, k: int, settings: Settings) -> int:
    """Entries to gather, measured: sampled entries as queries, against all entries."""
    sample = indexed.orderBy(F.xxhash64(F.lit("trial"), "key"), "key").limit(settings.trials).select("key", "vector").toArrow()
    trials = sample.column("key").to_pylist()
    queries = _matrix(sample.column("vector").to_pylist(), index.size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {key: i for i, key in enumerate(trials)}
        for batch in in_parts(batches):
            if not batch.num_rows:
                continue
            scores = queries @ _matrix(batch.column(1).to_pylist(), index.size).T
            for at, key in enumerate(batch.column(0).to_pylist()):
                if key in number:
                    scores[number[key], at] = -np.inf
            n = min(k, batch.num_rows)
            best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_pydict({
                "trial": pa.array(np.repeat(np.arange(len(queries)), n), pa.int64()),
                "cell": pa.array(batch.column(2).to_numpy()[best].ravel(), pa.int64()),
                "score": pa.array(np.take_along_axis(scores, best, 1).ravel(), pa.float64()),
            })

    found = indexed.select("key", "vector", "cell").mapInArrow(run, "trial bigint, cell bigint, score double")
    by_score = Window.partitionBy("trial").orderBy(F.desc("score"))
    true = found.filter("score > double('-Infinity')").withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k)
    rows = true.select("trial", "cell").toArrow()
    half = index.size // 2
    needed = []
    for i in range(len(queries)):
        sums = ((index.first @ queries[i, :half])[:, None] + (index.second @ queries[i, half:])[None, :]).ravel()
        order = np.argsort(-sums, kind="stable")
        gathered = np.empty(len(order), np.int64)
        gathered[order] = np.cumsum(index.counts[order])
        cells = rows.column("cell").to_numpy()[rows.column("trial").to_numpy() == i]
        needed += gathered[cells].tolist()
    return int(np.quantile(needed, settings.recall, method="higher")) if needed else int(index.counts.sum())


def _visits(queries: DataFrame, index: MultiIndex, enough: int) -> DataFrame:
    """(key, vector, shard, cells): the shards that a query visits and its cells there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1 << 18):
            keys, vectors_, shards, cells = [], [], [], []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: dict[int, list[int]] = {}
                for cell in index.walk(np.frombuffer(vector, np.float64), enough):
                    first = int(index.start[cell])
                    for shard in range(first, first + int(index.pieces[cell])):
                        own.setdefault(shard, []).append(cell)
                keys += [key] * len(own)
                vectors_ += [vector] * len(own)
                shards += own.keys()
                cells += own.values()
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys, pa.binary()), "vector": pa.array(vectors_, pa.binary()),
                "shard": pa.array(shards, pa.int64()), "cells": pa.array(cells, pa.list_(pa.int64())),
            })

    return queries.select("key", "vector").mapInArrow(run, "key binary, vector binary, shard bigint, cells array<bigint>")


def _sharded(indexed: DataFrame, index: MultiIndex) -> DataFrame:
    """Entries with their shard; those of a cell in several shards are dealt by hash."""
    rows = indexed.withColumn("hash", F.xxhash64("key"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(3).to_numpy()
            shard = index.start[cells] + batch.column(4).to_numpy() % index.pieces[cells]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array(shard, pa.int64())],
                ["vector", "ids", "cell", "shard"],
            )

    return rows.mapInArrow(run, "vector binary, ids array<bigint>, cell bigint, shard bigint")


def best_of(ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[list[int], list[float]]:
    order = np.lexsort((ids, -scores))[:keep]
    return ids[order].tolist(), scores[order].tolist()


def _rank(size: int, keep: int):
    """Ranks the entries of a shard for each of its visitors."""

    def run(shard: pa.Table, visitors: pa.Table) -> pa.Table:
        out = {"key": [], "ids": [], "scores": []}
        if shard.num_rows and visitors.num_rows:
            held = _matrix(shard.column("vector").to_pylist(), size)
            cells = shard.column("cell").to_numpy()
            all_ids = [np.array(x, np.int64) for x in shard.column("ids").to_pylist()]
            for start in range(0, visitors.num_rows, 256):
                part = visitors.slice(start, 256)
                asked = _matrix(part.column("vector").to_pylist(), size)
                rough = asked @ held.T
                for i, (key, own) in enumerate(zip(part.column("key").to_pylist(), part.column("cells").to_pylist())):
                    at = np.flatnonzero(np.isin(cells, own))
                    if len(at) > keep:
                        least = np.partition(rough[i, at], len(at) - keep)[len(at) - keep]
                        at = at[rough[i, at] >= least - 1e-9 * max(1.0, abs(least))]
                    # Sums of one row are made in one order, so equal vectors have equal scores.
                    exact = (held[at] * asked[i]).sum(1)
                    ids = np.concatenate([all_ids[x] for x in at]) if len(at) else np.zeros(0, np.int64)
                    scores = np.repeat(exact, [len(all_ids[x]) for x in at])
                    found, values = best_of(ids, scores, keep)
                    out["key"].append(key)
                    out["ids"].append(found)
                    out["scores"].append(values)
        return pa.table({
            "key": pa.array(out["key"], pa.binary()), "ids": pa.array(out["ids"], pa.list_(pa.int64())),
            "scores": pa.array(out["scores"], pa.list_(pa.float64())),
        })

    return run


def _merge(keep: int):
    def run(parts: pa.Table) -> pa.Table:
        ids = parts.column("ids").combine_chunks().flatten().to_numpy()
        scores = parts.column("scores").combine_chunks().flatten().to_numpy()
        found, values = best_of(ids, scores, keep)
        return pa.table({
            "key": pa.array([parts.column("key")[0].as_py()], pa.binary()),
            "ids": pa.array([found], pa.list_(pa.int64())), "scores": pa.array([values], pa.list_(pa.float64())),
        })

    return run


def neighbours(
    df: DataFrame,
    is_query,
    k: int = 20,
    settings: Settings = Settings(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The `k` nearest rows found for each row where `is_query` (a condition on `vec_id`) holds.

    `query_id`, `rank` (from 1), `vec_id`, `score` (inner product of the original vectors, in
    double precision); nearest first, ties to the smaller id, the query itself left out. Rows
    without a usable vector take no part, nor do vectors of another than the most common
    length, nor null ids. An id should be unique; a repeated row counts as one more candidate.
    """
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = pin(vectors(df, id_column, vector_column), "vectors")
    common = rows.groupBy(F.length("vector").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["bytes"] // 8
    rows = rows.filter(F.length("vector") == common["bytes"])
    # One more than asked for, since a query finds itself.
    found = pin(entries(rows, k + 1), "entries")
    index = fit(found, size, settings)
    indexed = pin(with_cells(found, index), "indexed")
    per_cell = indexed.groupBy("cell").count().toArrow()
    counts = np.zeros(len(index.counts), np.int64)
    counts[per_cell.column("cell").to_numpy()] = per_cell.column("count").to_numpy()
    index.place(counts, settings.shard)
    enough = enough_entries(indexed, index, k, settings)

    asking = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "key")
    asked = asking.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    visits = pin(_visits(found.join(asked, "key", "left_semi"), index, enough), "visits")
    per_shard = visits.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    per_shard = pin(per_shard.withColumn("salts", F.ceil(F.col("n") / settings.visitors).cast("int")), "visitors")
    going = join_groups(visits, per_shard, "shard", "n", visits.count())
    going = going.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    going = going.select("shard", "salt", "key", "vector", "cells")
    held = _sharded(indexed, index).join(per_shard, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "vector", "ids", "cell"
    )
    ranked = held.groupBy("shard", "salt").cogroup(going.groupBy("shard", "salt")).applyInArrow(
        _rank(size, k + 1), "key binary, ids array<bigint>, scores array<double>"
    )
    best = ranked.groupBy("key").applyInArrow(_merge(k + 1), "key binary, ids array<bigint>, scores array<double>")
    best = pin(best.join(asked, "key"), "best")
    per_query = join_groups(asking, best, "key", "n", rows.count())
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id"))
    return per_query.select("query_id", F.posexplode(F.slice(pairs, 1, k)).alias("place", "found")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("found.ids").alias("vec_id"),
        F.col("found.scores").alias("score"),
    )
