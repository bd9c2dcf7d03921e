"""Hard negatives from exact integer products of anchor and candidate tiles.

Vectors become integers, so that scores are exact. Anchors are dealt to blocks and candidates to
stripes; a task multiplies one block with one stripe, tile by tile, by Strassen's recursion on
64-bit integers, and keeps bounded heaps: the best positives of each anchor in a first pass, the
best negatives of each positive's window in a second one. The heaps of the tasks are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara.session import pin

# Sizes of a product at which the recursion ends; below, one level costs more than it saves.
LEAF = 16
# Anchors and candidates of one product.
ANCHOR_TILE, CANDIDATE_TILE = 256, 2048

_LOWEST = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    """What is mined, and how work is dealt; the latter changes no result.

    A negative's score lies between `low` and `high` percent of its positive's, both included.
    `scale` is what components are multiplied by before they are rounded down. A task holds at
    most about `block` anchors and reads a stripe of `stripe` candidates, or of as many as it has
    anchors if that is more.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    block: int = 16384
    stripe: int = 2048


def _padded(matrix: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if matrix.shape == (rows, columns):
        return matrix
    out = np.zeros((rows, columns), np.int64)
    out[:matrix.shape[0], :matrix.shape[1]] = matrix
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of two int64 matrices, exact as long as the results fit 64 bits.

    The operands get zeros up to sizes that can be halved down to about LEAF. Sums on the way may
    run over: additions and products of int64 are exact modulo 2 ** 64, and so is the result.
    """
    shortest = min(a.shape[0], b.shape[0], a.shape[1])
    halvings = max(0, (shortest // LEAF).bit_length() - 1)
    step = 1 << halvings
    m, n, k = (-(-size // step) * step for size in (a.shape[0], b.shape[0], a.shape[1]))
    return _strassen(_padded(a, m, k), _padded(b, n, k), halvings)[:a.shape[0], :b.shape[0]]


def _quarters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m, n = x.shape[0] // 2, x.shape[1] // 2
    return x[:m, :n], x[:m, n:], x[m:, :n], x[m:, n:]


def _strassen(a: np.ndarray, b: np.ndarray, halvings: int) -> np.ndarray:
    if not halvings:
        return a @ b.T
    # `b` is held by rows, so its second and third quarter change places against the textbook.
    a11, a12, a21, a22 = _quarters(a)
    b11, b21, b12, b22 = _quarters(b)
    below = halvings - 1
    m1 = _strassen(a11 + a22, b11 + b22, below)
    m2 = _strassen(a21 + a22, b11, below)
    m3 = _strassen(a11, b12 - b22, below)
    m4 = _strassen(a22, b21 - b11, below)
    m5 = _strassen(a11 + a12, b22, below)
    m6 = _strassen(a21 - a11, b11 + b12, below)
    m7 = _strassen(a12 - a22, b21 + b22, below)
    m, n = m1.shape
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = m1 + m4 - m5 + m7
    out[:m, n:] = m3 + m5
    out[m:, :n] = m2 + m4
    out[m:, n:] = m1 - m2 + m3 + m6
    return out


class Heaps:
    """The first `k` (score, id) of many slots: larger scores first, of equal ones smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.scores = np.full((slots, k), _LOWEST)
        self.ids = np.full((slots, k), _LAST)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Merge a row of scores per slot, those that are allowed, of candidates `ids`."""
        good = allowed & (scores >= self.scores[slots, -1][:, None])
        if scores.shape[1] > self.k and np.count_nonzero(good) > 4 * self.k * len(slots):
            # The k-th best of the tile itself bounds what can enter; equal ones stay in.
            held = np.where(good, scores, _LOWEST)
            bound = np.partition(held, -self.k, axis=1)[:, -self.k]
            good &= scores >= bound[:, None]
        row, column = np.nonzero(good)
        if not len(row):
            return
        hit = np.unique(row)
        all_rows = np.concatenate([row, np.repeat(hit, self.k)])
        all_scores = np.concatenate([scores[row, column], self.scores[slots[hit]].ravel()])
        all_ids = np.concatenate([ids[column], self.ids[slots[hit]].ravel()])
        order = np.lexsort((all_ids, ~all_scores, all_rows))
        all_rows, all_scores, all_ids = all_rows[order], all_scores[order], all_ids[order]
        first = np.searchsorted(all_rows, hit)
        take = first[:, None] + np.arange(self.k)
        self.scores[slots[hit]], self.ids[slots[hit]] = all_scores[take], all_ids[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, scores and ids of all that is held."""
        slot, place = np.nonzero(self.scores > _LOWEST)
        return slot, self.scores[slot, place], self.ids[slot, place]


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest integers n with low * s <= 100 * n <= high * s, without running over."""
    tens, rest = scores // 100, scores % 100
    return low * tens - (-low * rest // 100), high * tens + high * rest // 100


def integer_rows(
    df: DataFrame, label: Column, is_anchor: Column, scale: int, id_column: str, vector_column: str
) -> DataFrame:
    """Rows (row, id, label, anchor, vector) that take part, with integer vectors; `row` is unique."""
    rows = df.select(
        F.col(id_column).cast("bigint").alias("id"), label.cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.col(vector_column).cast("array<double>").alias("given"),
    )
    # Null if a component is null, and not below the bound if one is NaN or infinite.
    size = F.aggregate("given", F.lit(0.0), lambda sum, x: sum + (F.abs(x * scale) + 1) * (F.abs(x * scale) + 1))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (size < 2.0**62))
    vector = F.transform("given", lambda x: F.floor(x * scale))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", vector.alias("vector"))


def dealt(anchors: DataFrame, candidates: DataFrame, blocks: int, stripes: int) -> DataFrame:
    """Every anchor in all stripes of its block and every candidate in its stripe of all blocks.

    Rows (task, kind, label, id, row, vector, positives), sorted so that a task gets its anchors
    first. `anchors` may have `positives`, an array of (id, score).
    """
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    place = F.xxhash64(F.lit("place"), "row")
    left = anchors.withColumn("block", F.pmod(place, F.lit(blocks))).withColumn("stripe", every(stripes))
    right = candidates.withColumn("stripe", F.pmod(place, F.lit(stripes))).withColumn("block", every(blocks))
    empty = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    if "positives" not in anchors.columns:
        left = left.withColumn("positives", empty)
    task = (F.col("block") * stripes + F.col("stripe")).cast("int").alias("task")
    own = ["label", "id", "row", "vector", "positives"]
    both = left.select(task, F.lit(0).alias("kind"), *own).unionByName(
        right.withColumn("positives", empty).select(task, F.lit(1).alias("kind"), *own)
    )
    # A task is one block and one stripe, told by number, so that none gets several by chance.
    by_task = both.repartitionById(blocks * stripes, F.col("task"))
    return by_task.sortWithinPartitions("task", "kind", "label", "id", "row")


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of a list array, with zeros where a row is shorter than the longest."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of one task, kind and label, at most CANDIDATE_TILE at a time."""
    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start] or i - start == CANDIDATE_TILE:
                yield keys[start], batch.slice(start, i - start)
                start = i


class _Anchors:
    """The anchors of one task, collected from its first rows."""

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []
        self.ready = False

    def finish(self) -> None:
        self.ready = True
        table = pa.Table.from_batches(self.parts).combine_chunks()
        self.ids, self.row = (table.column(c).to_numpy() for c in ("id", "row"))
        self.label = np.array(table.column("label").to_pylist(), object)
        self.matrix = _matrix(table.column("vector").combine_chunks())
        self.positives = table.column("positives").to_pylist()


def _products(batches: Iterable[pa.RecordBatch], same_label: bool, start) -> Iterator[tuple]:
    """Per task the state that `start(anchors)` gives, with each tile of scores as it comes.

    Yields (state, None) at a task's end and (state, (at, scores, ids, own)) per tile: places of
    the anchors, their scores, the candidates' ids, and which are the anchors' own rows.
    """
    now, anchors, state = None, None, None
    for (task, kind, label), rows in _runs(batches):
        if task != now:
            if state is not None:
                yield state, None
            now, anchors, state = task, _Anchors(), None
        if kind == 0:
            anchors.parts.append(rows)
            continue
        if not anchors.parts:
            continue
        if not anchors.ready:
            anchors.finish()
            state = start(anchors)
        mine = np.flatnonzero((anchors.label == label) == same_label)
        if not len(mine):
            continue
        vectors, ids, row = _matrix(rows.column("vector")), rows.column("id").to_numpy(), rows.column("row").to_numpy()
        width = max(vectors.shape[1], anchors.matrix.shape[1])
        vectors = _padded(vectors, len(ids), width)
        for begin in range(0, len(mine), ANCHOR_TILE):
            at = mine[begin:begin + ANCHOR_TILE]
            scores = strassen(_padded(anchors.matrix[at], len(at), width), vectors)
            yield state, (at, scores, ids, anchors.row[at][:, None] == row)
    if state is not None:
        yield state, None


def best_positives(tasks: DataFrame, k: int) -> DataFrame:
    """Rows (anchor, id, score): per task the first k rows of the label of each anchor (its row)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (anchors, heaps), tile in _products(batches, True, lambda a: (a, Heaps(len(a.ids), k))):
            if tile is not None:
                at, scores, ids, own = tile
                heaps.offer(at, scores, ids, ~own)
                continue
            slot, scores, ids = heaps.rows()
            yield pa.RecordBatch.from_pydict({"anchor": anchors.row[slot], "id": ids, "score": scores})

    return tasks.mapInArrow(run, "anchor bigint, id bigint, score bigint")


class _Windows:
    """Heaps of one task's anchors, one per positive."""

    def __init__(self, anchors: _Anchors, settings: Settings):
        self.anchors, per = anchors, settings.positives
        self.ids, self.scores = (np.zeros((len(anchors.ids), per), np.int64) for _ in range(2))
        there = np.zeros((len(anchors.ids), per), bool)
        for i, positives in enumerate(anchors.positives):
            for j, one in enumerate(positives):
                self.ids[i, j], self.scores[i, j], there[i, j] = one["id"], one["score"], True
        self.low, self.high = windows(self.scores, settings.low, settings.high)
        self.low[~there], self.high[~there] = 1, 0
        self.heaps = Heaps(self.ids.size, settings.negatives)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        per = self.ids.shape[1]
        for j in range(per):
            allowed = (scores <= self.high[at, j][:, None]) & (scores >= self.low[at, j][:, None])
            self.heaps.offer(at * per + j, scores, ids, allowed)

    def batch(self) -> pa.RecordBatch:
        slot, scores, ids = self.heaps.rows()
        anchor, j = np.divmod(slot, self.ids.shape[1])
        return pa.RecordBatch.from_pydict({
            "anchor": self.anchors.row[anchor], "number": j, "anchor_id": self.anchors.ids[anchor],
            "positive_id": self.ids[anchor, j], "positive_score": self.scores[anchor, j],
            "negative_id": ids, "negative_score": scores,
        })


def best_negatives(tasks: DataFrame, settings: Settings) -> DataFrame:
    """Per task the first rows of another label in the window of each anchor's positives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state, tile in _products(batches, False, lambda a: _Windows(a, settings)):
            if tile is None:
                yield state.batch()
            else:
                state.offer(*tile[:3])

    return tasks.mapInArrow(
        run,
        "anchor bigint, number bigint, anchor_id bigint, positive_id bigint, positive_score bigint,"
        " negative_id bigint, negative_score bigint",
    )


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    settings: Settings = Settings(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Per anchor and positive the best negatives: `anchor_id`, `positive_id`, `rank`,
    `negative_id`, `positive_score`, `negative_score`.

    A component x counts as floor(scale * x), a score is the inner product of two rows. Higher
    scores come first, of equal ones the smaller id. An anchor's positives are its first other
    rows with its label; a positive's negatives are the first rows with another label whose score
    is within `low` and `high` percent of the positive's.

    A row with a null id, label, vector or component, or with a component that is not finite,
    takes no part, nor does one whose squared length passes 2 ** 62, as its scores would not fit
    a long. A missing component of a shorter vector counts as zero, so empty vectors score 0.
    Repeated rows are rows of their own: each is an anchor, a positive or a negative. A positive
    without negatives gives no rows, and so does an empty table. Only the columns that are named
    are read, so others may have any name.

    Work is anchors x rows; the rows are read once per `block` anchors, the anchors once per
    stripe. What a task keeps is bounded by its block, whatever the label.
    """
    rows = pin(integer_rows(df, label, is_anchor, settings.scale, id_column, vector_column), "integer-rows")
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    blocks = max(1, -(-n["anchors"] // settings.block))
    stripes = max(1, -(-n["rows"] // max(settings.stripe, n["anchors"] // blocks)))
    anchors, candidates = rows.filter("anchor").drop("anchor"), rows.drop("anchor")
    found = best_positives(dealt(anchors, candidates, blocks, stripes), settings.positives)
    order = [F.desc("score"), "id"]
    number = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    # At most a few rows per anchor are left of each task's heap.
    first = found.withColumn("number", number).filter(F.col("number") <= settings.positives)
    of_anchor = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("number", "id", "score"))).alias("p"))
    of_anchor = pin(of_anchor, "positives")
    given = anchors.join(of_anchor, F.col("row") == F.col("anchor")).withColumn(
        "positives", F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    )
    negatives = best_negatives(dealt(given.drop("anchor", "p"), candidates, blocks, stripes), settings)
    of_positive = Window.partitionBy("anchor", "number").orderBy(F.desc("negative_score"), "negative_id")
    ranked = negatives.withColumn("rank", F.row_number().over(of_positive)).filter(F.col("rank") <= settings.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
