"""Near-duplicates by SimHash fingerprints in vantage-point trees.

A fingerprint has a bit per place that most shingles' hashes set. Distinct fingerprints are dealt
to shards by the top of a vantage-point tree, fitted on a bounded sample: each node parts them by
their Hamming distance to a vantage point. A fingerprint that lies within the link distance of a
node's boundary is also sent across it. A shard holds a tree of its own over its fingerprints and
finds all pairs with them, leaving out branches by the triangle inequality. Links are joined to
components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from opinara.llm.common import id_and_text, in_parts, join_groups
from opinara.llm.components import components
from opinara.session import pin

SHINGLE = 3
DISTANCE = 3
SEED = 42
# Visitors that meet a shard's tree at a time.
_VISITORS = 1 << 16
_LANES = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class Settings:
    """How work is dealt; no value changes the result.

    The top of the tree has so many leaves that a shard holds about `shard` fingerprints, and
    at most `shards`. It is fitted on about `sample` fingerprints, chosen by hash. A node with up
    to `leaf` fingerprints is compared directly.
    """

    shard: int = 16384
    shards: int = 4096
    sample: int = 32768
    leaf: int = 128


def fingerprint(text: str) -> int:
    """64 bits: those that over half of the hashes of the text's shingles set.

    Lower-casing bytes changes A-Z only, and splitting them parts at the blank and the
    characters 9 to 13 only.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*[words[i:] for i in range(SHINGLE)]) if len(words) >= SHINGLE else [words]
    n = max(1, len(words) - SHINGLE + 1)
    return majority(np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    # Each byte of a lane counts one bit, of at most 255 hashes at a time.
    lanes = (hashes >> np.arange(8, dtype=np.uint64)[:, None]) & _LANES
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=1)
    counts = sums.astype("<u8").view(np.uint8).reshape(8, -1, 8).sum(1, dtype=np.int64)
    # Row i holds the bits i, 8 + i, 16 + i and so on.
    bits = (2 * counts > len(hashes)).T.ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, point): the fingerprint of each text as a signed long; a null text is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            points = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "point": points.view(np.int64)})

    return id_and_text(df, id_column, text_column).mapInArrow(run, "id bigint, point bigint")


def _distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


class VantageTree:
    """A tree over fingerprints: a node parts them by distance to its vantage point.

    Points up to `radius` from the vantage point are inside. Nodes are arrays; a child below zero
    is the leaf -1 - child.
    """

    def __init__(self, points: np.ndarray, leaf: int, most: int | None = None):
        """Halve until nodes have at most `leaf` points, or there are `most` leaves."""
        self.vantage: list[np.uint64] = []
        self.radius: list[int] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = -1
        # Level by level, so that a bound on the leaves gives even ones.
        queue: list[tuple[np.ndarray, int, int]] = [(points, -1, 0)]
        open_leaves = 1
        for own, parent, side in queue:
            split = None
            if len(own) > leaf and (most is None or open_leaves < most):
                split = self._split(own)
            if split is None:
                node = -1 - self.leaves
                self.leaves += 1
            else:
                open_leaves += 1
                vantage, radius, inside = split
                node = len(self.radius)
                self.vantage.append(vantage)
                self.radius.append(radius)
                self.children.append([0, 0])
                queue.append((own[inside], node, 0))
                queue.append((own[~inside], node, 1))
            if parent < 0:
                self.root = node
            else:
                self.children[parent][side] = node

    @staticmethod
    def _split(points: np.ndarray, tried: int = 8, looked_at: int = 512) -> tuple[np.uint64, int, np.ndarray] | None:
        """Vantage point, radius and which points are inside; None if all are equally far from all tried."""
        # Places spread over the points stand in for random ones, so that a tree is made alike again.
        some = points[np.linspace(0, len(points) - 1, min(looked_at, len(points))).astype(np.int64)]
        spread, best = 0.0, None
        for vantage in points[np.linspace(0, len(points) - 1, tried).astype(np.int64)]:
            own = float(_distances(some, vantage).std())
            if own > spread:
                spread, best = own, vantage
        if best is None:
            return None
        far = _distances(points, best)
        counts = np.cumsum(np.bincount(far, minlength=65))
        # The radius nearest to halves that leaves points on both sides.
        sides = np.flatnonzero((counts > 0) & (counts < len(points)))
        radius = int(sides[np.abs(2 * counts[sides] - len(points)).argmin()])
        return best, radius, far <= radius

    def walk(self, points: np.ndarray, home: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per leaf reached: its number, the places of its own points and of its visitors.

        A home point goes down on its side of every node. A point inside that lies within
        `distance` of the boundary also visits the outside; with that, one of two points on
        different sides visits the other's, and visitors follow every branch that the triangle
        inequality does not rule out. So each pair within the distance meets in one leaf at least.
        """
        stack = [(self.root, np.flatnonzero(home), np.flatnonzero(~home))]
        while stack:
            node, own, visitors = stack.pop()
            if not len(own) and not len(visitors):
                continue
            if node < 0:
                yield -1 - node, own, visitors
                continue
            radius = self.radius[node]
            far, visiting = (_distances(points[at], self.vantage[node]).astype(np.int64) for at in (own, visitors))
            inside = far <= radius
            crossing = own[inside & (far > radius - distance)]
            into, out = self.children[node]
            stack.append((into, own[inside], visitors[visiting <= radius + distance]))
            stack.append((out, own[~inside], np.concatenate([crossing, visitors[visiting > radius - distance]])))


class Groups:
    """Disjoint sets of numbers, each named by its smallest."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while True:
            above = self.parent[root]
            if (above == root).all():
                self.parent[at] = root
                return root
            root = above

    def join(self, at: np.ndarray) -> np.ndarray:
        """Join the sets of `at`; the places in `at` of one member of each set that was another."""
        roots, first = np.unique(self.find(at), return_index=True)
        self.parent[roots] = roots[0]
        return first if len(roots) > 1 else first[:0]


def shard_links(home: np.ndarray, visitors: Iterable[np.ndarray], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) of a shard's points among themselves and with its visitors.

    Of the pairs within DISTANCE only those are given that join what was not joined yet, so there
    are fewer links than points and visitors.
    """
    tree = VantageTree(home, settings.leaf)
    joined = np.arange(len(home))
    for guests in visitors:
        points = np.concatenate([home, guests])
        groups = Groups(len(points))
        groups.parent[:len(home)] = joined
        is_home = np.arange(len(points)) < len(home)
        a, b = [], []
        for _, own, others in tree.walk(points, is_home, DISTANCE):
            here = np.concatenate([own, others])
            for begin in range(0, len(own), settings.leaf):
                part = own[begin:begin + settings.leaf]
                near = np.bitwise_count(points[part][:, None] ^ points[here][None, :]) <= DISTANCE
                for i in np.flatnonzero(near.sum(1) > 1).tolist():
                    others_near = here[near[i]]
                    new = others_near[groups.join(others_near)]
                    # All these are near to point i, so a star of it joins them.
                    new = new[new != part[i]]
                    a.append(np.full(len(new), points[part[i]]))
                    b.append(points[new])
        joined = groups.find(np.arange(len(home)))
        if a:
            yield np.concatenate(a), np.concatenate(b)


def _sampled(points: DataFrame, n: int, settings: Settings) -> np.ndarray:
    """About `sample` of the fingerprints, chosen by hash; a bounded number."""
    if n > settings.sample:
        chosen = F.pmod(F.xxhash64(F.lit("sample"), "point"), F.lit(1 << 40))
        points = points.filter(chosen < int((1 << 40) * (settings.sample / n)))
    return np.sort(np.array([r[0] for r in points.select("point").collect()], np.int64)).view(np.uint64)


def links(points: DataFrame, n: int, settings: Settings = Settings()) -> DataFrame:
    """Links (a, b) that join all of the `n` distinct fingerprints within DISTANCE of each other."""
    shards = min(settings.shards, max(1, -(-n // settings.shard)))
    top = VantageTree(_sampled(points, n, settings), 1, shards)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            shard, visits, at = [], [], []
            for leaf, homes, visitors in top.walk(own, np.ones(len(own), bool), DISTANCE):
                at += [homes, visitors]
                visits += [np.zeros(len(homes), bool), np.ones(len(visitors), bool)]
                shard.append(np.full(len(homes) + len(visitors), leaf, np.int32))
            if at:
                yield pa.RecordBatch.from_pydict({
                    "shard": np.concatenate(shard), "visits": np.concatenate(visits),
                    "point": own[np.concatenate(at)].view(np.int64),
                })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, guests in _shards(batches):
            for a, b in shard_links(home, guests, settings):
                yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = points.select("point").mapInArrow(deal, "shard int, visits boolean, point bigint")
    # Shards are as many as tasks, each told by number.
    ordered = dealt.repartitionById(top.leaves, F.col("shard")).sortWithinPartitions("shard", "visits", "point")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Iterator[np.ndarray]]]:
    """Per shard of sorted rows its own points and, part by part, its visitors."""
    rows = _steps(batches)
    held = next(rows, None)

    def guests(shard: int) -> Iterator[np.ndarray]:
        nonlocal held
        parts: list[np.ndarray] = []
        first = True
        while held is not None and held[0] == shard:
            parts.append(held[2])
            held = next(rows, None)
            if sum(map(len, parts)) >= _VISITORS:
                yield np.concatenate(parts)
                parts, first = [], False
        if parts or first:
            yield np.concatenate([np.zeros(0, np.uint64), *parts])

    while held is not None:
        shard, home = held[0], []
        while held is not None and held[0] == shard and not held[1]:
            home.append(held[2])
            held = next(rows, None)
        yield np.concatenate([np.zeros(0, np.uint64), *home]), guests(shard)


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Runs of rows (shard, visits) within a batch."""
    for batch in batches:
        shard, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        points = batch.column(2).to_numpy().view(np.uint64)
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(visits.astype(np.int8)) != 0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(points)]):
            if end > begin:
                yield int(shard[begin]), bool(visits[begin]), points[begin:end]


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """Per row `doc_id`, `fingerprint` (16 lowercase hex digits), `component_id`, `component_size`.

    Shingles are runs of three words, lower-cased in A-Z and parted at the blank and the
    characters 9 to 13; a shorter text is one run. Fingerprints that differ in three bits or
    fewer are linked, and `component_id` is the smallest id that links lead to, its own included.

    A null text is empty; a text without words has the fingerprint zero, which is linked like any
    other, so empty texts are copies of each other. A row with a null id takes part, but its null
    is never the smallest id unless the component has no other. Repeated rows give a row each. An
    empty table gives none. Texts are hashed whole, one at a time; a very long one takes memory in
    proportion to its words. Other columns are not read, so they may have any name.
    """
    rows = pin(fingerprints(df, id_column, text_column), "fingerprints")
    nodes = rows.groupBy("point").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = pin(nodes, "distinct-fingerprints")
    n = nodes.agg(F.count(F.lit(1)).alias("points"), F.sum("copies").alias("rows")).first()
    joined = components(links(nodes, n["points"], settings))
    named = pin(
        nodes.join(joined, F.col("point") == F.col("node"), "left")
        .select("point", "id", "copies", F.coalesce("component", "point").alias("component")),
        "named-fingerprints",
    )
    sizes = pin(
        named.groupBy("component").agg(
            F.min("id").alias("component_id"), F.sum("copies").alias("component_size"), F.count(F.lit(1)).alias("n")
        ),
        "simhash-components",
    )
    placed = join_groups(named, sizes, "component", "n", n["points"])
    placed = pin(placed.select("point", "copies", "component_id", "component_size"), "placed-fingerprints")
    every = join_groups(rows, placed, "point", "copies", n["rows"] or 0)
    return every.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"),
        "component_id", "component_size",
    )
