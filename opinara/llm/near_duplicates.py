"""Near-duplicates by DartMinHash.

A text is a weighted set: its word shingles and how often each occurs. Darts fall on the plane
of every shingle, over weight and rank, wherever hashes of the shingle throw them; a text is hit
by those below its weight. Each dart belongs to one coordinate of the signature, which keeps its
earliest dart, that of the lowest rank. Two texts agree in a coordinate with the probability of
their weighted Jaccard similarity. Bands of coordinates are joined, and links are verified on
the shingles themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from opinara.llm.common import CACHED_CHARACTERS, giving_back, id_and_text, in_parts, join_groups, whole_text
from opinara.llm.components import components
from opinara.session import pin

WORDS = 5
SIMILARITY = 0.8
# A pair of similarity 0.8 shares no band with a probability of 0.00005.
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
# Pairs of one bucket that agree in fewer coordinates are not verified: five deviations below 0.8.
LEAST_AGREEING = int(SIMILARITY * COORDINATES - 5 * (SIMILARITY * (1 - SIMILARITY) * COORDINATES) ** 0.5)
# Bytes of text whose darts are thrown at a time; the arrays made of them take some 50 times that.
SIGNED_BYTES = 1 << 18
# Members of a bucket that are compared with each other at a time.
BLOCK = 512

_WORD = re.compile(r"\w+")
_SEEDS = {name: np.uint64(xxhash.xxh64_intdigest(name)) for name in ("shingle", "region", "dart", "place", "weight", "band")}
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_CHARACTERS // 128:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


@cache
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingle_hashes(words: list[str]) -> np.ndarray:
    """A hash of every run of WORDS words; a shorter text is one run."""
    hashes = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    if not len(words):
        return hashes
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, _SEEDS["shingle"] + np.uint64(min(len(words), WORDS)))
    for i in range(min(len(words), WORDS)):
        out = _mix(out * _GOLDEN + hashes[i:i + n])
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of COORDINATES dart hashes per weighted set (elements, weights above 0)."""
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    todo = np.arange(len(sets))
    # So many darts in all hit every coordinate, but for one set in fifty; that gets more.
    darts = COORDINATES * (np.log(COORDINATES) + 4)
    totals = np.array([w.sum() for _, w in sets], float)
    while len(todo):
        filled = _throw([sets[i] for i in todo], darts / totals[todo], out, todo)
        todo, darts = todo[~filled], 2 * darts
    return out


def _throw(sets, limits: np.ndarray, out: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Darts up to a rank per set, their earliest per coordinate into `out`; which sets are full."""
    owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    element = np.concatenate([e for e, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(float)
    # Regions of weight: [0, 1), [1, 2), [2, 4), [4, 8) and so on, as far as the weight goes.
    regions = 1 + np.ceil(np.log2(np.maximum(weight, 1.0))).astype(np.int64)
    at = np.repeat(np.arange(len(element)), regions)
    region = np.arange(len(at)) - np.repeat(np.cumsum(regions) - regions, regions)
    low = np.where(region == 0, 0.0, 2.0 ** (region - 1))
    width = np.maximum(low, 1.0)
    key = _mix(element[at] ^ _mix(_SEEDS["region"] + region.astype(np.uint64)))
    weight, owner = weight[at], owner[at]
    limit = limits[owner]
    rank, number = np.zeros(len(at)), np.zeros(len(at), np.uint64)
    found = []
    while len(key):
        # Ranks of a region's darts are a Poisson process: sums of exponential steps.
        several = 8 if (limit * width).mean() > 3 else 1
        numbers = number[:, None] + np.arange(several, dtype=np.uint64)
        dart = _mix(key[:, None] + _SEEDS["dart"] + numbers * _GOLDEN)
        ranks = rank[:, None] + np.cumsum(-np.log(_unit(dart)) / width[:, None], axis=1)
        in_time = ranks <= limit[:, None]
        height = low[:, None] + width[:, None] * (1.0 - _unit(_mix(dart ^ _SEEDS["weight"])))
        hit = in_time & (height < weight[:, None])
        found.append((np.broadcast_to(owner[:, None], hit.shape)[hit], dart[hit], ranks[hit]))
        more = in_time[:, -1]
        key, weight, owner, limit, low, width = (x[more] for x in (key, weight, owner, limit, low, width))
        rank, number = ranks[more, -1], number[more] + np.uint64(several)
    owner, dart, ranks = (np.concatenate(x) for x in zip(*found))
    slot = owner * COORDINATES + (_mix(dart ^ _SEEDS["place"]) % np.uint64(COORDINATES)).astype(np.int64)
    # Written from the latest to the earliest, so that the earliest stays.
    order = np.argsort(-ranks, kind="stable")
    own = np.zeros(len(sets) * COORDINATES, np.uint64)
    there = np.zeros(len(own), bool)
    own[slot[order]] = dart[order]
    there[slot] = True
    out[to] = own.reshape(-1, COORDINATES)
    return there.reshape(-1, COORDINATES).all(1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(_SEEDS["band"] + np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = _mix(key * _GOLDEN + parts[:, :, i])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets with sorted elements."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = np.minimum(a[1][same], b[1][at[same]]).sum()
    return shared / (a[1].sum() + b[1].sum() - shared)


@giving_back
def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches, SIGNED_BYTES):
        content, sets = [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(words_of(text))
            content.append(xxhash.xxh3_128_digest(hashes) if len(hashes) else None)
            if len(hashes):
                sets.append(np.unique(hashes, return_counts=True))
        signature = signatures(sets) if sets else np.zeros((0, COORDINATES), np.uint64)
        bands = iter(band_keys(signature))
        sketch = iter(signature.astype(np.uint8))
        yield pa.RecordBatch.from_pydict({
            "id": batch.column(0), "row": batch.column(2), "digest": batch.column(3),
            "content": pa.array(content, pa.binary()),
            "bands": pa.array([None if c is None else next(bands) for c in content], pa.list_(pa.int64())),
            "sketch": pa.array([None if c is None else next(sketch).tobytes() for c in content], pa.binary()),
        })


def signed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (id, row, digest, content, bands, sketch); `content` is equal for texts of the same words.

    A text without words has nulls for the last three. The sketch is one byte per coordinate.
    """

    rows = id_and_text(df, id_column, text_column).withColumns(
        {"row": F.monotonically_increasing_id(), "digest": F.xxhash64("text")}
    )
    return rows.mapInArrow(
        _signed, "id bigint, row bigint, digest bigint, content binary, bands array<bigint>, sketch binary"
    )


def _texts(df: DataFrame, ids: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(content, words) of the rows with these ids: the words, compressed."""

    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "content": pa.array([xxhash.xxh3_128_digest(shingle_hashes(w)) for w in words], pa.binary()),
                "words": pa.array([zstandard.compress(" ".join(w).encode()) for w in words], pa.binary()),
            })

    rows = id_and_text(df, id_column, text_column)
    wanted = ids.select(F.col("id").alias("_id")).distinct()
    return rows.join(wanted, F.col("id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(
        run, "content binary, words binary"
    )


def _weighted(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    text = zstandard.ZstdDecompressor().decompress(words).decode()
    return np.unique(shingle_hashes(text.split(" ")), return_counts=True)


def verified(df: DataFrame, nodes: DataFrame, pairs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Of pairs (a, b, n) the links (a, b) with a similarity of SIMILARITY or more.

    `n` bounds how many pairs have the same `b`; its words are sent to as many groups of pairs
    as that asks for, so that no task gets all pairs of one node.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = pin(nodes.select("node", "id", "content").join(ends, "node"), "wanted")
    texts = _texts(df, wanted, id_column, text_column).join(wanted.select("content", "node"), "content")
    texts = pin(texts.select("node", "words").dropDuplicates(["node"]), "wanted-words")
    groups = F.greatest(F.ceil(F.col("n") / 256), F.lit(1))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), groups)).select("a", "b", "salt")
    right = salted.select("b", "salt").distinct().join(
        texts.select(F.col("node").alias("b"), F.col("words").alias("b_words")), "b"
    )
    left = salted.join(texts.select(F.col("node").alias("a"), F.col("words").alias("a_words")), "a")
    both = left.join(right, ["b", "salt"]).select("a", "b", "a_words", "b_words")

    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in in_parts(batches):
            a_ids, b_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i, b in enumerate(b_ids):
                if b != last:
                    last, kept = b, _weighted(batch.column(3)[i].as_py())
                if similarity(_weighted(batch.column(2)[i].as_py()), kept) >= SIMILARITY:
                    good.append(i)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([a_ids[i] for i in good], pa.int64()),
                "b": pa.array([b_ids[i] for i in good], pa.int64()),
            })

    return both.mapInArrow(run, "a bigint, b bigint")


def unresolved_links(
    df: DataFrame, members: DataFrame, n_members: int, nodes: DataFrame, id_column: str, text_column: str
) -> DataFrame:
    """Links (a, b) between different components of one bucket.

    `members`: (key, node, component). In each bucket the largest component is set against the
    rest, and the rest against itself, in blocks of BLOCK members. A block compares sketches,
    and pairs that agree in LEAST_AGREEING coordinates on the shingles. It returns only links
    that join what it has not joined yet, so their number does not exceed that of the members.
    A pair is compared in the first bucket that it shares.
    """
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_components"),
    )
    # In a bucket of two, the leader has met the other.
    buckets = pin(buckets.filter("n_components > 1 AND n > 2"), "unresolved-buckets")
    rows = pin(join_groups(members, buckets, "key", "n", n_members), "unresolved-members")
    wanted = pin(nodes.join(rows.select("node").distinct(), "node"), "unresolved-nodes")
    texts = _texts(df, wanted, id_column, text_column).join(wanted, "content")
    texts = pin(texts.select("node", "bands", "sketch", "words").dropDuplicates(["node"]), "unresolved-words")

    ins = F.ceil(F.col("n_main") / BLOCK).cast("int")
    outs = F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int")
    is_in = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_in, ins).otherwise(outs)).cast("int")
    all_ins, all_outs = F.sequence(F.lit(0), ins - 1), F.sequence(F.lit(0), outs - 1)

    def task(main, x, y):
        return F.struct(F.lit(main).alias("main_in"), x.alias("x"), y.alias("y"))

    with_others = F.transform(all_outs, lambda o: task(False, F.least(o, own), F.greatest(o, own)))
    tasks = F.when(is_in, F.transform(all_outs, lambda o: task(True, own, o))).otherwise(
        F.concat(F.transform(all_ins, lambda i: task(True, i, own)), with_others)
    )
    by = ["key", "main_in", "x", "y"]
    dealt = rows.select("key", "node", "component", is_in.alias("is_in"), F.explode(tasks).alias("t"))
    dealt = dealt.select("key", "t.*", "node", "component", "is_in").join(texts, "node")
    ordered = dealt.select(*by, "node", "component", "is_in", "bands", "sketch", "words")
    ordered = ordered.repartition(*by).sortWithinPartitions(*by)

    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, against, _, _), block in _runs(batches):
            a, b = _links_of_block(key, against, block)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def _links_of_block(key: int, against: bool, block: pa.Table) -> tuple[list[int], list[int]]:
    """Links of one block: of its main component with others, or of others among themselves."""
    node, inside = (block.column(c).to_numpy() for c in ("node", "is_in"))
    component = block.column("component").to_numpy().copy()
    sketch = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    bands = block.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    words = block.column("words")
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def weighted(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in sets:
            sets[i] = _weighted(words[i].as_py())
        return sets[i]

    a, b = [], []
    left = np.flatnonzero(inside) if against else np.arange(len(node))
    for i in np.flatnonzero(~inside).tolist():
        other = left if against else left[:i]
        agreeing = (sketch[other] == sketch[i]).sum(1)
        shared = bands[other] == bands[i]
        first_here = bands[i][shared.argmax(1)] == key
        likely = np.flatnonzero((agreeing >= LEAST_AGREEING) & shared.any(1) & first_here)
        for at in likely[np.argsort(-agreeing[likely], kind="stable")].tolist():
            j = int(other[at])
            if component[i] != component[j] and similarity(weighted(i), weighted(j)) >= SIMILARITY:
                a.append(int(node[j]))
                b.append(int(node[i]))
                component[component == component[i]] = component[j]
    return a, b


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first four columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)]))
        start = 0
        for i, key in enumerate(keys):
            if key != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now, start = [], key, i
        held.append(batch.slice(start))
    if held:
        yield now, pa.Table.from_batches(held)


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: `doc_id`, `class_id`, `class_size`, `spanning_links`, `kept`.

    Two texts are linked if the weighted Jaccard similarity of their runs of five words (case
    and punctuation aside; a shorter text is one run) is 0.8 or more; a class is what links
    connect. `class_id` is the class's smallest id (null first) and `kept` marks one row that
    has it. `spanning_links` counts the links of the row's words that were needed to hold the
    class together, not all of the pairs that are similar; words that are the same need none. A
    null text and one without words are classes of their own. Repeated rows give a row each, an
    empty table none. A text of any length is one set, made by one task; ties between smallest ids
    go by the order of the rows read.

    `df` is read several times and must hold the same rows each time. Other columns are not read.
    """
    return _classes(df, id_column, text_column).select("doc_id", "class_id", "class_size", "spanning_links", "kept")


def keep_one_each(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `df`, all columns, that `near_duplicates` keeps: one of each class.

    Rows are found again by id and a hash of the text. Only where several rows are alike in
    both is one of them picked by a shuffle of their own. Columns of `df` may have any names.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    name = dict(zip(df.columns, plain.columns))
    found = _classes(plain, name[id_column], name[text_column])
    alike = found.groupBy(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).agg(
        F.count(F.lit(1)).alias("kept_n"), F.max("kept").alias("kept")
    )
    kept = pin(alike.filter("kept"), "near-kept")
    rows = plain.withColumns({
        "own_id": F.col(name[id_column]).cast("bigint"), "own_digest": F.xxhash64(whole_text(name[text_column]))
    })
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_digest") == F.col("kept_digest"))
    out = rows.join(kept.filter("kept_n = 1"), same, "left_semi")
    several = kept.filter("kept_n > 1")
    if not several.isEmpty():
        picked = rows.join(several, same, "left_semi").dropDuplicates(["own_id", "own_digest"])
        out = out.unionByName(picked)
    return out.select(*plain.columns).toDF(*df.columns)


def _classes(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The result of `near_duplicates` with a hash of each text, `digest`."""
    rows = pin(signed(df, id_column, text_column), "signatures")
    worded = rows.filter("content IS NOT NULL")
    best = F.min(F.struct("id", "row"))
    nodes = worded.groupBy("content").agg(
        best.alias("best"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    nodes = pin(nodes.select(
        "content", F.col("best.row").alias("node"), F.col("best.id").alias("id"), "copies", "bands", "sketch"
    ), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = pin(buckets, "buckets")
    n_nodes = nodes.count()
    # A bucket's members first meet its leader only.
    shared = pin(join_groups(members, buckets, "key", "n", n_nodes), "bucket-members")
    pairs = pin(
        shared.filter("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b"))
        .agg(F.max("n").alias("n")),
        "leader-pairs",
    )
    links = pin(verified(df, nodes, pairs, id_column, text_column), "leader-links")
    first = pin(components(links), "first-components")
    named = shared.select("key", "node").join(first, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    more = pin(unresolved_links(df, named, n_nodes, nodes, id_column, text_column), "more-links")
    every = links.unionByName(more)
    joined = pin(components(every), "components")
    degrees = every.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("spanning_links")
    )
    known = pin(
        nodes.select("content", "node", "id", "copies").join(joined, "node", "left").join(degrees, "node", "left")
        .withColumn("component", F.coalesce("component", "node")),
        "named-nodes",
    )
    classes = known.groupBy("component").agg(
        F.min(F.struct("id", "node")).alias("least"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n")
    )
    classes = pin(classes, "classes")
    contents = join_groups(known, classes, "component", "n", n_nodes).select(
        "content", "copies", "class_size", F.col("least.id").alias("class_id"), F.col("least.node").alias("kept_row"),
        F.coalesce("spanning_links", F.lit(0).cast("bigint")).alias("spanning_links"),
    )
    contents = pin(contents, "class-contents")
    placed = join_groups(worded.select("id", "row", "digest", "content"), contents, "content", "copies", rows.count())
    placed = placed.select(
        F.col("id").alias("doc_id"), "digest", "class_id", "class_size", "spanning_links",
        (F.col("row") == F.col("kept_row")).alias("kept"),
    )
    alone = rows.filter("content IS NULL").select(
        F.col("id").alias("doc_id"), "digest", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"),
        F.lit(0).cast("bigint").alias("spanning_links"), F.lit(True).alias("kept"),
    )
    return placed.unionByName(alone)
