"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is one of characters, per language, counted over the trusted texts. N-gram counts,
their contexts and the distinct n-grams of the corpus are tables that meet in joins sharded by
n-gram, so neither the model nor the corpus has to fit a task. The documents stay in blocks;
each block asks for the n-grams it holds and gets their probabilities back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara.llm.common import give_back, giving_back, pack_rows, unpack_rows, whole_text
from opinara.session import local_table, pin

# A block of documents is closed at so many bytes of text; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
# Ids of fitted rows that are broadcast at most; of more, documents and ids meet by id.
BROADCAST_IDS = 4_000_000
# Width of the steps in which limits are sought, in nats a character.
STEP = 0.001


@dataclass(frozen=True)
class Settings:
    """Parameters of the model and of the decision.

    The model counts all trusted rows that are not held out. Only if a `trusted_limit` is given is
    it fitted on a sample of about that many, by hash of the id, in which small languages keep all
    their rows.
    `held_out` of 100 trusted rows, of all of them, are not counted but give the limits; a language
    of which none is held out has those over all languages. A text's mean is drawn to the language's median as if it had
    `prior` more characters of that, since short texts vary. The limits of a language are those
    that tell its held-out good rows best from its bad ones (quality 0 or toxic), with at least
    the share `least` of the good ones below the upper limit and at most 1 - `quantile` of the
    trusted ones below the lower limit. Without bad rows the upper limit is the `quantile` of the
    good ones. It lies at least `slack` over the root of the number of held-out texts above the
    median, as few tell little of it.
    """

    order: int = 4
    trusted_limit: int | None = None
    held_out: int = 20
    prior: int = 64
    quantile: float = 0.99
    least: float = 0.97
    slack: float = 0.5


def _points(texts: list[str], order: int) -> np.ndarray:
    """Code points of the texts, each padded with line feeds in front, so that every character
    ends one n-gram."""
    pad = "\n" * (order - 1)
    return np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le"), "<u4")


def _characters(texts: list[str], step: int = 1 << 10) -> np.ndarray:
    """The distinct characters of the texts and of their padding, sorted."""
    present = np.zeros(0x110000, bool)
    present[ord("\n")] = True
    for i in range(0, len(texts), step):
        present[_points(texts[i:i + step], 1)] = True
    return np.flatnonzero(present)


def _parts(texts: list[str], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` characters, to bound the arrays made of them."""
    begin, n = 0, 0
    for i, text in enumerate(texts):
        if n and n + len(text) > size:
            yield begin, i
            begin, n = i, 0
        n += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _codes(texts: list[str], order: int, characters: np.ndarray) -> np.ndarray:
    """N-gram code of every character of the texts, in the numbers of `characters`."""
    points = _points(texts, order)
    number = np.zeros(0x110000, np.int64)
    number[characters] = np.arange(len(characters))
    own = number[points]
    base = max(2, len(characters))
    n = max(0, len(own) - order + 1)
    code = own[:n].copy()
    for i in range(1, order):
        code *= base
        code += own[i:i + n]
    # Windows that start in one text's last characters end in the next one's padding.
    ends = np.cumsum([len(t) + order - 1 for t in texts])[:-1] - (order - 1)
    keep = np.ones(n, bool)
    for i in range(order - 1):
        keep[ends + i] = False
    return code[keep]


def _strings(codes: np.ndarray, characters: np.ndarray, order: int) -> list[str]:
    """N-grams of codes."""
    base = max(2, len(characters))
    points = np.empty((len(codes), order), "<u4")
    rest = codes.copy()
    for i in reversed(range(order)):
        points[:, i] = characters[rest % base]
        rest //= base
    joined = points.tobytes().decode("utf-32-le")
    return [joined[i:i + order] for i in range(0, len(joined), order)]


def _counted(texts: list[str], order: int, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes, sorted, and their counts."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for begin, end in _parts(texts):
        more, n = np.unique(_codes(texts[begin:end], order, characters), return_counts=True)
        codes, at = np.unique(np.concatenate([codes, more]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
    return codes, counts


def _blocks(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple[int, pa.Table]]:
    """Tables of whole rows, each with a name: a hash of its texts.

    If the rows are dealt to tasks differently when they are read again, the names differ, too,
    and scoring ends with an error.
    """
    parts, size = [], 0

    def made() -> tuple[int, pa.Table]:
        # Hashed where they lie: all bytes first, then all lengths, however rows came in batches.
        block = xxhash.xxh64()
        columns = [part.column(text) for part in parts]
        for own in columns:
            offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset:own.offset + len(own) + 1]
            block.update(memoryview(own.buffers()[2] or b"")[offsets[0]:offsets[-1]])
        for own in columns:
            block.update(pc.binary_length(own).to_numpy(zero_copy_only=False).tobytes())
        return block.intdigest() - (1 << 63), pa.Table.from_batches(parts)

    # Where a block ends depends on the texts alone, not on how rows come in batches.
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy())
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, done + BLOCK_BYTES - size, side="right"))
            if end == begin and not size:
                end += 1
            if end > begin:
                parts.append(batch.slice(begin, end - begin))
                size += int(ends[end - 1] - done)
            begin = end
            if begin < batch.num_rows:
                yield made()
                parts, size = [], 0
    if parts:
        yield made()


def _by_language(rows: pa.Table, language: str, text: str) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    languages = np.array(rows.column(language).to_pylist(), object)
    texts = rows.column(text)
    for name in sorted(set(languages)):
        at = np.flatnonzero(languages == name)
        yield name, at, texts.take(pa.array(at)).to_pylist()


def block_grams(rows: DataFrame, order: int) -> DataFrame:
    """Rows (block, lang, gram, n): the n-grams of each block and how often they are there."""

    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, docs in _blocks(batches, 1):
            for name, _, texts in _by_language(docs, "_lang", "_text"):
                characters = _characters(texts)
                grams, n = _counted(texts, order, characters)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(grams), block), pa.int64()),
                    "lang": pa.array([name] * len(grams), pa.string()),
                    "gram": pa.array(_strings(grams, characters, order), pa.string()),
                    "n": pa.array(n, pa.int64()),
                })

    return rows.select("_lang", "_text").mapInArrow(run, "block bigint, lang string, gram string, n bigint")


def discounts(counts: DataFrame) -> DataFrame:
    """Per language the discounts `d1`, `d2`, `d3` of one order, from its counts of counts."""
    n = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        own, more = F.col(f"n{i}"), F.col(f"n{i + 1}")
        value = i - (i + 1) * F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")) * F.try_divide(more, own)
        # Too few counts for an estimate: the usual half.
        usable = (own > 0) & (more > 0) & (value > 0)
        return F.when(usable, value).otherwise(F.lit(i - 0.5)).alias(f"d{i}")

    return counts.groupBy("lang").agg(*n).select("lang", *[discount(i) for i in (1, 2, 3)])


def _discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def gram_probabilities(counts: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """`p` of each wanted (lang, gram), all distinct: modified Kneser-Ney, interpolated down to uniform.

    `counts`: (lang, gram, c) of the highest order. Lower orders count the distinct characters
    before an n-gram. A language without counts gives no rows.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        suffix = F.substring("gram", 2, k).alias("gram")
        counted = levels[k + 1].select("lang", suffix).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))
        # Written, as every order above reads the ones below several times.
        levels[k] = pin(counted, "gram-level")
    vocabulary = levels[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("size"))
    lower = None
    for k in range(1, order + 1):
        level = levels[k].join(discounts(levels[k]), "lang")
        contexts = (
            level.withColumn("context", F.substring("gram", 1, k - 1))
            .groupBy("lang", "context")
            .agg(F.sum("c").alias("total"), F.sum(_discount(F.col("c"))).alias("given"))
        )
        held = level.select("lang", "gram", (F.col("c") - _discount(F.col("c"))).alias("own"))
        asked = wanted.select("lang", F.substring("gram", order - k + 1, k).alias("gram"))
        asked = asked.distinct() if k < order else asked
        rows = (
            asked.withColumn("context", F.substring("gram", 1, k - 1))
            .join(held, ["lang", "gram"], "left")
            .join(contexts, ["lang", "context"], "left")
        )
        if lower is None:
            rows = rows.join(vocabulary, "lang").withColumn("below", 1 / F.col("size"))
        else:
            rows = rows.withColumn("rest", F.substring("gram", 2, k - 1)).join(
                lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("below")), ["lang", "rest"]
            )
        seen = (F.coalesce("own", F.lit(0.0)) + F.col("given") * F.col("below")) / F.col("total")
        lower = pin(rows.select("lang", "gram", F.coalesce(seen, "below").alias("p")), "gram-probabilities")
    return lower


def perplexities(
    df: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    columns: list[str] | None = None,
) -> DataFrame:
    """Per row the chosen columns of `df` (default: the id), `_lang`, `_n` and `_nats`.

    `_n` counts characters, `_nats` is their negative log probability (null if no trusted text
    has the language). `labels` has the ids of trusted rows.
    """
    columns = [id_column] if columns is None else columns
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)]
    rows = df.select(
        F.coalesce(F.col(language_column).cast("string"), F.lit("")).alias("_lang"),
        whole_text(text_column).alias("_text"),
        F.col(id_column).cast("bigint").alias("_id"),
        *kept,
    )
    order = settings.order
    ids = labels.select(F.col("_trusted").alias("_id"))
    # Files tell too little of how many ids they hold.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    trusted = rows.join(ids, "_id", "left_semi")
    counted = block_grams(trusted, order).groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    counts = pin(counted, "gram-counts")
    asked = pin(block_grams(rows, order).select("block", "lang", "gram"), "block-grams")
    wanted = pin(asked.select("lang", "gram").distinct(), "wanted-grams")
    p = gram_probabilities(counts, wanted, order)
    answers = asked.join(p, ["lang", "gram"])
    # The distinct languages of the model: as many as the labelled rows have, not the corpus.
    modelled = {r["lang"] for r in counts.select("lang").distinct().collect()}

    @giving_back
    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, docs in _blocks(batches, 1):
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([block], pa.int64()), "docs": pa.array([pack_rows(docs)], pa.binary())}
            )

    def score(docs: pa.Table, grams: pa.Table) -> pa.Table:
        known = dict.fromkeys(modelled, ([], np.zeros(0)))
        languages = np.array(grams.column("lang").to_pylist(), object)
        for name in set(languages):
            at = pa.array(np.flatnonzero(languages == name))
            known[name] = (grams.column("gram").take(at).to_pylist(), grams.column("p").take(at).to_numpy())
        out = []
        for data in docs.column("docs").to_pylist():
            block = unpack_rows(data)
            n, nats = np.zeros(block.num_rows, np.int64), np.full(block.num_rows, np.nan)
            for name, at, texts in _by_language(block, "_lang", "_text"):
                n[at] = [len(t) for t in texts]
                if name in modelled:
                    nats[at] = _score(texts, *known[name], order)
            chosen = [block.column(f"_c{i}") for i in range(len(columns))]
            out.append(pa.Table.from_arrays(
                [*chosen, block.column("_lang"), pa.array(n), pa.array(nats, mask=np.isnan(nats))],
                [*[f"_c{i}" for i in range(len(columns))], "_lang", "_n", "_nats"],
            ))
        return pa.concat_tables(out)

    def scored_block(docs: pa.Table, grams: pa.Table) -> pa.Table:
        found = score(docs, grams)
        give_back()
        return found

    schema = rows.select(*[f"_c{i}" for i in range(len(columns))], "_lang").schema
    schema = schema.add("_n", "long").add("_nats", "double")
    blocks = rows.drop("_id").mapInArrow(packed, "block bigint, docs binary")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored_block, schema)
    return scored.toDF(*columns, "_lang", "_n", "_nats")


def _score(texts: list[str], grams: list[str], p: np.ndarray, order: int) -> np.ndarray:
    """Negative log probability of each text."""
    out = np.zeros(len(texts))
    characters = _characters(texts)
    base = max(2, len(characters))
    number = np.full(0x110000, -1, np.int64)
    number[characters] = np.arange(len(characters))
    own = number[np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, order)]
    here = np.flatnonzero((own >= 0).all(1))
    known = np.zeros(len(here), np.int64)
    for i in range(order):
        known = known * base + own[here, i]
    by_code = np.argsort(known)
    known, nats = known[by_code], -np.log(p[here][by_code])
    for begin, end in _parts(texts):
        codes = _codes(texts[begin:end], order, characters)
        at = np.searchsorted(known, codes)
        if len(codes) and (not len(known) or (known[np.minimum(at, len(known) - 1)] != codes).any()):
            raise RuntimeError("the documents changed between two reads")
        total = np.r_[0.0, np.cumsum(nats[at])] if len(codes) else np.zeros(1)
        lengths = np.array([len(t) for t in texts[begin:end]])
        stops = np.cumsum(lengths)
        out[begin:end] = total[stops] - total[stops - lengths]
    return out


def trusted_ids(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Ids `_trusted` of all rows labelled good and not toxic."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0")
    return good.select(F.col(id_column).cast("bigint").alias("_trusted")).distinct().filter("_trusted IS NOT NULL")


def largest_share(sizes: list[int], limit: int) -> float:
    """Rows that each group may have so that, with smaller groups whole, `limit` are not passed."""
    left = limit
    for place, n in enumerate(sorted(sizes)):
        share = left / (len(sizes) - place)
        if n > share:
            return share
        left -= n
    return float("inf")


def fitted_ids(given: DataFrame, settings: Settings) -> DataFrame:
    """Ids `_trusted` of the rows the model is fitted on: all, or about `trusted_limit` if that is set.

    `given`: (_trusted, _lang). A language with fewer rows than its share keeps them all.
    """
    if settings.trusted_limit is None:
        return given.select("_trusted").distinct()
    # One row per language of the labelled rows.
    sizes = {r["_lang"]: r["count"] for r in given.groupBy("_lang").count().collect()}
    share = largest_share(list(sizes.values()), settings.trusted_limit)
    cut = [name for name, n in sizes.items() if n > share]
    if cut:
        of_million = [int(share / sizes[name] * 1_000_000) for name in cut]
        shares = F.broadcast(local_table(given.sparkSession, _lang=cut, _share=of_million))
        given = given.join(shares, "_lang", "left").filter(
            F.col("_share").isNull()
            | (F.pmod(F.xxhash64(F.lit("sample"), "_trusted"), F.lit(1_000_000)) < F.col("_share"))
        )
    return given.select("_trusted").distinct()


def bad_ids(labels: DataFrame, trusted: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Ids `_bad` of rows labelled bad or toxic and nowhere trusted."""
    bad = labels.filter("quality = 0 OR toxic = 1").select(F.col(id_column).cast("bigint").alias("_bad"))
    return bad.distinct().join(trusted, F.col("_bad") == F.col("_trusted"), "left_anti")


def limits(labelled: DataFrame, settings: Settings) -> DataFrame:
    """Per language `_low` (null if no lower limit helps) and `_high`.

    `labelled`: (_lang, _mean, _middle, _kind), the kind being held, fitted or bad. Rows are
    counted by steps of the mean first, so that a language has a bounded number of rows. The row
    of the null language is over all languages.
    """

    def count(*kinds: str) -> Column:
        return F.count_if(F.col("_kind").isin(*kinds))

    steps = (
        labelled.groupBy("_lang", F.floor(F.col("_mean") / STEP).alias("step"))
        .agg(count("held").alias("good"), count("held", "fitted").alias("trusted"), count("bad").alias("bad"),
             F.max("_middle").alias("_middle"))
    )
    together = steps.groupBy("step").agg(
        *[F.sum(c).alias(c) for c in ("good", "trusted", "bad")], F.max("_middle").alias("_middle")
    )
    steps = steps.unionByName(together.withColumn("_lang", F.lit(None).cast("string")))
    below = Window.partitionBy("_lang").orderBy("step")
    whole = Window.partitionBy("_lang")
    share = {}
    for kind in ("good", "trusted", "bad"):
        steps = steps.withColumn(f"all_{kind}", F.sum(kind).over(whole))
        steps = steps.withColumn(f"upto_{kind}", F.sum(kind).over(below))
        share[kind] = F.coalesce(F.try_divide(f"upto_{kind}", f"all_{kind}"), F.lit(0.0))
    # The end of a step is a limit: shares of good rows lost and of bad rows kept are weighed alike.
    end = (F.col("step") + 1) * STEP
    high = F.when(
        F.when(F.col("all_bad") > 0, share["good"] >= settings.least).otherwise(share["good"] >= settings.quantile),
        F.struct((share["bad"] - share["good"]).alias("cost"), end.alias("end")),
    )
    first = F.when(share["good"] >= settings.quantile, end)
    gain = share["bad"] - share["trusted"]
    low = F.when(
        (gain > 0) & (share["trusted"] <= 1 - settings.quantile) & (end < F.col("_middle")),
        F.struct(gain.alias("gain"), end.alias("end")),
    )
    found = steps.filter("all_good > 0").groupBy("_lang").agg(
        F.when(F.max("all_bad") > 0, F.min(high)["end"]).otherwise(F.min(first)).alias("_chosen"),
        F.max(low)["end"].alias("_low"),
        (F.max("_middle") + settings.slack / F.sqrt(F.max("all_good"))).alias("_least"),
    )
    return found.select("_lang", "_low", F.greatest("_chosen", "_least").alias("_high"))


def quality(
    df: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    columns: list[str] | None = None,
    label_id: str = "doc_id",
) -> DataFrame:
    """Per row the chosen columns (default: the id), `perplexity`, `floor`, `threshold` and `kept`.

    `perplexity` is per character, drawn to the median of the language; `floor` and `threshold`
    are the language's limits, `floor` null where a lower limit tells nothing. An empty or null
    text has the median perplexity; a text in a language without trusted text has no figures and
    is kept. Repeated rows and null ids give a row each; an empty table gives none, and without any
    labels all rows are kept. A text longer than a block is one of its own, scored part by part.
    `df` is read several times and must hold the same rows each time.
    """
    columns = [id_column] if columns is None else columns
    trusted = pin(trusted_ids(labels, label_id), "trusted")
    is_held = F.pmod(F.xxhash64(F.lit("held out"), "_trusted"), F.lit(100)) < settings.held_out
    wanted = columns if id_column in columns else [*columns, id_column]
    languages = df.select(
        F.col(id_column).cast("bigint").alias("_trusted"),
        F.coalesce(F.col(language_column).cast("string"), F.lit("")).alias("_lang"),
    )
    in_languages = pin(languages.join(trusted.filter(~is_held), "_trusted").distinct(), "trusted-languages")
    fitted = pin(fitted_ids(in_languages, settings), "fitted")
    scored = perplexities(df, fitted, settings, id_column, text_column, language_column, wanted)
    scored = pin(scored, "perplexities")
    kinds = trusted.select(
        F.col("_trusted").alias("_id"), F.when(is_held, F.lit("held")).otherwise(F.lit("fitted")).alias("_kind")
    ).unionByName(bad_ids(labels, trusted, label_id).select(F.col("_bad").alias("_id"), F.lit("bad").alias("_kind")))
    known = scored.filter("_nats IS NOT NULL AND _n > 0").select(
        F.col(id_column).cast("bigint").alias("_id"), "_lang", "_n", "_nats"
    )
    labelled = pin(known.join(kinds, "_id").drop("_id"), "labelled")
    mean = F.col("_nats") / F.col("_n")
    # The row of the null language is over all languages.
    middle = labelled.filter("_kind = 'held'").rollup("_lang").agg(
        F.percentile_approx(mean, 0.5, 10_000).alias("_middle")
    )
    drawn = (F.col("_nats") + settings.prior * F.col("_middle")) / (F.col("_n") + settings.prior)
    known = labelled.join(middle, "_lang").withColumn("_mean", drawn)
    found = limits(known, settings).withColumnRenamed("_lang", "_of")
    figures = pin(middle.join(found, F.col("_lang").eqNullSafe(F.col("_of")), "left").drop("_of"), "limits")
    rest = figures.filter("_lang IS NULL").drop("_lang")
    rest = rest.select(*[F.col(c).alias(f"_all{c}") for c in rest.columns])
    # `rest` is one row at most.
    drawn_rows = scored.join(figures, "_lang", "left").join(F.broadcast(rest), F.lit(True), "left")
    own = F.col("_middle").isNotNull()
    for c in ("_low", "_high", "_middle"):
        drawn_rows = drawn_rows.withColumn(c, F.when(own, F.col(c)).otherwise(F.col(f"_all{c}")))
    drawn_rows = drawn_rows.withColumn("_mean", drawn)
    kept = (F.col("_mean") <= F.col("_high")) & F.coalesce(F.col("_mean") >= F.col("_low"), F.lit(True))
    return drawn_rows.select(
        *[F.col(f"`{c}`") for c in columns],
        F.exp("_mean").alias("perplexity"),
        F.exp("_low").alias("floor"),
        F.exp("_high").alias("threshold"),
        F.coalesce(kept, F.lit(True)).alias("kept"),
    )


def keep_good(
    df: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
) -> DataFrame:
    """The rows of `df`, all columns, that `quality` keeps; null, empty and repeated ones as there.

    Language and text decide alone. So only the id, the language and a hash of the text go through
    the model beside the text, and rows that they drop are left out by an anti-join. Columns of
    `df` may have any names; an empty table gives none.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    name = dict(zip(df.columns, plain.columns))
    own = {
        "id": F.col(name[id_column]).cast("bigint"), "lang": F.col(name[language_column]).cast("string"),
        "digest": F.xxhash64(whole_text(name[text_column])),
    }
    narrow = plain.select(*[c.alias(n) for n, c in own.items()], whole_text(name[text_column]).alias("text"))
    found = quality(narrow, labels, settings, "id", "text", "lang", list(own))
    dropped = pin(found.filter("NOT kept").select(*own).distinct(), "dropped")
    same = F.lit(True)
    for n, c in own.items():
        same = same & c.eqNullSafe(F.col(n))
    return plain.join(dropped, same, "left_anti").toDF(*df.columns)
