"""Row positions, batches, samples and exact order statistics without single-task windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara.session import pin

# Reviews per model call and per random feed.
BATCH_SIZE = 10
FEED_SIZE = 20

# A position counter holds the partition number above this many bits of row number.
_COUNTER_BITS = 33

# Hot groups of a top-k are cut into this many salts before the final pick.
_SALTS = 64

# Seeded keys are below two to the power of this.
_SEEDED_BITS = 60

# Sketches for order statistics: their size, the steps in which their quantiles are read, and how
# far, as a share of the rows, a rank may lie from where they place it. The margin is three times
# the error that a sketch of this size keeps to in 99 of 100 cases; a rank outside is sought anew.
_SKETCH = 2048
_STEPS = 1024
_MARGIN = 0.008
# Rows of one bracket that are counted by value; a larger one is narrowed first.
_COUNTED = 1 << 22


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many signs behind it as no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _offsets(sizes: DataFrame, part: str, size: str, offset: str) -> DataFrame:
    """Per part the rows before it. `sizes` has one row per partition or file."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(offset))


def stored_row_index(df: DataFrame, name: str = "row_index") -> DataFrame | None:
    """Add the 0-based row position in a stored parquet table, or None if `df` is none.

    Files count in the order of their paths, rows in that of their file, so positions are the same
    whatever the files are split into and however often they are read. No row is written or
    shuffled: parquet tells a row's place in its file, and a scan of that alone counts the rows of
    each file. `df` may be a choice of the table's columns; if rows have been filtered or repeated
    since the table was read, places and counts disagree and the result is None.
    """
    file, place, offset, size = (unused(df, c) for c in ("_file", "_place", "_offset", "_size"))
    try:
        placed = df.select(
            "*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)
        )
    except AnalysisException:
        return None
    rows = F.count(F.lit(1))
    sizes = pin(
        placed.groupBy(file).agg(
            rows.alias(size), (F.max(place) + 1).alias("top"), F.sum(place).alias("sum"), F.min(place).alias("least")
        ),
        "file-sizes",
    )
    whole = (F.col(size) == F.col("top")) & (F.col("least") == 0) & (
        2 * F.col("sum") == F.col(size) * (F.col(size) - 1)
    )
    if not sizes.filter(~whole).isEmpty():
        return None
    numbered = placed.join(_offsets(sizes, file, size, offset), file)
    return numbered.withColumn(name, F.col(offset) + F.col(place)).drop(file, place, offset)


def with_row_index(
    df: DataFrame, name: str = "row_index", order_by: Sequence[str] | None = None, stored: bool = True
) -> DataFrame:
    """Add the 0-based row position over the whole table.

    Without `order_by` positions follow the rows as they are read; where `df` is a stored table,
    `stored_row_index` gives them without a copy (`stored=False` leaves out the attempt, for rows
    that are known to be filtered). Otherwise rows are range-sorted by `order_by`, numbered inside
    each partition and written once with that number; each partition then adds the row count of
    those before it. The write is what keeps positions right if executors are lost or join: the
    next read of the same files may be split into other partitions. Equal keys may be spread over
    partitions, since the read position breaks ties. The only table that is not distributed has
    one row per partition or file, and is written, too, so that Spark knows its size.
    """
    if stored and not order_by:
        found = stored_row_index(df, name)
        if found is not None:
            return found
    slot, part, offset, size = (unused(df, c) for c in ("_slot", "_part", "_offset", "_size"))
    counted = df.withColumn(slot, F.monotonically_increasing_id())
    if order_by:
        counted = counted.orderBy(*order_by, slot).withColumn(slot, F.monotonically_increasing_id())
    counted = pin(counted, "row-index")
    number = F.shiftrightunsigned(slot, _COUNTER_BITS)
    within = F.col(slot).bitwiseAND(F.lit((1 << _COUNTER_BITS) - 1))
    sizes = pin(counted.groupBy(number.alias(part)).agg(F.count(F.lit(1)).alias(size)), "part-sizes")
    return (
        counted.withColumn(part, number)
        .join(_offsets(sizes, part, size, offset), part)
        .withColumn(name, F.col(offset) + within)
        .drop(part, offset, slot)
    )


def with_batches(
    df: DataFrame, batch_size: int = BATCH_SIZE, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Number consecutive rows into batches: adds `row_index`, `batch_id`, 1-based `position`."""
    size = F.lit(batch_size)
    return (
        with_row_index(df, "row_index", order_by)
        .withColumn("batch_id", F.floor(F.col("row_index") / size))
        .withColumn("position", (F.col("row_index") % size + 1).cast("int"))
    )


def seeded_key(column: Column, seed: int) -> Column:
    """A number in [0, 2^60) that looks random but depends on value and seed only."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text))
    return F.conv(F.substring(digest, 1, _SEEDED_BITS // 4), 16, 10).cast("bigint")


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows of every group, with their 1-based `rank`.

    Picked within salts of each group first, so a group that holds most rows is spread over
    tasks and the last step sees at most k rows per salt. Spark also limits the groups
    before each shuffle, as the filter is on a row number.
    """
    salt, place = unused(df, "_salt"), unused(df, "_place")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(_SALTS)))
    by_salt = Window.partitionBy(*keys, salt).orderBy(*order)
    kept = salted.withColumn(place, F.row_number().over(by_salt)).filter(F.col(place) <= k)
    by_group = Window.partitionBy(*keys).orderBy(*order)
    return (
        kept.drop(salt, place)
        .withColumn(rank, F.row_number().over(by_group))
        .filter(F.col(rank) <= k)
    )


def row_hash(df: DataFrame) -> Column:
    """128 bits made of all columns: equal rows have the same ones, other rows others.

    Two hashes with different beginnings, as two of 10^10 rows may well share one of 64 bits.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b"))


def sample_per_group(
    df: DataFrame,
    keys: Sequence[str],
    n: int,
    seed: int = 0,
    id_column: str = "review_id",
    row: str | None = None,
) -> DataFrame:
    """Exactly min(n, group size) rows per group, chosen by seed.

    Gives (keys, id, 0-based `position`), and `row`, a column that tells rows apart whose ids
    are missing or repeated. The sample is written, so a join that fetches the rows knows its
    true size, and Spark broadcasts it only when it is small.

    Keys are even in their range, so that the size of a group tells below which key its first n
    lie, with room to spare. Sizes are counted in the map tasks, and only rows below the limit of
    their group, little more than n of each, are sorted. A group of which that leaves too few (many
    rows may share an id and so a key) is picked from all its rows.
    """
    keys, more = list(keys), [row] if row else []
    narrow = df.select(*keys, id_column, *more).dropna(subset=keys)
    key, place, size = (unused(narrow, c) for c in ("_key", "_rank", "_size"))
    own = F.coalesce(F.col(id_column).cast("string"), F.col(row).cast("string")) if row else F.col(id_column)
    keyed = narrow.withColumn(key, seeded_key(own, seed))
    sizes = pin(narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)), "group-sizes")
    room = n + 8 * n**0.5 + 32
    limit = F.floor(F.least(F.lit(room) / F.col(size), F.lit(1.0)) * float(1 << _SEEDED_BITS))

    def picked(of: DataFrame) -> DataFrame:
        best = top_k_per_group(of, keys, [key, id_column, *more], n, place)
        return pin(best.select(*keys, id_column, *more, (F.col(place) - 1).alias("position")), "sample")

    best = picked(keyed.join(sizes, keys).filter(F.col(key) <= limit).drop(size))
    got = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("got"))
    short = sizes.join(got, keys, "left").filter(F.coalesce("got", F.lit(0)) < F.least(size, F.lit(n)))
    if short.isEmpty():
        return best
    short = pin(short.select(*keys), "short-groups")
    return best.join(short, keys, "left_anti").unionByName(picked(keyed.join(short, keys, "left_semi")))


def random_feed(
    df: DataFrame, n: int = FEED_SIZE, seed: int = 0, id_column: str = "review_id"
) -> DataFrame:
    """n rows chosen by seed, or all if there are no more; another seed gives another feed.

    Each task keeps its n first rows only.
    """
    own, order = unused(df, "_row"), unused(df, "_key")
    row = row_hash(df)
    key = seeded_key(F.coalesce(F.col(id_column).cast("string"), row.cast("string")), seed)
    return df.withColumns({order: key, own: row}).orderBy(order, id_column, own).limit(n).drop(order, own)


def first_rows(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """The first n rows in order, nulls first. Each task keeps its n first rows only."""
    own = unused(df, "_row")
    return df.withColumn(own, row_hash(df)).orderBy(order_by, own).limit(n).drop(own)


def _bracketed(sketches: DataFrame, rest: Column, margin: float) -> DataFrame:
    """Add `low` and `high`, keys between which the rank `rest` of the `n` rows of a sketch `s`
    lies, and `rows`, about how many rows are there."""
    steps = F.kll_sketch_get_quantile_bigint("s", F.array(*[F.lit(i / _STEPS) for i in range(_STEPS + 1)]))
    first = F.greatest(F.floor((rest / F.col("n") - margin) * _STEPS), F.lit(0)).cast("int")
    last = F.least(F.ceil(((rest + 1) / F.col("n") + margin) * _STEPS), F.lit(_STEPS)).cast("int")
    found = sketches.withColumns({"steps": steps, "first": first, "last": last})
    return found.withColumns({
        "low": F.col("steps")[F.col("first")], "high": F.col("steps")[F.col("last")],
        "rows": F.col("n") * (F.col("last") - F.col("first")) / _STEPS,
    }).select("g", "rank", "low", "high", F.when(F.col("low") < F.col("high"), F.col("rows")).alias("rows"))


def order_statistics(
    df: DataFrame,
    group: str,
    value: Column,
    key: Column,
    wanted: DataFrame | Callable[[DataFrame], DataFrame],
    margin: float = _MARGIN,
) -> DataFrame:
    """Exact values at chosen ranks of each group's ascending order: (group, rank, value).

    `wanted` has rows (group, 0-based rank), or makes them from the group sizes (group, `n`). `key`
    is a bigint that does not decrease as `value` grows.

    The first scan keeps a mergeable quantile sketch per group. Its bounds give a bracket of keys
    for each rank, and a second scan counts the values in the brackets and the rows below them, with
    map-side combine: what it finds is exact, and a rank that turns out to lie outside its bracket
    is sought again in one four times as wide. Brackets of millions of rows are narrowed by
    further sketches of their rows alone. No scan sorts or shuffles the data, and nothing comes to
    the driver.
    """
    base = df.select(F.col(group).alias("g"), value.alias("v"), key.alias("k"))
    base = base.filter(F.col("g").isNotNull() & F.col("k").isNotNull())

    def sketch(own: Column) -> Column:
        return F.kll_sketch_agg_bigint(own, F.lit(_SKETCH)).alias("s")

    sizes = pin(base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), sketch(F.col("k"))), "rank-sketches")
    targets = wanted(sizes.select(F.col("g").alias(group), "n")) if callable(wanted) else wanted
    targets = targets.select(F.col(group).alias("g"), "rank")
    possible = targets.join(sizes, "g").filter((F.col("rank") >= 0) & (F.col("rank") < F.col("n")))
    cells = pin(_bracketed(possible, F.col("rank"), margin), "rank-brackets")
    while (cells.agg(F.max("rows")).first()[0] or 0) > _COUNTED:
        inside = F.col("k") >= F.col("low")
        narrowed = base.join(cells, "g").filter(F.col("k") <= F.col("high")).groupBy("g", "rank").agg(
            F.count_if(~inside).alias("below"), F.count_if(inside).alias("n"), sketch(F.when(inside, F.col("k")))
        )
        rest = F.col("rank") - F.col("below")
        before, cells = cells, pin(
            _bracketed(narrowed.filter((rest >= 0) & (rest < F.col("n"))), rest, margin), "rank-brackets"
        )
        if cells.join(before, ["g", "rank", "low", "high"], "left_anti").isEmpty():
            break
    part = F.when(F.col("k") >= F.col("low"), F.col("v"))
    counts = base.join(cells.drop("rows"), "g").filter(F.col("k") <= F.col("high")).groupBy(
        "g", "rank", part.alias("part")
    ).agg(F.count(F.lit(1)).alias("n"))
    # The rows below the bracket, of the null part, come first.
    upto = F.sum("n").over(Window.partitionBy("g", "rank").orderBy("part"))
    found = counts.withColumn("upto", upto).filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")) & F.col("part").isNotNull()
    )
    found = pin(found.select(F.col("g").alias(group), "rank", F.col("part").alias("value")), "rank-values")
    missed = possible.select(F.col("g").alias(group), "rank").distinct().join(found, [group, "rank"], "left_anti")
    if margin >= 1 or missed.isEmpty():
        return found
    again = order_statistics(df, group, value, key, pin(missed, "missed-ranks"), 4 * margin)
    return found.unionByName(again)
