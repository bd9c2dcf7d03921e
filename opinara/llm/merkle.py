"""Merkle manifest of a dataset by slot pivots.

Leaves are digests of rows, in a tree per group, whose tops are leaves of one tree above. A level
is one aggregation: conditional aggregates spread the children of a parent into FANOUT columns.
All columns joined and hashed are the parent; all but a child's own column are its siblings.
Levels go up by one shuffle of digests each and come down by joins of parents with parents, so
that a proof meets its leaf only where the leaf's own run is unpacked. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from opinara.llm.common import join_groups
from opinara.operators.ranking import with_row_index
from opinara.session import pin

FANOUT = 16

_SLOTS = [f"s{i}" for i in range(FANOUT)]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, joined."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 length, a colon and itself, or `-` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row."""
    return digest(*[field(v) for v in values])


@dataclass(frozen=True)
class Tree:
    """Trees over runs of FANOUT nodes.

    `nodes`: the lowest level, with `tree`, `place`, `n` (nodes of the tree at this level) and
    `digest`. `levels`: per level above, one row per run: `tree`, `place`, `n` (runs of the tree),
    `s0` to `s15` (its children's digests; at the lowest level structs with all columns of `nodes`
    that the caller asked for) and `digest`. `tops`: (tree, top), one row per tree.
    """

    nodes: DataFrame
    levels: list[DataFrame]
    tops: DataFrame


def _pivoted(nodes: DataFrame, child: Column) -> DataFrame:
    """One row per run of FANOUT nodes, with a column per slot."""
    slot = F.col("place") % FANOUT
    parent = F.floor(F.col("place") / FANOUT).alias("place")
    spread = [F.max(F.when(slot == i, child)).alias(name) for i, name in enumerate(_SLOTS)]
    runs = F.ceil(F.col("n") / FANOUT).alias("n")
    return nodes.groupBy("tree", runs, parent).agg(*spread)


def _joined(own: list[Column]) -> Column:
    """Digests joined; empty slots are left out."""
    return F.concat(F.lit(""), *[F.coalesce(c, F.lit("")) for c in own])


def grow(nodes: DataFrame, largest: int, carried: list[str] = []) -> Tree:
    """Trees over `nodes` (tree, place, n, digest); `largest` is the number of nodes of the largest.

    The number of levels grows with the logarithm of that. A tree is finished as soon as it has a
    single node; a last run of one node is hashed like others.
    """
    levels, tops = [], [nodes.filter("n = 1").select("tree", F.col("digest").alias("top"))]
    now = nodes
    while largest > 1:
        lowest = not levels
        child = F.struct("digest", *carried) if lowest else F.col("digest")
        level = _pivoted(now.filter("n > 1"), child)
        own = [F.col(s)["digest"] if lowest else F.col(s) for s in _SLOTS]
        level = pin(level.withColumn("digest", digest(_joined(own))), "tree-level")
        levels.append(level)
        tops.append(level.filter("n = 1").select("tree", F.col("digest").alias("top")))
        now, largest = level.select("tree", "place", "n", "digest"), -(-largest // FANOUT)
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return Tree(nodes, levels, pin(found, "tree-tops"))


def _unpacked(level: DataFrame, given: list[str], lowest: bool) -> DataFrame:
    """One row per child of the runs: `tree`, `place`, `child`, `path` from the child up, and `given`."""
    own = [F.col(s)["digest"] if lowest else F.col(s) for s in _SLOTS]
    children = []
    for i, name in enumerate(_SLOTS):
        step = F.struct(_joined(own[:i]).alias("left"), _joined(own[i + 1:]).alias("right"))
        children.append(F.when(own[i].isNotNull(), F.struct(
            F.lit(i).alias("slot"), F.col(name).alias("child"), F.concat(F.array(step), F.col("path")).alias("path"),
        )))
    rows = level.select("tree", *given, F.col("place").alias("run"), F.explode(F.array(*children)).alias("c"))
    rows = rows.filter("c IS NOT NULL")
    return rows.select("tree", (F.col("run") * FANOUT + F.col("c.slot")).alias("place"), "c.child", "c.path", *given)


def paths(tree: Tree, above: DataFrame, carried: list[str] = []) -> DataFrame:
    """Per lowest node `tree`, `digest`, the columns carried, `path` and what `above` has of its tree.

    A path is an array of (left, right): the siblings of each step up, joined. `above` has `tree`,
    the `path` of its top, and any other columns.
    """
    given = [c for c in above.columns if c not in ("tree", "path")]
    wanted = ["tree", "digest", *carried, "path", *given]
    upper = None
    for level in reversed(tree.levels):
        with_path = level.filter("n = 1").join(above, "tree")
        if upper is not None:
            below = level.filter("n > 1").join(upper, ["tree", "place"])
            with_path = with_path.unionByName(below)
        lowest = level is tree.levels[0]
        upper = _unpacked(with_path, given, lowest)
        if not lowest:
            upper = upper.drop("child")
    single = tree.nodes.filter("n = 1").join(above, "tree").select(*wanted)
    if upper is None:
        return single
    return upper.select("tree", "child.*", "path", *given).select(*wanted).unionByName(single)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, start, lambda own, step: digest(step["left"], own, step["right"]))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up, left to right."""
    every = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return digest(F.array_join(every, ""))


def manifest(
    df: DataFrame,
    columns: list[str],
    now: dict[str, Column] | None = None,
    id_column: str = "doc_id",
    group_column: str = "source",
) -> DataFrame:
    """Per row its id, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root` and `verified`.

    A leaf is the digest of `columns`. The leaves of a group stand by ascending id; its top is
    `subroot`. Groups stand by name, bytewise, and their tops are the leaves of the tree with the
    top `root`. `folded_root` is what the row as it is `now` (expressions in place of columns,
    default: unchanged) gives with the siblings of the proof, `verified` whether that is the root.

    Null values have a mark of their own, so null and empty texts differ; a null group and a null
    id come first. Rows with one id stand by their leaves, so equal rows have one proof each. A
    group of one row has its leaf as subroot, and a single group its subroot as root; a proof
    without siblings is the digest of the empty text. An empty table gives no rows. Texts of any
    length are hashed where they are read; only digests are shuffled. No column of `df` but those
    named is read, so others may have any name.
    """
    held = [F.col(f"`{c}`") for c in columns]
    changed = [(now or {}).get(c, F.col(f"`{c}`")) for c in columns]
    # "-" is below "=", so the null group is first and the others keep their order.
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_column}`").cast("string")), F.lit("-"))
    rows = df.select(
        group.alias("key"), F.col(f"`{id_column}`").cast("bigint").alias("id"), leaf(held).alias("digest"),
        (leaf(changed) if now else F.lit(None).cast("string")).alias("now"),
    )
    rows = rows.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now")))
    rows = with_row_index(rows, "at", ["key", "id", "digest"])
    groups = pin(
        rows.groupBy("key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size")), "manifest-groups"
    )
    most = groups.agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("groups"), F.sum("size").alias("rows"))
    most = most.first()
    # A group's first position is its number: unique, and in the order of the names.
    placed = join_groups(rows, groups, "key", "size", most["rows"] or 0).select(
        F.col("first").alias("tree"), (F.col("at") - F.col("first")).alias("place"), F.col("size").alias("n"),
        "digest", "id", "now",
    )
    carried = ["id", "now"]
    lower = grow(pin(placed, "manifest-leaves"), most["largest"] or 0, carried)
    n_groups = F.lit(most["groups"]).cast("bigint")
    tops = with_row_index(lower.tops, "place", ["tree"]).select(
        F.lit(0).cast("bigint").alias("tree"), "place", n_groups.alias("n"), F.col("top").alias("digest"),
        F.col("tree").alias("of"),
    )
    upper = grow(pin(tops, "manifest-tops"), most["groups"], ["of"])
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    roots = upper.tops.select("tree", F.col("top").alias("root"), nothing.alias("path"))
    of_groups = paths(upper, roots, ["of"]).select(
        F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "path"
    )
    found = paths(lower, pin(of_groups, "manifest-group-paths"), carried)
    root = folded(F.coalesce("now", "digest"), F.col("path"))
    return found.select(
        F.col("id").alias(id_column), F.col("digest").alias("leaf"), "subroot", "root",
        proof(F.col("path")).alias("proof_sha256"), root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql(
    table: str, columns: list[str], id_column: str, group_column: str, changed: str, now: str, every: int,
    levels: int = 6,
) -> str:
    """DuckDB SQL for `manifest`, the column `changed` being `now` where `every` divides the id's CRC-32.

    `levels` of FANOUT, so 16 million rows, bound the size of a group and the number of groups. A level leaves a finished
    tree as it is, without siblings.
    """

    def leaf_sql(of: dict[str, str]) -> str:
        fields = [
            f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"
            for v in (of.get(c, c) for c in columns)
        ]
        return f"sha256({' || '.join(fields)})"

    def up(name: str, first: str, keys: str) -> tuple[str, str, str]:
        """Views of the nodes of each level, of the steps between, and the joins of a node's steps."""
        views, joins = [f"{name}0 AS ({first})"], []
        for i in range(levels):
            run = f"PARTITION BY {keys}, p // {FANOUT} ORDER BY p"
            views.append(
                f"{name}s{i} AS MATERIALIZED (SELECT {keys}, p, coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN"
                f" UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l{i}, coalesce(string_agg(d, '') OVER ({run} ROWS"
                f" BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r{i}, n FROM {name}{i})"
            )
            views.append(
                f"{name}{i + 1} AS MATERIALIZED (SELECT {keys}, p // {FANOUT} AS p, CASE WHEN n = 1 THEN min(d) ELSE"
                f" sha256(string_agg(d, '' ORDER BY p)) END AS d, (n + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{i}"
                f" GROUP BY {keys}, p // {FANOUT}, n)"
            )
            joins.append(
                f"JOIN {name}s{i} ON {name}s{i}.{keys} = x.{keys} AND {name}s{i}.p = x.p // {FANOUT ** i}"
            )
        return ", ".join(views), " ".join(joins), name

    def steps(name: str, start: str) -> tuple[str, str]:
        """The siblings of a node's path, joined, and the digest that `start` gives with them."""
        siblings = " || ".join(f"l{i} || r{i}" for i in range(levels))
        own = start
        fold = []
        for i in range(levels):
            fold.append(f"CASE WHEN {name}s{i}.n = 1 THEN {own} ELSE sha256(l{i} || {own} || r{i}) END AS f{i}")
            own = f"f{i}"
        return siblings, ", ".join(fold)

    lower, lower_joins, _ = up("a", "SELECT g, p, d, n FROM placed", "g")
    upper, upper_joins, _ = up("b", f"SELECT 0 AS z, g AS p, d, (SELECT count(*) FROM a{levels}) AS n FROM a{levels}", "z")
    lower_siblings, lower_fold = steps("a", "x.now")
    upper_siblings, upper_fold = steps("b", "x.subfold")
    return f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) r(i) UNION ALL
 SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
marked AS (SELECT *, coalesce(xor(list_reduce(list_transform(string_split(CAST({id_column} AS VARCHAR), ''),
 lambda c: CAST(ascii(c) AS UBIGINT)), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1]),
 4294967295::UBIGINT), 4294967295::UBIGINT) % {every} = 0, false) AS touched FROM {table}, crc),
leaves AS (SELECT {id_column} AS id, {group_column} AS source_key, {leaf_sql({})} AS d, CASE WHEN touched THEN
 {leaf_sql({changed: now})} ELSE {leaf_sql({})} END AS now FROM marked),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source_key NULLS FIRST) - 1 AS g, row_number() OVER
 (PARTITION BY source_key ORDER BY id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY source_key) AS n FROM leaves),
{lower}, {upper},
low AS (SELECT x.id, x.g, x.d, {lower_siblings} AS siblings, {lower_fold}
 FROM placed x {lower_joins}),
high AS (SELECT low.*, f{levels - 1} AS subfold FROM low),
x AS (SELECT id, g AS p, 0 AS z, d, siblings, subfold FROM high),
done AS (SELECT x.id, x.d, x.p, siblings || {upper_siblings} AS siblings, {upper_fold} FROM x {upper_joins})
SELECT id AS {id_column}, done.d AS leaf, s.d AS subroot, r.d AS root, sha256(siblings) AS proof_sha256,
 f{levels - 1} AS folded_root, f{levels - 1} = r.d AS verified
FROM done JOIN a{levels} s ON s.g = done.p, b{levels} r"""
