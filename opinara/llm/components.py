"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opinara.llm.common import join_groups
from opinara.session import pin


def _mark(links: DataFrame) -> tuple:
    """Tells apart two sets of links."""
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("low", "high")).alias("x")
    ).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; a component is named by its smallest node.

    `links` has two columns of long numbers. Each step points nodes to the smallest one they
    know of, and the number of steps grows with the logarithm of the longest path. Hubs are
    met by `join_groups`, so no task gets all links of one. Every step is written, none is
    collected.
    """
    a, b = links.columns
    links = pin(
        links.filter(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct(),
        "links",
    )
    mark = _mark(links)
    while mark[0]:
        both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
            links.select(F.col("high").alias("u"), F.col("low").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_groups(both, pin(least, "least"), "u", "n", 2 * mark[0]).filter("v > u AND v <> m")
        large = pin(large.select(F.col("m").alias("low"), F.col("v").alias("high")).distinct(), "large-star")
        least = large.groupBy("high").agg(F.min("low").alias("m"), F.count(F.lit(1)).alias("n"))
        least = pin(least, "least")
        known = join_groups(large, least, "high", "n", large.count())
        small = known.filter("low <> m").select(F.col("m").alias("low"), F.col("low").alias("high"))
        small = small.unionByName(least.select(F.col("m").alias("low"), "high"))
        links = pin(small.distinct(), "small-star")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )
