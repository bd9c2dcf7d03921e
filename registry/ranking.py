"""Row positions, batches, samples, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.operators import filters, insights as ins, ranking
from opinara.operators.model import stratified_split
from opinara.operators.prepare import training_rows
from registry.core import query, reviews, scored, table, with_views, without_ids
from registry.preparation import LABEL


def seeded(seed: int, column: str) -> str:
    """The digits that order seeded samples."""
    return f"substr(md5(concat('{seed}:', {column})), 1, 15)"


@query("rnk_1_row_index", """
SELECT doc_id, text, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_index
FROM documents""")
def rnk_1(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "source", "text")
    return ranking.with_row_index(df, order_by=["source", "doc_id"]).drop("source")


@query("rnk_1_read_order", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents""")
def rnk_1_read_order(spark, sf):
    """Positions in the stored table, whose rows lie by id: from file metadata, without a copy."""
    return ranking.with_row_index(table(spark, sf, "documents").select("doc_id"))


@query("rnk_2_read_order", """
SELECT batch_id, count(*) AS size, min(vec_id) AS first_id, max(vec_id) AS last_id
FROM (SELECT vec_id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 10) AS BIGINT)
      AS batch_id FROM embeddings) e GROUP BY 1""")
def rnk_2_read_order(spark, sf):
    """Batches of the stored table in read order."""
    batches = ranking.with_batches(table(spark, sf, "embeddings").select("vec_id"))
    return batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"),
    )


@query("rnk_2_batches", """
SELECT batch_id, count(*) AS size, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 10) AS BIGINT)
      AS batch_id FROM documents) d GROUP BY 1""")
def rnk_2(spark, sf):
    batches = ranking.with_batches(table(spark, sf, "documents").select("doc_id"), 10, ["doc_id"])
    return batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
    )


@query("rnk_3_number_in_batch", """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 10 + 1 AS BIGINT) AS position
FROM documents""")
def rnk_3(spark, sf):
    batches = ranking.with_batches(table(spark, sf, "documents").select("doc_id"), 10, ["doc_id"])
    return batches.select("doc_id", F.col("position").cast("bigint").alias("position"))


SAMPLE_SQL = f"""
SELECT Theme, sentiment, review_id, CAST(rn - 1 AS BIGINT) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY Theme, sentiment
      ORDER BY {seeded(0, "review_id")}, review_id) AS rn
      FROM choices) c WHERE rn <= 50"""


@query("smp_1_sample_per_group", with_views("choices", SAMPLE_SQL))
def smp_1(spark, sf):
    return ins.insight_samples(scored(spark, sf)).select(
        "Theme", "sentiment", "review_id", F.col("position").cast("bigint").alias("position")
    )


@query("smp_2_random_feed", with_views("exploded", f"""
SELECT 'Price and Value' AS theme, review_id FROM
 (SELECT review_id FROM scored WHERE review_id IN
   (SELECT review_id FROM exploded WHERE Theme = 'Price and Value')
  ORDER BY {seeded(3, "review_id")}, review_id LIMIT 20) s"""))
def smp_2(spark, sf):
    found = filters.drill_down(scored(spark, sf), "Price and Value")
    return ranking.random_feed(found, seed=3).select(
        F.lit("Price and Value").alias("theme"), "review_id"
    )


@query("smp_3_stratified_split", with_views("reviews", f"""
SELECT l.review_id, l.sentiment,
 row_number() OVER (PARTITION BY l.sentiment ORDER BY {seeded(2016, "l.review_id")}) <= s.size
 AS is_test
FROM labelled l JOIN sizes s ON l.sentiment = s.sentiment""",
    labelled=f"""SELECT * FROM (SELECT review_id, {LABEL} AS sentiment FROM reviews) r
 WHERE sentiment IS NOT NULL""",
    exact="""SELECT sentiment, total, count(*) * CAST(total AS DOUBLE) / n AS exact FROM labelled,
 (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS total FROM labelled) t
 GROUP BY sentiment, total, n""",
    sizes="""SELECT sentiment, floor(exact) + CASE WHEN
 row_number() OVER (ORDER BY exact - floor(exact) DESC, sentiment) <=
 total - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS size FROM exact"""))
def smp_3(spark, sf):
    rows = training_rows(reviews(spark, sf)).select("review_id", "sentiment")
    return stratified_split(rows)


@query("smp_1_without_ids", with_views("choices", """
SELECT Theme, sentiment, least(50, count(*)) AS sample_size
FROM (SELECT DISTINCT k, Theme, unnest([predicted_sentiment, 'All']) AS sentiment FROM exploded) c
GROUP BY 1, 2"""))
def smp_1_without_ids(spark, sf):
    """Sizes of the samples where ids are missing or repeated."""
    samples = ins.insight_samples(without_ids(scored(spark, sf)))
    return samples.groupBy("Theme", "sentiment").agg(F.count(F.lit(1)).alias("sample_size"))


@query("jon_5_without_ids", with_views("choices", """
SELECT Theme, sentiment, CASE WHEN count(*) > 7 THEN 2 ELSE 1 END AS cited
FROM (SELECT DISTINCT k, Theme, unnest([predicted_sentiment, 'All']) AS sentiment FROM exploded) c
GROUP BY 1, 2"""))
def jon_5_without_ids(spark, sf):
    """Cited reviews of each insight where ids are missing or repeated: numbers 7 and 0, if there are so many."""
    _, cited = ins.insights(
        without_ids(scored(spark, sf)), lambda prompt: "INSIGHTS:\n- a\nRELEVANT_IDS:\n[7, 0, 7, 99]", parallel_calls=8
    )
    return cited.groupBy("Theme", "sentiment").agg(F.count(F.lit(1)).cast("int").alias("cited"))


@query("top_2_without_ids", with_views("scored", """
SELECT count(*) AS rows, count(review_id) AS with_id FROM
 (SELECT CASE WHEN k % 3 > 0 THEN 'c' END AS review_id FROM scored ORDER BY review_id NULLS FIRST LIMIT 50) s"""))
def top_2_without_ids(spark, sf):
    df = without_ids(scored(spark, sf)).select("review_id", "clean_text", "k")
    return ranking.first_rows(df, 50, "review_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("review_id").alias("with_id")
    )


@query("smp_3_many_classes", """
SELECT count(*) AS documents, count(DISTINCT doc_id) AS classes,
 CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_rows FROM documents""")
def smp_3_many_classes(spark, sf):
    """A split with a class per document: no number of classes is too large."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("sentiment"))
    split = stratified_split(rows, id_column="doc_id")
    return split.agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("sentiment").alias("classes"),
        F.count_if("is_test").alias("test_rows"),
    )
