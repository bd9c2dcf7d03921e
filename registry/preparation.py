"""Projections, filters, mixed-sentiment rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions.labels import sentiment_from_stars
from opinara.functions import mixed
from opinara.operators import filters, prepare
from opinara.operators.model import probability_columns
from opinara.operators.themes import explode_themes
from registry.core import (
    CLOSE_SQL, as_text, contrast_sql, polarity_sql, query, reviews, rounded, scored, table,
    with_views, without_ids,
)

LABEL = """CASE WHEN stars IS NULL OR stars = 'nan' THEN 'negative'
 WHEN try_cast(stars AS DOUBLE) >= 4 THEN 'positive'
 WHEN try_cast(stars AS DOUBLE) = 3 THEN 'neutral/mixed'
 WHEN try_cast(stars AS DOUBLE) IS NOT NULL THEN 'negative' END"""


@query("prj_1_review_id", """
SELECT concat('review_', CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR))
 AS review_id, conv_id, turn, text FROM conversations""")
def prj_1(spark, sf):
    return prepare.with_review_id(table(spark, sf, "conversations"), ["conv_id", "turn"]).select(
        "review_id", "conv_id", "turn", "text"
    )


@query("prj_2_clean_text", "SELECT doc_id, lower(coalesce(text, '')) AS clean_text FROM documents")
def prj_2(spark, sf):
    return prepare.with_clean_text(table(spark, sf, "documents")).select("doc_id", "clean_text")


@query("prj_3_training_text", with_views("reviews", """
SELECT review_id, coalesce(text, '') AS clean_text FROM reviews"""))
def prj_3(spark, sf):
    given = reviews(spark, sf).withColumn("clean_text", F.coalesce("text", F.lit("")))
    return prepare.with_clean_text(given, keep_existing=True).select("review_id", "clean_text")


@query("prj_4_three_class_label", with_views("reviews", f"""
SELECT review_id, stars, {LABEL} AS sentiment FROM reviews"""))
def prj_4(spark, sf):
    df = reviews(spark, sf)
    return df.select("review_id", "stars", sentiment_from_stars(F.col("stars")).alias("sentiment"))


@query("prj_5_binary_label", with_views("reviews", """
SELECT review_id, stars, CASE WHEN stars = 'nan' THEN NULL
 WHEN try_cast(stars AS DOUBLE) >= 4 THEN 'positive'
 WHEN try_cast(stars AS DOUBLE) <= 2 THEN 'negative' END AS sentiment FROM reviews"""))
def prj_5(spark, sf):
    label = sentiment_from_stars(F.col("stars"), "binary")
    return reviews(spark, sf).select("review_id", "stars", label.alias("sentiment"))


@query("prj_6_given_label", with_views("scored", """
SELECT review_id, predicted_sentiment AS sentiment FROM scored"""))
def prj_6(spark, sf):
    given = scored(spark, sf).withColumn("sentiment", F.col("predicted_sentiment"))
    return prepare.with_sentiment(given).select("review_id", "sentiment")


@query("prj_7_probability_columns", with_views("scored", """
SELECT review_id, round(prob_negative, 6) AS prob_negative, round(prob_neutral, 6) AS prob_middle,
 round(prob_positive, 6) AS prob_positive, round(confidence, 6) AS confidence,
 CASE WHEN prob_negative >= prob_neutral AND prob_negative >= prob_positive THEN 'negative'
      WHEN prob_neutral >= prob_positive THEN 'neutral/mixed' ELSE 'positive' END
 AS predicted_sentiment FROM scored"""))
def prj_7(spark, sf):
    df = scored(spark, sf)
    classes = ["negative", "neutral/mixed", "positive"]
    array = F.array(*[F.col(f"prob_{c}") for c in classes])
    plain = df.select("review_id", array.alias("p"))
    out = probability_columns(plain, F.col("p"), classes).drop("p")
    out = out.withColumnRenamed("prob_neutral/mixed", "prob_middle")
    return rounded(out, "prob_negative", "prob_middle", "prob_positive", "confidence")


@query("prj_8_raw_output", with_views("scored", """
SELECT CAST(date AS VARCHAR) AS date, predicted_sentiment, round(confidence, 6) AS confidence,
 is_mixed, themes, clean_text FROM scored ORDER BY review_id LIMIT 50"""))
def prj_8(spark, sf):
    return rounded(as_text(prepare.raw_view(scored(spark, sf)), "date"), "confidence")


@query("prj_9_parse_date", with_views("reviews", """
SELECT review_id, CAST(date AS VARCHAR) AS date FROM reviews"""))
def prj_9(spark, sf):
    text = F.coalesce(F.col("date").cast("string"), F.lit("unknown"))
    df = prepare.parse_dates(reviews(spark, sf).withColumn("date", text), on_invalid="null")
    return as_text(df.select("review_id", "date"), "date")


@query("prj_9_parse_date_all_or_nothing", with_views("reviews", """
SELECT review_id, coalesce(CAST(date AS VARCHAR), 'unknown') AS date FROM reviews"""))
def prj_9_disable(spark, sf):
    text = F.coalesce(F.col("date").cast("string"), F.lit("unknown"))
    df = reviews(spark, sf).withColumn("date", text)
    return as_text(prepare.parse_dates(df, on_invalid="disable").select("review_id", "date"), "date")


@query("flt_1_date_range", with_views("reviews", """
SELECT review_id, CAST(date AS VARCHAR) AS date FROM reviews
WHERE CAST(date AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-06-30'"""))
def flt_1(spark, sf):
    kept = filters.date_range(reviews(spark, sf), "1996-03-01", "1998-06-30")
    return as_text(kept.select("review_id", "date"), "date")


@query("flt_1_date_range_on_table", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'""")
def flt_1_table(spark, sf):
    kept = filters.date_range(table(spark, sf, "orders"), "1996-03-01", "1996-03-31", "o_orderdate")
    return kept.select("o_orderkey", "o_custkey", "o_totalprice")


@query("flt_1_whole_range", with_views("reviews", """
SELECT review_id, CAST(date AS VARCHAR) AS date FROM reviews WHERE date IS NOT NULL"""))
def flt_1_whole(spark, sf):
    return as_text(filters.date_range(reviews(spark, sf)).select("review_id", "date"), "date")


@query("flt_2_invalid_range", with_views("reviews", "SELECT review_id FROM reviews"))
def flt_2(spark, sf):
    df = reviews(spark, sf)
    return filters.date_range(df, "1998-01-02", "1998-01-01", on_invalid="ignore").select("review_id")


@query("flt_3_labelled", with_views("reviews", f"""
SELECT review_id, sentiment, lower(coalesce(text, '')) AS clean_text
FROM (SELECT *, {LABEL} AS sentiment FROM reviews) r WHERE sentiment IS NOT NULL"""))
def flt_3(spark, sf):
    return prepare.training_rows(reviews(spark, sf)).select("review_id", "sentiment", "clean_text")


@query("flt_4_middle_class", with_views("scored", """
SELECT review_id, predicted_sentiment FROM scored
WHERE predicted_sentiment IN ('neutral', 'neutral/mixed')"""))
def flt_4(spark, sf):
    return filters.middle_class(scored(spark, sf)).select("review_id", "predicted_sentiment")


@query("flt_5_without_failed", with_views("scored", """
SELECT review_id, themes FROM scored WHERE themes IS NULL OR NOT contains(themes, 'FAILED')"""))
def flt_5(spark, sf):
    return filters.without_failed(scored(spark, sf)).select("review_id", "themes")


@query("flt_6_already_themed", with_views("scored", """
SELECT count(*) > 0 AS already_themed FROM scored
WHERE themes IS NULL OR NOT contains(themes, 'FAILED')"""))
def flt_6(spark, sf):
    return filters.already_themed(scored(spark, sf))


@query("flt_7_marker_themes", with_views("exploded", "SELECT review_id, Theme FROM exploded"))
def flt_7(spark, sf):
    return explode_themes(scored(spark, sf)).select("review_id", "Theme")


@query("flt_8_missing_prediction", with_views("exploded", """
SELECT review_id, Theme FROM exploded WHERE text IS NOT NULL"""))
def flt_8(spark, sf):
    sentiment = F.when(F.col("text").isNotNull(), F.col("predicted_sentiment"))
    df = scored(spark, sf).withColumn("predicted_sentiment", sentiment)
    return explode_themes(df).select("review_id", "Theme")


@query("flt_9_one_theme", with_views("exploded", """
SELECT review_id, predicted_sentiment FROM exploded WHERE Theme = 'Speed of Service'"""))
def flt_9(spark, sf):
    kept = filters.of_theme(explode_themes(scored(spark, sf)), "Speed of Service")
    return kept.select("review_id", "predicted_sentiment")


@query("flt_10_sentiment_choice", with_views("exploded", """
SELECT 'negative' AS choice, review_id, Theme FROM exploded WHERE predicted_sentiment = 'negative'
UNION ALL SELECT 'All', review_id, Theme FROM exploded"""))
def flt_10(spark, sf):
    exploded = explode_themes(scored(spark, sf))
    parts = [
        filters.of_sentiment(exploded, c).select(F.lit(c).alias("choice"), "review_id", "Theme")
        for c in ("negative", "All")
    ]
    return parts[0].unionByName(parts[1])


@query("flt_11_sampled_text", with_views("reviews", """
SELECT review_id, text AS clean_text FROM reviews WHERE text IS NOT NULL"""))
def flt_11(spark, sf):
    df = reviews(spark, sf).withColumnRenamed("text", "clean_text")
    return filters.sampled_text(df).select("review_id", "clean_text")


@query("jon_1_drill_down", with_views("exploded", """
SELECT review_id, predicted_sentiment, clean_text FROM scored WHERE review_id IN
 (SELECT review_id FROM exploded WHERE Theme = 'Speed of Service'
  AND predicted_sentiment = 'positive')"""))
def jon_1(spark, sf):
    found = filters.drill_down(scored(spark, sf), "Speed of Service", "positive")
    return found.select("review_id", "predicted_sentiment", "clean_text")


@query("set_5_distinct_matches", with_views("exploded", """
SELECT review_id, clean_text FROM scored WHERE review_id IN (SELECT review_id FROM exploded)"""))
def set_5(spark, sf):
    df = scored(spark, sf)
    return filters.reviews_matching(df, explode_themes(df)).select("review_id", "clean_text")


@query("mix_1_contrast", with_views("reviews", f"""
SELECT review_id, {contrast_sql("coalesce(text, '')")} AS has_contrast FROM reviews"""))
def mix_1(spark, sf):
    return reviews(spark, sf).select("review_id", mixed.has_contrast(F.col("text")).alias("has_contrast"))


@query("mix_1_contrast_documents", f"""
SELECT doc_id, {contrast_sql("text")} AS has_contrast FROM documents""")
def mix_1_documents(spark, sf):
    df = table(spark, sf, "documents")
    return df.select("doc_id", mixed.has_contrast(F.col("text")).alias("has_contrast"))


@query("mix_2_cue_tokens", """
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z'']+')) AS n,
 array_to_string(regexp_extract_all(lower(text), '[a-z'']+'), ' ') AS words FROM documents""")
def mix_2(spark, sf):
    words = mixed.cue_tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(words).cast("bigint").alias("n"), F.array_join(words, " ").alias("words")
    )


@query("mix_3_dual_polarity", with_views("reviews", f"""
SELECT review_id, {polarity_sql("coalesce(text, '')")} AS dual FROM reviews"""))
def mix_3(spark, sf):
    return reviews(spark, sf).select("review_id", mixed.has_dual_polarity(F.col("text")).alias("dual"))


@query("mix_4_close_probabilities", with_views("scored", f"""
SELECT review_id, {CLOSE_SQL} AS close FROM scored"""))
def mix_4(spark, sf):
    close = mixed.probabilities_close(F.col("prob_positive"), F.col("prob_negative"))
    return scored(spark, sf).select("review_id", close.alias("close"))


@query("mix_5_mixed_rule", with_views("scored", f"""
SELECT review_id, {contrast_sql("clean_text")}
 AND ({CLOSE_SQL} OR {polarity_sql("clean_text")}) AS mixed FROM scored"""))
def mix_5(spark, sf):
    rule = mixed.mixed_rule(F.col("clean_text"), F.col("prob_positive"), F.col("prob_negative"))
    return scored(spark, sf).select("review_id", rule.alias("mixed"))


@query("mix_6_is_mixed", with_views("scored", """
SELECT review_id, predicted_sentiment, is_mixed FROM scored"""))
def mix_6(spark, sf):
    return scored(spark, sf).select("review_id", "predicted_sentiment", "is_mixed")


@query("set_2_cue_overlap", """
SELECT doc_id, list_has_any(regexp_extract_all(lower(text), '[a-z'']+'), ['the', 'und', 'les'])
 AS hit FROM documents""")
def set_2(spark, sf):
    words = mixed.cue_tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", mixed.has_any(words, ("the", "und", "les")).alias("hit")
    )


def _text_dates(spark, sf, pattern):
    return reviews(spark, sf).withColumn("date", F.date_format("date", pattern))


@query("prj_9_month_first", with_views("reviews", """
SELECT review_id, CAST(CAST(date AS DATE) AS VARCHAR) AS date FROM reviews"""))
def prj_9_month_first(spark, sf):
    dates = prepare.parse_dates(_text_dates(spark, sf, "M/d/yyyy")).select("review_id", F.to_date("date").alias("date"))
    return as_text(dates, "date")


@query("prj_9_day_and_name", with_views("reviews", """
SELECT review_id, CAST(CAST(date AS DATE) AS VARCHAR) AS date FROM reviews"""))
def prj_9_day_and_name(spark, sf):
    dates = prepare.parse_dates(_text_dates(spark, sf, "d MMM yyyy")).select("review_id", F.to_date("date").alias("date"))
    return as_text(dates, "date")


@query("prj_8_without_ids", with_views("scored", """
SELECT count(*) AS rows FROM (SELECT k FROM scored LIMIT 50) s"""))
def prj_8_without_ids(spark, sf):
    return prepare.raw_view(without_ids(scored(spark, sf))).agg(F.count(F.lit(1)).alias("rows"))
