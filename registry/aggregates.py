"""Aggregates and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.operators import analytics as a
from opinara.operators.model import accuracy
from opinara.operators.prepare import training_rows
from opinara.operators.ranking import first_rows
from opinara.operators.themes import explode_themes, failed_count
from registry.core import MORE_VIEWS, as_text, classed, query, rounded, scored, with_views
from registry.preparation import LABEL

_CROSSTAB = """
SELECT Theme, CAST(count(*) FILTER (predicted_sentiment = 'positive') AS BIGINT) AS positive,
 CAST(count(*) FILTER (predicted_sentiment = 'negative') AS BIGINT) AS negative,
 CAST(count(*) FILTER (predicted_sentiment = 'neutral/mixed') AS BIGINT) AS middle,
 count(*) AS "Total" FROM exploded GROUP BY Theme"""
_TOTAL = """
SELECT 'Total Raw Reviews' AS Theme, count(*) FILTER (predicted_sentiment = 'positive') AS positive,
 count(*) FILTER (predicted_sentiment = 'negative') AS negative,
 count(*) FILTER (predicted_sentiment = 'neutral/mixed') AS middle, count(*) AS "Total"
FROM scored WHERE predicted_sentiment IN (SELECT predicted_sentiment FROM exploded)"""
_PERCENT = """
SELECT Theme, positive, CAST(round_even(positive / "Total" * 100, 1) AS DOUBLE) AS positive_pct,
 negative, CAST(round_even(negative / "Total" * 100, 1) AS DOUBLE) AS negative_pct,
 middle, CAST(round_even(middle / "Total" * 100, 1) AS DOUBLE) AS middle_pct, "Total" AS total
FROM ((SELECT * FROM crosstab) UNION ALL (SELECT * FROM total)) t"""


def _plain_names(df):
    """Names without signs, so that both engines write them alike."""
    return df.withColumnsRenamed(
        {
            "positive (%)": "positive_pct", "negative (%)": "negative_pct",
            "neutral/mixed (%)": "middle_pct", "neutral/mixed": "middle", "Total": "total",
        }
    )


@query("agg_1_key_figures", with_views("scored", """
SELECT count(*) AS reviews, round(avg(confidence), 6) AS avg_confidence,
 round(100.0 * sum(CASE WHEN is_mixed THEN 1 ELSE 0 END) / count(*), 6) AS mixed_rate
FROM scored"""))
def agg_1(spark, sf):
    return rounded(a.key_figures(scored(spark, sf)), "avg_confidence", "mixed_rate")


@query("agg_2_sentiment_counts", with_views("scored", """
SELECT predicted_sentiment AS sentiment, count(*) AS count FROM scored GROUP BY 1"""))
def agg_2(spark, sf):
    return a.sentiment_counts(scored(spark, sf))


@query("agg_3_sentiment_shares", with_views("scored", """
SELECT predicted_sentiment AS sentiment, count(*) AS count,
 round(count(*) / CAST((SELECT count(*) FROM scored) AS DOUBLE), 6) AS share
FROM scored GROUP BY 1"""))
def agg_3(spark, sf):
    return rounded(a.sentiment_shares(scored(spark, sf)), "share")


_QUARTILE = """
SELECT sentiment, q, (1 - part) * max(CASE WHEN i = low THEN confidence END)
 + part * max(CASE WHEN i = high THEN confidence END) AS value
FROM (SELECT r.*, floor(h) AS low, least(floor(h) + 1, n - 1) AS high, h - floor(h) AS part
      FROM (SELECT r.*, q, least(greatest(n * q / 4.0 - 0.5, 0), n - 1) AS h
            FROM ranked r, (SELECT unnest([1, 2, 3]) AS q) qs) r) x
GROUP BY sentiment, q, part"""


@query("agg_4_confidence_boxes", with_views("scored", """
SELECT b.sentiment, round(min(confidence), 6) AS min,
 round(least(q1, min(confidence) FILTER (confidence >= q1 - 1.5 * (q3 - q1))), 6) AS lower_fence,
 round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 round(greatest(q3, max(confidence) FILTER (confidence <= q3 + 1.5 * (q3 - q1))), 6) AS upper_fence,
 round(max(confidence), 6) AS max,
 count(*) FILTER (confidence < q1 - 1.5 * (q3 - q1) OR confidence > q3 + 1.5 * (q3 - q1))
 AS outliers
FROM ranked r JOIN boxes b ON r.sentiment = b.sentiment GROUP BY b.sentiment, q1, median, q3""",
    ranked="""SELECT predicted_sentiment AS sentiment, confidence,
 row_number() OVER (PARTITION BY predicted_sentiment ORDER BY confidence) - 1 AS i,
 count(*) OVER (PARTITION BY predicted_sentiment) AS n FROM scored""",
    quartiles=_QUARTILE,
    boxes="""SELECT sentiment, max(CASE WHEN q = 1 THEN value END) AS q1,
 max(CASE WHEN q = 2 THEN value END) AS median, max(CASE WHEN q = 3 THEN value END) AS q3
 FROM quartiles GROUP BY sentiment"""))
def agg_4(spark, sf):
    boxes = a.confidence_boxes(scored(spark, sf))
    return rounded(boxes, "min", "lower_fence", "q1", "median", "q3", "upper_fence", "max")


@query("agg_5_monthly_sentiment", with_views("scored", """
SELECT CAST(last_day(date) AS VARCHAR) AS date, predicted_sentiment, count(*) AS count
FROM scored WHERE date IS NOT NULL GROUP BY 1, 2"""))
def agg_5(spark, sf):
    return as_text(a.monthly_sentiment(scored(spark, sf)), "date")


@query("agg_5_monthly_labels", with_views("reviews", f"""
SELECT CAST(last_day(date) AS VARCHAR) AS date, {LABEL} AS predicted_sentiment, count(*) AS count
FROM reviews WHERE date IS NOT NULL AND {LABEL} IS NOT NULL GROUP BY 1, 2"""))
def agg_5_labels(spark, sf):
    from registry.core import reviews

    labelled = training_rows(reviews(spark, sf))
    return as_text(
        a.monthly_sentiment(labelled.withColumnRenamed("sentiment", "predicted_sentiment")), "date"
    )


@query("agg_7_theme_counts", with_views("exploded", """
SELECT Theme, count(*) AS count FROM exploded GROUP BY 1"""))
def agg_7(spark, sf):
    return a.theme_counts(explode_themes(scored(spark, sf)))


@query("agg_8_theme_sentiment", with_views("exploded", """
SELECT Theme, predicted_sentiment, count(*) AS count FROM exploded GROUP BY 1, 2"""))
def agg_8(spark, sf):
    return a.theme_sentiment(explode_themes(scored(spark, sf)))


@query("agg_9_crosstab", with_views("exploded", """
SELECT Theme, positive, negative, middle FROM crosstab""", crosstab=_CROSSTAB))
def agg_9(spark, sf):
    return _plain_names(a.crosstab(explode_themes(scored(spark, sf)))).drop("total")


@query("agg_10_crosstab_totals", with_views("exploded", """
SELECT Theme, "Total" AS total FROM crosstab""", crosstab=_CROSSTAB))
def agg_10(spark, sf):
    return _plain_names(a.crosstab(explode_themes(scored(spark, sf)))).select("Theme", "total")


@query("agg_11_total_row", with_views("exploded", """
SELECT Theme, positive, negative, middle, "Total" AS total FROM total""", total=_TOTAL))
def agg_11(spark, sf):
    df = scored(spark, sf)
    return _plain_names(a.total_row(a.crosstab(explode_themes(df)), df))


@query("set_4_table_with_total_row", with_views("exploded", """
SELECT Theme, positive, negative, middle, "Total" AS total
FROM ((SELECT * FROM crosstab) UNION ALL (SELECT * FROM total)) t""",
    crosstab=_CROSSTAB, total=_TOTAL))
def set_4(spark, sf):
    df = scored(spark, sf)
    rows = a.crosstab(explode_themes(df))
    return _plain_names(rows.unionByName(a.total_row(rows, df)))


@query("agg_12_theme_table", with_views("exploded", _PERCENT, crosstab=_CROSSTAB, total=_TOTAL))
def agg_12(spark, sf):
    df = scored(spark, sf)
    return _plain_names(a.theme_table(explode_themes(df), df))


@query("prj_10_column_order", with_views("exploded", """
SELECT Theme, 'Theme,positive,positive (%),negative,negative (%),neutral/mixed,'
 || 'neutral/mixed (%),Total' AS columns FROM crosstab""", crosstab=_CROSSTAB))
def prj_10(spark, sf):
    table = a.with_percent(a.crosstab(explode_themes(scored(spark, sf))))
    return table.select("Theme", F.lit(",".join(table.columns)).alias("columns"))


@query("flt_12_theme_and_total", with_views("exploded", _PERCENT + """
WHERE Theme IN ('Price and Value', 'Total Raw Reviews')""", crosstab=_CROSSTAB, total=_TOTAL))
def flt_12(spark, sf):
    df = scored(spark, sf)
    return _plain_names(a.theme_table(explode_themes(df), df, "Price and Value"))


@query("agg_13_monthly_themes", with_views("exploded", """
SELECT CAST(last_day(date) AS VARCHAR) AS date, Theme, count(*) AS count
FROM exploded WHERE date IS NOT NULL GROUP BY 1, 2"""))
def agg_13(spark, sf):
    return as_text(a.monthly_themes(explode_themes(scored(spark, sf))), "date")


@query("agg_14_date_bounds", with_views("reviews", """
SELECT CAST(min(date) AS VARCHAR) AS min_date, CAST(max(date) AS VARCHAR) AS max_date
FROM reviews"""))
def agg_14(spark, sf):
    return as_text(a.date_bounds(scored(spark, sf)), "min_date", "max_date")


@query("agg_15_filter_summary", with_views("reviews", """
SELECT original, kept, CASE WHEN kept < original THEN concat('Filtered: ', format('{:,}', kept),
 ' of ', format('{:,}', original), ' reviews') ELSE 'All reviews are included' END AS message
FROM (SELECT count(*) AS original, count(*) FILTER (CAST(date AS DATE)
 BETWEEN DATE '1996-03-01' AND DATE '1998-06-30') AS kept FROM reviews) c"""))
def agg_15(spark, sf):
    return a.filter_summary(scored(spark, sf), "1996-03-01", "1998-06-30")


@query("agg_16_theme_names", with_views("exploded", "SELECT DISTINCT Theme FROM exploded"))
def agg_16(spark, sf):
    return a.theme_names(explode_themes(scored(spark, sf)))


@query("agg_17_accuracy", with_views("scored", f"""
SELECT round(avg(CASE WHEN {LABEL} = predicted_sentiment THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM scored WHERE {LABEL} IS NOT NULL"""))
def agg_17(spark, sf):
    return rounded(accuracy(training_rows(scored(spark, sf))), "accuracy")


@query("agg_18_matching_reviews", with_views("choices", """
SELECT Theme, sentiment, count(DISTINCT review_id) AS reviews FROM choices GROUP BY 1, 2"""))
def agg_18(spark, sf):
    return a.matching_reviews(scored(spark, sf))


@query("agg_19_failed_count", with_views("scored", """
SELECT count(*) AS dropped FROM scored WHERE contains(themes, 'FAILED')"""))
def agg_19(spark, sf):
    return failed_count(scored(spark, sf))


@query("top_1_top_themes", with_views("exploded", """
SELECT Theme, count(*) AS count FROM exploded GROUP BY 1 ORDER BY count DESC, Theme LIMIT 20"""))
def top_1(spark, sf):
    return a.top_themes(explode_themes(scored(spark, sf)))


@query("top_2_first_rows", with_views("scored", """
SELECT review_id, clean_text FROM scored ORDER BY review_id LIMIT 50"""))
def top_2(spark, sf):
    return first_rows(scored(spark, sf).select("review_id", "clean_text"), 50, "review_id")


@query("top_3_chart_order", with_views("exploded", """
SELECT Theme, count, row_number() OVER (ORDER BY count, Theme DESC) AS bar
FROM (SELECT Theme, count(*) AS count FROM exploded GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) t"""))
def top_3(spark, sf):
    chart = a.themes_for_chart(a.top_themes(explode_themes(scored(spark, sf))))
    # At most twenty bars.
    return chart.withColumn("bar", F.monotonically_increasing_id() + 1)


_ALL_CLASSES = """
SELECT Theme, count(*) FILTER (predicted_sentiment = 'positive') AS positive,
 count(*) FILTER (predicted_sentiment = 'negative') AS negative,
 count(*) FILTER (predicted_sentiment = 'neutral') AS neutral,
 count(*) FILTER (predicted_sentiment = 'neutral/mixed') AS middle,
 count(*) FILTER (predicted_sentiment = 'unsure') AS unsure, count(*) AS total
FROM {table} GROUP BY Theme"""
_ALL_CLASS_ROWS = (
    _ALL_CLASSES.format(table="classed_exploded") + " UNION ALL "
    + _ALL_CLASSES.format(table="(SELECT 'Total Raw Reviews' AS Theme, predicted_sentiment FROM classed) r")
)


@query("agg_9_all_classes", with_views("scored", _ALL_CLASS_ROWS, **MORE_VIEWS))
def agg_9_all(spark, sf):
    df = classed(spark, sf)
    rows = a.crosstab(explode_themes(df))
    return _plain_names(rows.unionByName(a.total_row(rows, df)))


@query("agg_12_all_classes", with_views("scored", """
SELECT Theme, positive, round_even(positive / total * 100, 1) AS positive_pct,
 negative, round_even(negative / total * 100, 1) AS negative_pct,
 neutral, round_even(neutral / total * 100, 1) AS neutral_pct,
 middle, round_even(middle / total * 100, 1) AS middle_pct, total FROM shown""",
    **MORE_VIEWS, shown=_ALL_CLASS_ROWS))
def agg_12_all(spark, sf):
    df = classed(spark, sf)
    table = a.theme_table(explode_themes(df), df)
    return _plain_names(table).withColumnRenamed("neutral (%)", "neutral_pct")


@query("agg_4_summary_boxes", with_views("scored", """
SELECT predicted_sentiment AS sentiment, round(min(confidence), 6) AS min, round(max(confidence), 6) AS max,
 TRUE AS close FROM scored GROUP BY 1"""))
def agg_4_summary(spark, sf):
    """Quartiles from bounded summaries, told as closeness to the exact ones."""
    df = scored(spark, sf)
    exact = a.confidence_boxes(df).select("sentiment", *[F.col(c).alias(f"exact_{c}") for c in ("q1", "median", "q3")])
    rows = a.confidence_boxes(df, exact=False).join(exact, "sentiment")
    close = F.lit(True)
    for c in ("q1", "median", "q3"):
        close = close & (F.abs(F.col(c) - F.col(f"exact_{c}")) < 0.01)
    return rounded(rows.select("sentiment", "min", "max", close.alias("close")), "min", "max")


@query("agg_6_enough_to_plot", with_views("scored", """
SELECT months > 1 AS enough, one > 1 AS enough_of_one FROM
 (SELECT count(*) AS months FROM (SELECT DISTINCT last_day(date), predicted_sentiment FROM scored
  WHERE date IS NOT NULL) m), (SELECT count(*) AS one FROM (SELECT predicted_sentiment FROM scored
  WHERE date IS NOT NULL AND predicted_sentiment = 'positive' GROUP BY 1) o)"""))
def agg_6(spark, sf):
    monthly = a.monthly_sentiment(scored(spark, sf))
    alone = monthly.filter("predicted_sentiment = 'positive'").groupBy("predicted_sentiment").count()
    # The decision is one bit per chart; the counts behind it come from the data.
    return monthly.agg(
        F.lit(a.enough_to_plot(monthly)).alias("enough"), F.lit(a.enough_to_plot(alone)).alias("enough_of_one")
    )
