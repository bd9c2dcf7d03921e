"""Feed and report lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions.text import latin1, strip_markdown
from opinara.operators import analytics as a
from opinara.operators.insights import GROUP, insight_samples
from opinara.plans.report import feed_lines, insight_sections, report_lines
from registry.core import query, scored, table, with_views
from registry.ranking import SAMPLE_SQL

# Star ratings count as numbers; a text that is none is skipped.
_STARS = "CAST(trunc(try_cast(nullif(stars, 'nan') AS DOUBLE)) AS INTEGER)"
_DATE = "strftime(date, 'Date: %Y-%m-%d %H:%M:%S')"


@query("fmt_1_feed_header", with_views("scored", f"""
SELECT review_id, concat_ws(' | ', concat('**', upper(predicted_sentiment), '**'),
 repeat('★', {_STARS}), {_DATE}) AS header
FROM scored"""))
def fmt_1(spark, sf):
    return feed_lines(scored(spark, sf)).select("review_id", "header")


@query("fmt_2_feed_tags", with_views("scored", """
SELECT review_id, concat_ws(' • ', '**' || themes || '**',
 concat('Conf: ', format('{:.1f}', confidence * 100), '%'),
 CASE WHEN is_mixed THEN 'Mixed' END) AS tags FROM scored"""))
def fmt_2(spark, sf):
    return feed_lines(scored(spark, sf)).select("review_id", "tags")


_LINES = """
SELECT s.Theme, s.sentiment, CAST(position + 1 AS BIGINT) AS number, r.*
FROM sample s JOIN scored r ON s.review_id = r.review_id"""


def _lines(spark, sf):
    return report_lines(insight_samples(scored(spark, sf)), GROUP, ["position"]).withColumn(
        "number", F.col("number").cast("bigint")
    )


@query("fmt_3_report_header", with_views("choices", f"""
SELECT Theme, sentiment, number, concat_ws(' | ',
 concat('Review ', CAST(number AS VARCHAR), ': ', upper(predicted_sentiment)),
 CAST({_STARS} AS VARCHAR) || ' stars', {_DATE}) AS header
FROM lines""", sample=SAMPLE_SQL, lines=_LINES))
def fmt_3(spark, sf):
    return _lines(spark, sf).select(*GROUP, "number", "header")


@query("fmt_4_report_meta", with_views("choices", """
SELECT Theme, sentiment, number, concat('"', clean_text, '"') AS body,
 concat_ws(' | ', 'Theme: ' || themes,
 concat('Confidence: ', format('{:.1f}', confidence * 100), '%'),
 CASE WHEN is_mixed THEN 'Mixed Sentiment' END) AS meta
FROM lines""", sample=SAMPLE_SQL, lines=_LINES))
def fmt_4(spark, sf):
    return _lines(spark, sf).select(*GROUP, "number", "body", "meta")


@query("fmt_5_latin1", """
SELECT doc_id, regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') AS printable FROM documents""")
def fmt_5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", latin1(F.col("text")).alias("printable"))


@query("fmt_6_strip_markdown", """
SELECT doc_id, replace(replace(concat('**', text, '** *', lang, '*'), '**', ''), '*', '-') AS plain
FROM documents""")
def fmt_6(spark, sf):
    marked = F.concat(F.lit("**"), "text", F.lit("** *"), "lang", F.lit("*"))
    return table(spark, sf, "documents").select("doc_id", strip_markdown(marked).alias("plain"))


@query("fmt_6_insight_section", with_views("exploded", """
SELECT concat('Insights: ', Theme, ' (', predicted_sentiment, ')') AS title,
 concat('- ', CAST(count(*) AS VARCHAR), ' reviews') AS text
FROM exploded GROUP BY Theme, predicted_sentiment"""))
def fmt_6_section(spark, sf):
    from opinara.operators.themes import explode_themes

    counts = a.theme_sentiment(explode_themes(scored(spark, sf)))
    text = F.concat(F.lit("* **"), F.col("count").cast("string"), F.lit("** reviews"))
    found = counts.select("Theme", F.col("predicted_sentiment").alias("sentiment"), text.alias("insights"))
    return insight_sections(found).select("title", "text")


@query("fmt_7_key_figure_texts", with_views("scored", """
SELECT format('{:,}', count(*)) AS reviews,
 concat(format('{:.1f}', avg(confidence) * 100), '%') AS avg_confidence,
 concat(format('{:.1f}', 100.0 * sum(CASE WHEN is_mixed THEN 1 ELSE 0 END) / count(*)), '%')
 AS mixed_rate FROM scored"""))
def fmt_7(spark, sf):
    return a.key_figure_texts(a.key_figures(scored(spark, sf)))


@query("fmt_7_without_mixed", with_views("scored", """
SELECT format('{:,}', count(*)) AS reviews,
 concat(format('{:.1f}', avg(confidence) * 100), '%') AS avg_confidence FROM scored"""))
def fmt_7_without(spark, sf):
    return a.key_figure_texts(a.key_figures(scored(spark, sf).drop("is_mixed")))
