"""Readers, writers and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.operators.model import predict
from opinara.operators.prepare import training_rows, with_clean_text
from opinara.plans.report import SECTIONS, THEME_TREND, TOP, report_bundle, review_tables
from opinara.plans.score import score_job
from opinara.sources.models import load_or_train, save_model
from opinara.sources.reports import write_report
from opinara.sources.reviews import read_review_table, read_reviews, read_training
from opinara.vocab import NA_TOKENS
from registry.core import query, reviews, scored, scratch, table, with_views
from registry.features import trained
from registry.preparation import LABEL
from registry.ranking import SAMPLE_SQL
from registry.themes import analyst

_NA = ", ".join(f"'{t}'" for t in NA_TOKENS)


def _write_csv(df, path):
    (
        df.write.option("header", True).option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


@query("src_1_read_csv", f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN text NOT IN ({_NA}) THEN text END AS text,
 lang FROM documents""")
def src_1(spark, sf):
    """Documents, with their quotes and line breaks, through CSV and back."""
    df = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return read_reviews(spark, _write_csv(df, scratch(spark, "csv")))


@query("src_1_split_file", f"""
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
 CASE WHEN text NOT IN ({_NA}) THEN text END AS text
FROM (SELECT conv_id, turn, '"' || text || '",' || chr(10) || chr(10) || text AS text
 FROM conversations) c""")
def src_1_split(spark, sf):
    """Turns with quotes and line breaks through CSV, each file read by tasks of 64 KB."""
    text = F.format_string('"%s",\n\n%s', "text", "text")
    df = table(spark, sf, "conversations")
    df = df.select("conv_id", "turn", F.when(F.col("text").isNotNull(), text).alias("text"))
    return read_reviews(spark, _write_csv(df, scratch(spark, "csv")), split_bytes=1 << 16)


@query("src_1_missing_marks", with_views("reviews", """
SELECT review_id, CASE WHEN stars = 'nan' THEN NULL ELSE stars END AS stars, text FROM reviews"""))
def src_1_missing(spark, sf):
    df = reviews(spark, sf).select("review_id", "stars", "text")
    return read_reviews(spark, _write_csv(df, scratch(spark, "csv")), multi_line=False)


@query("src_2_training_csv", with_views("reviews", f"""
SELECT review_id, sentiment, lower(coalesce(text, '')) AS clean_text
FROM (SELECT *, {LABEL} AS sentiment FROM reviews) r WHERE sentiment IS NOT NULL"""))
def src_2(spark, sf):
    folder = scratch(spark, "training")
    df = reviews(spark, sf).select("review_id", "stars", "text")
    _write_csv(df, f"{folder}/training_testing_data.csv")
    _write_csv(df.withColumn("stars", F.lit("1")), f"{folder}/another.csv")
    rows = training_rows(read_training(spark, folder))
    return rows.select("review_id", "sentiment", "clean_text")


@query("src_3_review_table", """
SELECT conv_id, turn, role, text FROM conversations""")
def src_3(spark, sf):
    return read_review_table(spark, f"{sf}/conversations.parquet")


_SAME = with_views("reviews", """
SELECT review_id, TRUE AS same FROM reviews""")


def _compare(df, one, other):
    """Both models give every review the same class and confidence."""
    left = predict(df, one).select("review_id", "predicted_sentiment", "confidence")
    right = predict(df, other).select(
        "review_id", F.col("predicted_sentiment").alias("p"), F.col("confidence").alias("c")
    )
    same = (F.col("p") == F.col("predicted_sentiment")) & (F.col("c") == F.col("confidence"))
    return left.join(right, "review_id").select("review_id", same.alias("same"))


@query("snk_1_save_model", _SAME)
def snk_1(spark, sf):
    model = trained(spark, sf).model
    path = scratch(spark, "model")
    save_model(model, path)
    loaded, _ = load_or_train(spark, path)
    return _compare(with_clean_text(reviews(spark, sf)), model, loaded)


@query("snk_2_load_or_train", with_views("reviews", """
SELECT TRUE AS trained_first, TRUE AS loaded_second, count(*) AS reviews FROM reviews"""))
def snk_2(spark, sf):
    path = scratch(spark, "model")
    _, first = load_or_train(spark, path, reviews(spark, sf))
    model, second = load_or_train(spark, path, reviews(spark, sf))
    out = predict(with_clean_text(reviews(spark, sf)), model)
    return out.agg(
        F.lit(first is not None).alias("trained_first"),
        F.lit(second is None).alias("loaded_second"),
        F.count("predicted_sentiment").alias("reviews"),
    )


@query("snk_3_report_tables", with_views("exploded", """
SELECT 'theme' AS kind, Theme AS name, count(*) AS count FROM exploded
WHERE date IS NOT NULL GROUP BY 2
UNION ALL SELECT 'sentiment', predicted_sentiment, count(*) FROM scored
WHERE date IS NOT NULL GROUP BY 2"""))
def snk_3(spark, sf):
    folder = scratch(spark, "report")
    write_report(report_bundle(scored(spark, sf)), folder)
    themes = spark.read.parquet(f"{folder}/top_themes")
    classes = spark.read.parquet(f"{folder}/sentiment_shares")
    return themes.select(F.lit("theme").alias("kind"), F.col("Theme").alias("name"), "count").unionByName(
        classes.select(F.lit("sentiment").alias("kind"), F.col("sentiment").alias("name"), "count")
    )


def _lines_sql(kind, order):
    return f"""
SELECT concat('{kind}: ', s.Theme, ' (', s.sentiment, ')') AS title, s.Theme, s.sentiment,
 row_number() OVER (PARTITION BY s.Theme, s.sentiment ORDER BY {order}) AS number,
 concat('"', clean_text, '"') AS body
FROM sample s JOIN scored r ON s.review_id = r.review_id"""


@query("snk_3_cited_and_random_reviews", with_views("choices",
    f"""SELECT 'cited' AS kind, * FROM ({_lines_sql("Insights", "CASE position WHEN 7 THEN 0 WHEN 0 THEN 1 ELSE 2 END")}
 WHERE position IN (7, 0, 3)) c
UNION ALL SELECT 'random', * FROM ({_lines_sql("Random Reviews", "position")}
 WHERE position < 20 AND ((s.Theme = 'Price and Value' AND s.sentiment = 'All')
  OR (s.Theme = 'Speed of Service' AND s.sentiment = 'negative'))) f""", sample=SAMPLE_SQL))
def snk_3_reviews(spark, sf):
    feeds = [("Price and Value", "All"), ("Speed of Service", "negative")]
    tables = review_tables(scored(spark, sf), analyst(), feeds, parallel_calls=8)
    folder = scratch(spark, "report")
    write_report(tables, folder)
    parts = [
        spark.read.parquet(f"{folder}/{name}_reviews").select(
            F.lit(name).alias("kind"), "title", "Theme", "sentiment",
            F.col("number").cast("bigint").alias("number"), "body",
        )
        for name in ("cited", "random")
    ]
    return parts[0].unionByName(parts[1])


@query("snk_4_score_job", with_views("reviews", """
SELECT review_id, lower(coalesce(text, '')) AS clean_text, TRUE AS scored FROM reviews"""))
def snk_4(spark, sf):
    """From CSV to scored parquet with a saved model."""
    model = scratch(spark, "model")
    save_model(trained(spark, sf).model, model)
    source = _write_csv(reviews(spark, sf).drop("k"), scratch(spark, "csv"))
    target = scratch(spark, "scored")
    score_job(spark, source, model, target, multi_line=False)
    done = spark.read.parquet(target)
    ok = F.col("confidence").between(0, 1) & F.col("predicted_sentiment").isNotNull()
    return done.select("review_id", "clean_text", (ok & F.col("is_mixed").isNotNull()).alias("scored"))


@query("prj_11_report_bundle", with_views("exploded", """
SELECT 'top_themes' AS section, Theme AS theme, CAST(NULL AS VARCHAR) AS date, count(*) AS count
FROM exploded WHERE CAST(date AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' GROUP BY 2
UNION ALL SELECT 'monthly_themes', Theme, CAST(last_day(date) AS VARCHAR), count(*)
FROM exploded WHERE CAST(date AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-06-30'
GROUP BY 2, 3"""))
def prj_11(spark, sf):
    """Two chosen sections of a date range; the others are never built."""
    chosen = [s for s in SECTIONS if s in (TOP, THEME_TREND)]
    tables = report_bundle(scored(spark, sf), chosen, start="1996-03-01", end="1998-06-30")
    parts = []
    for name, df in tables.items():
        date = F.col("date").cast("string") if "date" in df.columns else F.lit(None).cast("string")
        parts.append(
            df.select(F.lit(name).alias("section"), F.col("Theme").alias("theme"),
                      date.alias("date"), "count")
        )
    return parts[0].unionByName(parts[1])
