"""The report: one group of tables per chosen section."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from opinara.functions.lines import (
    feed_header,
    feed_tags,
    insight_body,
    report_body,
    report_header,
    report_meta,
)
from opinara.functions.text import latin1
from opinara.operators import analytics as a
from opinara.operators.filters import Day, date_range, has_dates
from opinara.operators.insights import GROUP, insights, random_feeds
from opinara.operators.prepare import parse_dates, raw_view
from opinara.operators.themes import PARALLEL_CALLS, explode_themes
from opinara.session import pin

# Section names, in default order.
SUMMARY = "Prediction Summary"
SENTIMENT_TREND = "Overall Sentiment Over Time"
TOP = "Top Extracted Themes"
DISTRIBUTION = "Theme Sentiment Distribution"
THEME_TREND = "Time-Oriented Trends"
REVIEWS = "Phrases and Reviews"
SECTIONS = (SUMMARY, SENTIMENT_TREND, TOP, DISTRIBUTION, THEME_TREND, REVIEWS)
THEME_SECTIONS = (TOP, DISTRIBUTION, THEME_TREND, REVIEWS)


def _column(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else None


def feed_lines(df: DataFrame) -> DataFrame:
    """Adds `header` and `tags` as the review feed shows them."""
    date_type = dict(df.dtypes).get("date", "")
    return df.withColumns(
        {
            "header": feed_header(
                _column(df, "predicted_sentiment"), _column(df, "stars"), _column(df, "date"),
                date_type,
            ),
            "tags": feed_tags(
                _column(df, "themes"), _column(df, "confidence"), _column(df, "is_mixed")
            ),
        }
    )


def report_lines(df: DataFrame, section: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Numbered header, body and meta line of the reviews of each report section.

    Sections hold samples or citations, a bounded number of reviews each.
    """
    number = F.row_number().over(Window.partitionBy(*section).orderBy(*order))
    date_type = dict(df.dtypes).get("date", "")
    return df.withColumn("number", number).select(
        *section,
        "number",
        report_header(
            F.col("number"), _column(df, "predicted_sentiment"), _column(df, "stars"),
            _column(df, "date"), date_type,
        ).alias("header"),
        report_body(F.col("clean_text")).alias("body"),
        report_meta(
            _column(df, "themes"), _column(df, "confidence"), _column(df, "is_mixed")
        ).alias("meta"),
    )


def _title(kind: str):
    title = F.concat(F.lit(f"{kind}: "), "Theme", F.lit(" ("), "sentiment", F.lit(")"))
    return latin1(title).alias("title")


def insight_sections(found: DataFrame) -> DataFrame:
    """Title and printable text of every insight."""
    text = insight_body(F.col("insights")).alias("text")
    return found.filter(F.col("insights").isNotNull()).select(*GROUP, _title("Insights"), text)


def cited_section(cited: DataFrame) -> DataFrame:
    """Lines of the reviews each insight cites, under the insight's title."""
    lines = report_lines(cited, GROUP, ["citation"])
    return lines.select(_title("Insights"), *lines.columns)


def random_section(feeds: DataFrame) -> DataFrame:
    """Lines of the random reviews of each theme and sentiment."""
    lines = report_lines(feeds, GROUP, ["position"])
    return lines.select(_title("Random Reviews"), *lines.columns)


def review_tables(
    df: DataFrame,
    ask: Callable[[str], str] | None = None,
    feeds: Sequence[tuple[str, str]] = (),
    seed: int = 0,
    parallel_calls: int = PARALLEL_CALLS,
) -> dict[str, DataFrame]:
    """The report's reviews: insights with the reviews they cite, and chosen random feeds.

    Insights are asked for only with a model function; `feeds` names (theme, sentiment)
    pairs, "All" included. Give the reviews of the report's date range.
    """
    tables = {}
    if ask is not None:
        found, cited = insights(df, ask, seed=seed, parallel_calls=parallel_calls)
        tables["insights"] = insight_sections(found)
        tables["cited_reviews"] = cited_section(cited)
    if feeds:
        chosen = reduce(or_, ((F.col("Theme") == t) & (F.col("sentiment") == s) for t, s in feeds))
        tables["random_reviews"] = random_section(random_feeds(df, seed=seed).filter(chosen))
    return tables


def report_bundle(
    df: DataFrame,
    sections: Sequence[str] = SECTIONS,
    start: Day | None = None,
    end: Day | None = None,
) -> dict[str, DataFrame]:
    """Tables of the chosen sections, in their order, under short names.

    Reviews with dates are limited to the days from `start` to `end`, by default those of the
    data; reviews without a date are then left out. Dates may be text; unreadable ones turn the
    date sections off, with a warning, and all reviews stay. The data is counted once per cube; all
    counting sections read the small cubes, which are written only if one of their sections
    is chosen. Sections whose columns are missing are left out.
    """
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    if "date" in df.columns and not has_dates(df):
        df = parse_dates(df)
    has_date = has_dates(df)
    if has_date:
        df = date_range(df, start, end)
    themed = "themes" in df.columns
    chosen = [
        s for s in sections
        if (themed or s not in THEME_SECTIONS)
        and (has_date or s not in (SENTIMENT_TREND, THEME_TREND))
    ]
    date = "date" if has_date else None
    tables: dict[str, DataFrame] = {}
    by_class = by_theme = None
    if {SUMMARY, SENTIMENT_TREND, DISTRIBUTION} & set(chosen):
        by_class = pin(a.sentiment_cube(df, date), "sentiment-cube")
    if {TOP, DISTRIBUTION, THEME_TREND} & set(chosen):
        by_theme = pin(a.theme_cube(explode_themes(df), date), "theme-cube")
    for section in chosen:
        if section == SUMMARY:
            tables["key_figures"] = a.key_figure_texts(a.figures_of_cube(by_class))
            tables["sentiment_shares"] = a.sentiment_shares(by_class, weight="n")
            if "confidence" in df.columns:
                tables["confidence_boxes"] = a.confidence_boxes(df)
            tables["raw_output"] = raw_view(df)
        elif section == SENTIMENT_TREND:
            tables["monthly_sentiment"] = a.monthly_sentiment(by_class, "month", "n")
        elif section == TOP:
            tables["top_themes"] = a.top_themes(by_theme, weight="n")
        elif section == DISTRIBUTION:
            tables["theme_sentiment"] = a.theme_sentiment(by_theme, weight="n")
            tables["theme_table"] = a.theme_table(by_theme, by_class, weight="n")
        elif section == THEME_TREND:
            tables["monthly_themes"] = a.monthly_themes(by_theme, "month", "n")
        elif section == REVIEWS:
            tables["matching_reviews"] = a.matching_reviews(df)
    return tables
