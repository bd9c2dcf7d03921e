"""Text lines of the review feed, the key figures and the report."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from opinara.functions.labels import stars_number
from opinara.functions.text import latin1, strip_markdown

# Separators, line formats and glyphs of feed and report.
FEED_SEPARATOR = " | "
TAG_SEPARATOR = " • "
STAR = "★"


def percent(share: Column, digits: int = 1) -> Column:
    """`0.0625` as `6.2%` (half-even)."""
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def whole_number(value: Column) -> Column:
    """`1234` as `1,234`."""
    return F.format_number(value, 0)


def _sentiment(sentiment: Column | None) -> Column:
    unknown = F.lit("UNKNOWN")
    return unknown if sentiment is None else F.coalesce(F.upper(sentiment), unknown)


def _date(date: Column | None, dtype: str) -> Column | None:
    if date is None:
        return None
    if dtype.startswith("timestamp"):
        seconds = F.date_format(date, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(date, "SSSSSS")
        fine = F.concat(seconds, F.lit("."), micros)
        date = F.when(micros != "000000", fine).otherwise(seconds)
    return F.concat(F.lit("Date: "), date.cast("string"))


def _whole_stars(stars: Column | None) -> Column | None:
    # Guarded so that ANSI casts of NaN or infinity never raise.
    return None if stars is None else stars_number(stars).try_cast("int")


def _joined(separator: str, parts: list[Column | None]) -> Column:
    """Join the parts that exist and are not null."""
    return F.concat_ws(separator, *[p for p in parts if p is not None])


def feed_header(
    sentiment: Column | None, stars: Column | None, date: Column | None, date_type: str
) -> Column:
    """`**POSITIVE** | ★★★★ | Date: 2024-01-31 10:00:00`, absent parts skipped."""
    n = _whole_stars(stars)
    glyphs = None if n is None else F.when(n.isNotNull(), F.repeat(F.lit(STAR), n))
    bold = F.concat(F.lit("**"), _sentiment(sentiment), F.lit("**"))
    return _joined(FEED_SEPARATOR, [bold, glyphs, _date(date, date_type)])


def feed_tags(
    themes: Column | None, confidence: Column | None, is_mixed: Column | None
) -> Column:
    """`**Product Quality** • Conf: 91.3% • Mixed`; null when there is no tag."""
    parts = [
        None if themes is None else F.concat(F.lit("**"), themes, F.lit("**")),
        None if confidence is None else F.concat(F.lit("Conf: "), percent(confidence)),
        None if is_mixed is None else F.when(is_mixed, "Mixed"),
    ]
    return F.nullif(_joined(TAG_SEPARATOR, parts), F.lit(""))


def report_header(
    number: Column,
    sentiment: Column | None,
    stars: Column | None,
    date: Column | None,
    date_type: str,
) -> Column:
    """`Review 1: POSITIVE | 4 stars | Date: 2024-01-31 10:00:00` in Latin-1."""
    n = _whole_stars(stars)
    title = F.concat(F.lit("Review "), number.cast("string"), F.lit(": "), _sentiment(sentiment))
    count = None if n is None else F.concat(n.cast("string"), F.lit(" stars"))
    return latin1(_joined(FEED_SEPARATOR, [title, count, _date(date, date_type)]))


def report_body(text: Column) -> Column:
    """The review text in quotes, in Latin-1."""
    return F.concat(F.lit('"'), latin1(F.coalesce(text, F.lit(""))), F.lit('"'))


def report_meta(
    themes: Column | None, confidence: Column | None, is_mixed: Column | None
) -> Column:
    """`Theme: Product Quality | Confidence: 91.3% | Mixed Sentiment`; null when empty."""
    bare = None if themes is None else F.replace(themes, F.lit("**"), F.lit(""))
    parts = [
        None if bare is None else F.concat(F.lit("Theme: "), bare),
        None if confidence is None else F.concat(F.lit("Confidence: "), percent(confidence)),
        None if is_mixed is None else F.when(is_mixed, "Mixed Sentiment"),
    ]
    return F.nullif(latin1(_joined(FEED_SEPARATOR, parts)), F.lit(""))


def insight_body(text: Column) -> Column:
    """Insight text without markdown marks, in Latin-1."""
    return latin1(strip_markdown(text))


def filter_line(kept: Column, total: Column) -> Column:
    """`Filtered: 1,234 of 5,678 reviews`, or that nothing was filtered."""
    text = F.concat(
        F.lit("Filtered: "), whole_number(kept), F.lit(" of "), whole_number(total),
        F.lit(" reviews"),
    )
    return F.when(kept < total, text).otherwise("All reviews are included")
