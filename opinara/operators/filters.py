"""Row filters on dates, labels and themes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from opinara.functions.mixed import is_middle
from opinara.functions.themes import is_failed, named_themes
from opinara.vocab import ALL_SENTIMENTS


Day = str | dt.date


def has_dates(df: DataFrame, column: str = "date") -> bool:
    """The column exists and holds dates, not unparsed text."""
    return dict(df.dtypes).get(column, "").startswith(("date", "timestamp"))


def _as_date(day: Day) -> dt.date:
    if isinstance(day, dt.datetime):
        return day.date()
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def in_date_range(
    df: DataFrame, start: Day | None, end: Day | None, column: str = "date"
) -> Column:
    """The date lies between two days, both included; null dates are out.

    None stands for the first or last day of the data. A plain range on the bare column with
    literals of its type, so that it reaches the parquet reader.
    """
    if not has_dates(df, column):
        raise TypeError(f"{column} holds no dates; parse_dates reads texts")
    dtype = dict(df.dtypes)[column]
    day = F.col(column)
    inside = day.isNotNull()
    if start is not None:
        inside = inside & (day >= F.lit(_as_date(start).isoformat()).cast(dtype))
    if end is not None:
        after = _as_date(end) + dt.timedelta(days=1)
        inside = inside & (day < F.lit(after.isoformat()).cast(dtype))
    return inside


def date_range(
    df: DataFrame,
    start: Day | None = None,
    end: Day | None = None,
    column: str = "date",
    on_invalid: str = "raise",
) -> DataFrame:
    """Rows between two days. A start after the end raises, or keeps all rows on "ignore"."""
    if start is not None and end is not None and _as_date(start) > _as_date(end):
        if on_invalid == "ignore":
            return df
        raise ValueError("the start date must not be after the end date")
    return df.filter(in_date_range(df, start, end, column))


def middle_class(df: DataFrame) -> DataFrame:
    """Rows predicted as the middle class."""
    return df.filter(is_middle(F.col("predicted_sentiment")))


def without_failed(df: DataFrame) -> DataFrame:
    """Rows whose themes do not contain the failure marker; null themes stay."""
    return df.filter(~is_failed(F.col("themes")))


def already_themed(df: DataFrame) -> DataFrame:
    """One row telling whether any review is not marked as failed; stops at the first."""
    return without_failed(df).limit(1).agg((F.count(F.lit(1)) > 0).alias("already_themed"))


def has_themes(df: DataFrame) -> bool:
    """Whether extraction can be skipped."""
    return "themes" in df.columns and bool(already_themed(df).first()[0])


def of_theme(df: DataFrame, theme: str) -> DataFrame:
    return df.filter(F.col("Theme") == theme)


def of_sentiment(df: DataFrame, sentiment: str = ALL_SENTIMENTS) -> DataFrame:
    """Rows of one predicted class; "All" keeps every row."""
    if sentiment == ALL_SENTIMENTS:
        return df
    return df.filter(F.col("predicted_sentiment") == sentiment)


def drill_down(df: DataFrame, theme: str, sentiment: str = ALL_SENTIMENTS) -> DataFrame:
    """Reviews that carry a theme, each once.

    The theme array of a review decides, so no join with the exploded table is needed.
    """
    carries = F.array_contains(named_themes(F.col("themes")), theme)
    return of_sentiment(df.filter(carries & F.col("predicted_sentiment").isNotNull()), sentiment)


def reviews_matching(df: DataFrame, matches: DataFrame, key: str = "review_id") -> DataFrame:
    """Reviews with a row in `matches`, each once."""
    return df.join(matches.select(key), key, "left_semi")


def sampled_text(df: DataFrame) -> DataFrame:
    """Rows with a text to show to a model."""
    return df.dropna(subset=["clean_text"])
