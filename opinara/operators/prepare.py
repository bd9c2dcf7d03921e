"""Input preparation: ids, text, labels, dates."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, functions as F

from opinara.functions.labels import sentiment_from_stars
from opinara.functions.text import clean, strip
from opinara.operators.ranking import first_rows, with_row_index

# Text columns in order of preference, columns of the raw output view.
TEXT_COLUMNS = ("clean_text", "text", "raw_text")
RAW_VIEW_COLUMNS = (
    "date", "predicted_sentiment", "confidence", "is_mixed", "themes", "clean_text",
)
RAW_VIEW_ROWS = 50

# Date texts other than ISO, in order of preference: month first, then day first, then names.
USUAL_FORMATS = (
    "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a", "M/d/yyyy h:mm:ss a", "M-d-yyyy",
    "yyyy/M/d", "yyyy/M/d H:mm:ss", "d/M/yyyy", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "d.M.yyyy", "d-M-yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
)


def with_review_id(
    df: DataFrame, order_by: list[str] | None = None, fill_null: bool = False
) -> DataFrame:
    """Add `review_id` as `review_<row position>` if the column is absent.

    Positions follow `order_by`, or the order the rows are read in. `fill_null` also
    replaces missing ids in a given column.
    """
    present = "review_id" in df.columns
    if present and not fill_null:
        return df
    indexed = with_row_index(df, "_row", order_by)
    made = F.concat(F.lit("review_"), F.col("_row").cast("string"))
    if present:
        made = F.coalesce(F.col("review_id").cast("string"), made)
    return indexed.withColumn("review_id", made).drop("_row")


def with_clean_text(df: DataFrame, keep_existing: bool = False) -> DataFrame:
    """Add `clean_text` from the first text column present.

    The choice is by column, not by row. `keep_existing`, for training data, leaves a given
    `clean_text` as it is.
    """
    column = next((c for c in TEXT_COLUMNS if c in df.columns), None)
    if column is None:
        raise ValueError(f"the reviews need one of the columns {', '.join(TEXT_COLUMNS)}")
    if keep_existing and column == "clean_text":
        return df
    return df.withColumn("clean_text", clean(F.col(column)))


def with_sentiment(df: DataFrame, scheme: str = "three_class") -> DataFrame:
    """Add the training label `sentiment` from `stars`, unless the data brings one."""
    if "sentiment" in df.columns:
        return df
    return df.withColumn("sentiment", sentiment_from_stars(F.col("stars"), scheme))


def labelled(df: DataFrame) -> DataFrame:
    """Rows that have a label."""
    return df.filter(F.col("sentiment").isNotNull())


def training_rows(df: DataFrame) -> DataFrame:
    """Labelled rows with clean text."""
    return labelled(with_clean_text(with_sentiment(df), keep_existing=True))


def parse_dates(
    df: DataFrame,
    column: str = "date",
    formats: tuple[str, ...] = USUAL_FORMATS,
    on_invalid: str = "disable",
) -> DataFrame:
    """Turn a text date column into a time stamp without zone.

    ISO texts are read, or texts in one of `formats`: the first way that reads all texts of the
    column is taken. ISO has a pass of its own, as every other way is slow on texts that it cannot
    read; the others share one pass. If none does, the column stays text, with a warning,
    and `has_dates` keeps reports from using it as a date; all rows stay. With
    `on_invalid="null"` each text is read in the first way that can, and the rest become null.
    """
    if on_invalid not in ("disable", "null"):
        raise ValueError(f"unknown on_invalid: {on_invalid}")
    dtype = dict(df.dtypes)[column]
    if dtype == "timestamp_ntz":
        return df
    if dtype != "string":
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    text = strip(F.col(column))
    tries = [text.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    if on_invalid == "null":
        return df.withColumn(column, F.coalesce(*tries))
    unread = [F.count_if(F.col(column).isNotNull() & t.isNull()).alias(f"u{i}") for i, t in enumerate(tries)]
    left = df.select(column).agg(unread[0]).first()
    if left[0] and formats:
        left = (*left, *df.select(column).agg(*unread[1:]).first())
    way = next((t for t, n in zip(tries, left) if n == 0), None)
    if way is None:
        warnings.warn(f"{min(left)} texts of {column} are no dates, so it stays text", stacklevel=2)
        return df
    return df.withColumn(column, way)


def raw_view(df: DataFrame, rows: int = RAW_VIEW_ROWS, order_by: str = "review_id") -> DataFrame:
    """First rows of the scored reviews, with the columns of the raw view that exist."""
    columns = [c for c in RAW_VIEW_COLUMNS if c in df.columns]
    return first_rows(df.select(list({*columns, order_by})), rows, order_by).select(columns)
