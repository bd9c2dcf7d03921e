"""Sentiment labels from star ratings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from opinara.vocab import MIDDLE, NEGATIVE, POSITIVE

# The texts taken as numbers. Spark's cast alone would also take "3d"; like this pattern it
# passes over white space at the ends.
_NUMBER = r"(?i)\A\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*\z"


def stars_number(stars: Column) -> Column:
    """Star rating as a double; null where the text is no number."""
    text = stars.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def sentiment_from_stars(stars: Column, scheme: str = "three_class") -> Column:
    """Label of a rating.

    `three_class`: 4 and more is positive, exactly 3 the middle class, any other number
    negative. A missing rating (null or NaN) is negative too; text that is no number gives
    null. `binary`: 4 and more positive, 2 and less negative, else null.
    """
    number = stars_number(stars)
    # Spark orders NaN above all numbers, so it is tested before the comparisons.
    if scheme == "binary":
        return (
            F.when(F.isnan(number), F.lit(None).cast("string"))
            .when(number >= 4, POSITIVE)
            .when(number <= 2, NEGATIVE)
        )
    if scheme != "three_class":
        raise ValueError(f"unknown scheme: {scheme}")
    return (
        F.when(stars.isNull() | F.isnan(number), NEGATIVE)
        .when(number >= 4, POSITIVE)
        .when(number == 3, MIDDLE)
        .when(number.isNotNull(), NEGATIVE)
    )
