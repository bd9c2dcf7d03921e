"""The mixed-sentiment rule as boolean column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from opinara.vocab import CONTRAST_WORDS, MIDDLE_LABELS, NEGATIVE_CUES, POSITIVE_CUES

# Least class probability and largest difference that count as close.
MIN_PROBABILITY = 0.30
MAX_DIFFERENCE = 0.25


def has_contrast(text: Column) -> Column:
    """A contrast word stands between two blanks; the text ends count as blanks."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return reduce(or_, (F.contains(padded, F.lit(f" {word} ")) for word in CONTRAST_WORDS))


def cue_tokens(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), F.lit(0))


def has_any(words: Column, cues: tuple[str, ...]) -> Column:
    """The word array and the cue list share a member."""
    return F.arrays_overlap(words, F.array(*[F.lit(c) for c in cues]))


def has_dual_polarity(text: Column) -> Column:
    """The text holds a positive and a negative cue word."""
    words = cue_tokens(text)
    return has_any(words, POSITIVE_CUES) & has_any(words, NEGATIVE_CUES)


def probabilities_close(p_positive: Column | None, p_negative: Column | None) -> Column:
    """Both outer classes are likely and nearly equally so; an absent one counts as 0."""
    zero = F.lit(0.0)
    pos = zero if p_positive is None else F.coalesce(p_positive, zero)
    neg = zero if p_negative is None else F.coalesce(p_negative, zero)
    return (
        (pos >= MIN_PROBABILITY)
        & (neg >= MIN_PROBABILITY)
        & (F.abs(pos - neg) <= MAX_DIFFERENCE)
    )


def mixed_rule(text: Column, p_positive: Column | None, p_negative: Column | None) -> Column:
    """Contrast, together with close probabilities or cue words of both kinds."""
    return has_contrast(text) & (
        probabilities_close(p_positive, p_negative) | has_dual_polarity(text)
    )


def is_middle(sentiment: Column) -> Column:
    return F.coalesce(sentiment.isin(*MIDDLE_LABELS), F.lit(False))


def is_mixed(
    sentiment: Column, text: Column, p_positive: Column | None, p_negative: Column | None
) -> Column:
    """The rule on the middle class, false elsewhere."""
    return F.when(is_middle(sentiment), mixed_rule(text, p_positive, p_negative)).otherwise(False)
