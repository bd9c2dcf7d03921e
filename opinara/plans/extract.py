"""Theme extraction that is skipped where it has been done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from opinara.operators.filters import has_themes
from opinara.operators.themes import extract_themes


def themed_reviews(df: DataFrame, ask: Callable[[str], str], **options) -> DataFrame:
    """Reviews with themes: as given if any review has been themed, else newly extracted."""
    return df if has_themes(df) else extract_themes(df, ask, **options)
