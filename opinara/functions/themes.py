"""Theme names as arrays and as comma-joined strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from opinara.functions.text import strip
from opinara.vocab import FAILED, NON_THEMES, THEMES


def named_themes(themes: Column) -> Column:
    """Names in a comma-joined theme string, in order, repeats and all.

    Markers that name no theme are left out; a null string gives null.
    """
    names = F.transform(F.split(themes, r",\s*"), strip)
    return F.filter(names, lambda name: ~name.isin(*NON_THEMES))


def joined_themes(names: Column) -> Column:
    return F.array_join(names, ", ")


def is_failed(themes: Column) -> Column:
    """The theme string contains the failure marker; false for null."""
    return F.coalesce(F.contains(themes, F.lit(FAILED)), F.lit(False))


def canonical_themes(names: Column, themes: Sequence[str] = THEMES) -> Column:
    """Allowed themes among `names`, in list spelling, each once, in given order.

    The theme list is a short literal map, so the lookup needs no join.
    """
    spelling = F.create_map(*[F.lit(x) for t in themes for x in (t.lower(), t)])
    found = F.transform(names, lambda n: F.try_element_at(spelling, F.lower(strip(n))))
    return F.array_distinct(F.filter(found, lambda t: t.isNotNull()))
