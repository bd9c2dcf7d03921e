"""Text expressions. All are built-in column functions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Word characters are letters, digits and "_"; a token has at least two of them.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

_EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (`trim` removes blanks only)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def clean(text: Column) -> Column:
    """Lower-cased text, never null."""
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def latin1(text: Column) -> Column:
    """Replace every character outside Latin-1 by one question mark."""
    return F.regexp_replace(text, r"[^\x00-\xFF]", "?")


def strip_markdown(text: Column) -> Column:
    """Drop bold marks and turn single asterisks into dashes."""
    bare = F.replace(text, F.lit("**"), F.lit(""))
    return F.replace(bare, F.lit("*"), F.lit("-"))
