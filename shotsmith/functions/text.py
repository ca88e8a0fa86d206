"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens are cut at every single space: no case folding, and runs of spaces
# give empty tokens ('a  b' -> ['a', '', 'b'], 'a ' -> ['a', '']).
TOKEN_SEPARATOR = " "


def tokens(col: str | Column) -> Column:
    """split on one space, keeping empty tokens (limit -1)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split(c, TOKEN_SEPARATOR, -1)


def as_text(col: str | Column) -> Column:
    """A value as text; a missing value reads ``'nan'``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("nan"))


def count_occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal string (no regex)."""
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise(
        F.floor((F.length(haystack) - F.length(F.replace(haystack, needle, F.lit(""))))
                / F.length(needle)).cast("int"))

