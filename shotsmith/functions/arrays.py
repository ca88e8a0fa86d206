"""Array column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def argmax(scores: str | Column) -> Column:
    """0-based index of the first maximum (null for an empty array)."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def all_equal(scores: str | Column) -> Column:
    s = _c(scores)
    return F.array_max(s) == F.array_min(s)


def reorder(values: str | Column, order: str | Column) -> Column:
    """values[order[0]], values[order[1]], ... (0-based order)."""
    v = _c(values)
    return F.transform(_c(order), lambda i: F.element_at(v, i.cast("int") + 1))


def gather(values: str | Column, idx: list[int]) -> Column:
    """Verbalizer subset: pick positions ``idx`` (0-based) of ``values``."""
    v = _c(values)
    return F.array(*[F.element_at(v, i + 1) for i in idx])
