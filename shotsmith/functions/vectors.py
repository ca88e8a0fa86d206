"""Dense-vector column functions (ARRAY<FLOAT|DOUBLE>), all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Norm clamp of L2 normalisation: a zero vector stays zero and scores 0.
NORM_EPS = 1e-12


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: str | Column, b: str | Column) -> Column:
    """sum of element-wise products."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(v: str | Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(F.transform(_c(v), lambda x: x.cast("double") * x),
                              F.lit(0.0), lambda acc, x: acc + x))


def normalise(v: str | Column) -> Column:
    """v / max(||v||, eps).

    The norm is computed once per row and zipped alongside the elements
    (``array_repeat`` evaluates it once); an expression written inside the
    lambda would be re-evaluated for every element.
    """
    vec = _c(v)
    norm = F.greatest(l2_norm(vec), F.lit(NORM_EPS))
    return F.transform(F.arrays_zip(vec.alias("x"), F.array_repeat(norm, F.size(vec)).alias("n")),
                       lambda e: e["x"].cast("double") / e["n"])


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(NORM_EPS))
                        * F.greatest(l2_norm(b), F.lit(NORM_EPS)))
