"""Vectors as ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = F.array(F.greatest(norm(a), F.lit(eps)))  # in an array, so that it's computed once and not for each component
    return F.transform(n, lambda m: F.transform(a, lambda x: x.cast("double") / m))[0]


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, w: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * w)


def total(vectors: Column, width: Column) -> Column:
    """Sum of an array of vectors."""
    return F.aggregate(vectors, F.array_repeat(F.lit(0.0), width), add)
