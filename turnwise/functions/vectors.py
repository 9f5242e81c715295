"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, the denominator kept away from zero by a small constant."""
    return _dot(a, b) / (norm(a) * norm(b) + EPSILON)


def angle(a: Column, b: Column) -> Column:
    """Angle in radians, 0 to pi; null if one is all zeros or their lengths differ. No constant is added, so it keeps the
    triangle inequality."""
    both = norm(a) * norm(b)
    return F.when(both > 0, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _dot(a, b) / both))))


def similarity(vec_a: Column, vec_b: Column, fallback: Column) -> Column:
    """Cosine where both vectors are there, else the given word measure."""
    return F.coalesce(cosine(vec_a, vec_b), fallback)
