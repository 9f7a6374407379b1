"""Vector arithmetic as Column expressions over ARRAY<FLOAT>; sums run in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def blend(a: Column, b: Column, share: float) -> Column:
    """share * a + (1 - share) * b, element by element."""
    return F.zip_with(_d(a), _d(b), lambda x, y: F.lit(share) * x + F.lit(1 - share) * y)


def rms(a: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.sqrt(dot(a, a) / F.size(a)))
