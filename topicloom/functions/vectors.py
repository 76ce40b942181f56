"""Vectors as arrays of doubles, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / both)
