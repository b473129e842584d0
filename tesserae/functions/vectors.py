"""Column functions over vectors (arrays of numbers), computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length 1; zeros stay zeros."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def reduced(v: Column, dimensions: int) -> Column:
    """The first dimensions only, brought to length 1 again."""
    return unit(F.slice(v, 1, dimensions))


def score_band(s: Column) -> Column:
    return F.when(s >= 0.8, "excellent").when(s >= 0.6, "good").when(s >= 0.4, "fair").otherwise("low")
