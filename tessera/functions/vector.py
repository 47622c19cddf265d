"""Vector expressions, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalise(v: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    size = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / size)


def clamped(cos: Column) -> Column:
    """Similarity as a score from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos))


def finite(v: Column) -> Column:
    """Whether every number of a vector is finite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
