"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a·b / ((|a| + 1e-9) (|b| + 1e-9)), from 0 to 2."""
    return 1 - dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def squared_l2(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), dot(a, a) + dot(b, b) - 2 * dot(a, b))


def l2_normalize(a: Column) -> Column:
    own = F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(a.cast("array<double>"), lambda x: x / F.greatest(own, F.lit(1e-12)))
