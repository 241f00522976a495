"""Vector functions as Spark columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far a unit vector's norm may be from 1.
UNIT_TOLERANCE = 1e-4


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Null where the lengths differ or a vector is empty."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null also where a norm is 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    d = _sum(F.zip_with(a, b, lambda x, y: F.power(x.cast("double") - y.cast("double"), F.lit(2.0))))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(d))


def l2_score(a: Column, b: Column) -> Column:
    return 1 / (1 + l2(a, b))


def is_unit(a: Column) -> Column:
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & (F.abs(norm(a) - 1) <= UNIT_TOLERANCE)


def hop_score(seed: Column, hop: Column) -> Column:
    """A seed's score, halved for each hop away from it, once at least."""
    return seed * F.power(F.lit(0.5), F.greatest(hop, F.lit(1)).cast("double"))
