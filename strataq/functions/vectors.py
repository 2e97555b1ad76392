"""Vector measures in double precision, over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    """Null if the lengths differ."""
    d = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), d)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def negative_l2(a: Column, b: Column) -> Column:
    return -l2(a, b)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ, a vector is empty, or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(ok, dot(a, b) / F.when(norms > 0, norms)).otherwise(F.lit(0.0))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": negative_l2}
