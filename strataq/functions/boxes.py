"""Axis-aligned boxes (closed bounds) as four double columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    min_x: Column
    min_y: Column
    max_x: Column
    max_y: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + n) for n in cls._fields))

    @classmethod
    def lit(cls, *v: float) -> Box:
        return cls(*(F.lit(float(x)) for x in v))


def intersects(a: Box, b: Box) -> Column:
    return (a.min_x <= b.max_x) & (a.max_x >= b.min_x) & (a.min_y <= b.max_y) & (a.max_y >= b.min_y)


def contains(a: Box, b: Box) -> Column:
    return (a.min_x <= b.min_x) & (a.max_x >= b.max_x) & (a.min_y <= b.min_y) & (a.max_y >= b.max_y)


def contains_point(a: Box, x: Column, y: Column) -> Column:
    return x.between(a.min_x, a.max_x) & y.between(a.min_y, a.max_y)


def area(a: Box) -> Column:
    return (a.max_x - a.min_x) * (a.max_y - a.min_y)


def merge(a: Box, b: Box) -> Box:
    return Box(F.least(a.min_x, b.min_x), F.least(a.min_y, b.min_y), F.greatest(a.max_x, b.max_x), F.greatest(a.max_y, b.max_y))


def distance(a: Box, x: Column, y: Column) -> Column:
    zero = F.lit(0.0)
    dx = F.greatest(a.min_x - x, zero, x - a.max_x)
    dy = F.greatest(a.min_y - y, zero, y - a.max_y)
    return F.sqrt(dx * dx + dy * dy)
