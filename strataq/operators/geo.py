"""Spatial search over boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions.boxes import Box, contains_point, distance, intersects


def search(boxes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Boxes that meet the given one; the four comparisons reach the scan."""
    return boxes.where(intersects(Box.of(), Box.lit(*box)))


def search_point(boxes: DataFrame, x: float, y: float) -> DataFrame:
    return boxes.where(contains_point(Box.of(), F.lit(x), F.lit(y)))


def nearest(boxes: DataFrame, x: float, y: float, k: int, key: str = "id") -> DataFrame:
    return boxes.withColumn("distance", distance(Box.of(), F.lit(x), F.lit(y))).orderBy("distance", key).limit(k)


def within(boxes: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    near = search(boxes, (x - radius, y - radius, x + radius, y + radius))
    return near.withColumn("distance", distance(Box.of(), F.lit(x), F.lit(y))).where(F.col("distance") <= radius)
