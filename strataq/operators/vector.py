"""Exact vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions.vectors import METRICS, squared_l2


def _lit(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def top(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", key: str = "vec_id", vec: str = "embedding", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """``key, score`` of the k highest scores; ties by id.  ``where`` filters first."""
    rows = vectors if where is None else vectors.where(where)
    rows = rows.where(F.size(vec) == len(query)).select(key, METRICS[metric](F.col(vec), _lit(query)).alias("score"))
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), key).limit(k)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vec: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """``key, distance`` by squared L2, of vectors of the query's length, among ``allowed`` ids."""
    rows = vectors if allowed is None else vectors.join(allowed.select(key), key, "left_semi")
    rows = rows.where(F.size(vec) == len(query)).select(key, squared_l2(F.col(vec), _lit(query)).alias("distance"))
    return rows.orderBy("distance", key).limit(k)


def vector_of(vectors: DataFrame, value, key: str = "vec_id", vec: str = "embedding") -> list[float]:
    row = vectors.where(F.col(key) == value).select(vec).first()
    return [] if row is None else list(row[0])


def similar_to(vectors: DataFrame, value, k: int, threshold: float | None = None, key: str = "vec_id", vec: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Top k of the vector that a record key names; an unknown key finds nothing."""
    query = vector_of(vectors, value, key, vec)
    return top(vectors, query, k, metric, key, vec, threshold=threshold) if query else vectors.select(key, F.lit(0.0).alias("score")).limit(0)
