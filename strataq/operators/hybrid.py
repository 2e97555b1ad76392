"""Hybrid scoring over text, vector and graph candidates, and plan order by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.session import cut

DEFAULT_WEIGHTS = (0.34, 0.33, 0.33)

# The cost of each model's index and the index's name, cheapest first.
MODEL_COSTS = {"kv": 10, "search": 30, "sql": 35, "graph": 45, "vector": 55}
MODEL_INDEXES = {"kv": "primary", "search": "inverted", "sql": "btree", "graph": "adjacency", "vector": "hnsw_or_ivf"}


def plan_order(models: list[str]) -> list[str]:
    """Indexes in the order in which they are asked: cheapest model first, each once."""
    known = [m.lower() for m in models if m.lower() != "hybrid"]
    return [MODEL_INDEXES[m] for m in sorted(dict.fromkeys(known), key=lambda m: MODEL_COSTS[m])]


def graph_scores(visits: DataFrame) -> DataFrame:
    """1 / (rank + 1) by (depth, id) of a traversal.

    Visits are ranked within ranges of (depth, id), whose sizes give each range its
    first rank, so no task orders all of them; the ranges are as many as partitions.
    """
    ranged = cut(visits.select("depth", "id").repartitionByRange("depth", "id").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("depth", "id"))
    ranked = ranged.withColumn("_rank", rank).join(F.broadcast(before), "_part")
    return ranked.select("id", (F.lit(1.0) / (F.col("_before") + F.col("_rank"))).alias("graph"))


def combine(text: DataFrame, vector: DataFrame, graph: DataFrame, k: int, weights=DEFAULT_WEIGHTS, overrides: DataFrame | None = None) -> DataFrame:
    """``id, score`` of the union of candidates; a missing part is 0.

    ``overrides`` (id, text_w, vector_w, graph_w) take the place of the weights
    for their records.  The vector candidates are the best max(k, 100).
    """
    vector = vector.orderBy(F.desc("vector"), "id").limit(max(k, 100))
    rows = text.join(vector, "id", "full_outer").join(graph, "id", "full_outer")
    parts = ("text", "vector", "graph")
    if overrides is not None:
        rows = rows.join(overrides, "id", "left")
    weight = lambda i, p: F.coalesce(F.col(f"{p}_w"), F.lit(float(weights[i]))) if overrides is not None else F.lit(float(weights[i]))
    total = F.lit(0.0)
    for i, p in enumerate(parts):
        total = total + weight(i, p) * F.coalesce(F.col(p), F.lit(0.0))
    return rows.select("id", total.alias("score")).orderBy(F.desc("score"), "id").limit(k)
