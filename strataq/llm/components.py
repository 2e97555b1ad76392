"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import written


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``: the least node that it reaches.

    Each step links nodes to the least neighbour: larger ones in large-star,
    smaller ones in small-star.  No adjacency list is ever built, only a minimum
    a node, so a hub costs no more than its rows.  Each round is a written table.
    Rounds end when the edges repeat; where ``most_rounds`` come before that, an
    error is raised, so groups never come back in parts.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, rounds = None, 0
    while True:
        if rounds == most_rounds:
            raise RuntimeError(f"components have not converged in {most_rounds} rounds")
        rounds += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
