"""Graph traversal over an edge table ``src, label, dst[, weight]``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.session import cut


def add_edges(edges: DataFrame, more: DataFrame, both_ways: bool = False) -> DataFrame:
    """One edge a (src, label, dst)."""
    if both_ways:
        more = more.unionByName(more.withColumn("_s", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("_s")).drop("_s"))
    return edges.unionByName(more, allowMissingColumns=True).dropDuplicates(["src", "label", "dst"])


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without the pairs' edges, whatever their label."""
    return edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti")


def remove_record(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("src") != node) & (F.col("dst") != node))


def neighbors(edges: DataFrame, node, label: str | None = None) -> DataFrame:
    rows = edges.where(F.col("src") == node)
    return (rows if label is None else rows.where(F.col("label") == label)).select(F.col("dst").alias("id"))


def inbound(edges: DataFrame, node) -> DataFrame:
    """One row an edge: two labels between a pair give two rows."""
    return edges.where(F.col("dst") == node).select(F.col("src").alias("id"))


def traverse(edges: DataFrame, start, depth: int, label: str | None = None) -> DataFrame:
    """``id, depth`` of first visits by breadth-first search, the start at depth 0.

    A round joins the frontier to the edges and drops what was visited; the
    visited set is checkpointed, so plans stay small.  Catalyst broadcasts the
    frontier while statistics allow it.
    """
    spark = edges.sparkSession
    hop = (edges if label is None else edges.where(F.col("label") == label)).select("src", "dst")
    hop = cut(hop) if depth > 1 else hop  # an edge table that is itself a plan is worked out once
    kind = edges.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(start, 0)], f"id {kind}, depth int")
    frontier = seen
    for d in range(1, depth + 1):
        found = hop.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start, target, most: int | None = None) -> DataFrame:
    """One row ``path``: the node list, least first among equals; no row if there is none.

    Ends when the frontier is empty, or after ``most`` hops if given.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    front = spark.createDataFrame([(start, [start])], f"id {kind}, path array<{kind}>")
    seen = front.select("id")
    edges = cut(edges.select("src", "dst").distinct())
    hops = 0
    while True:
        hit = front.where(F.col("id") == target).select("path")
        if not hit.isEmpty():
            return hit
        if hops == most:
            return hit
        hops += 1
        step = edges.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("p"))
        front = cut(step.join(seen, "id", "left_anti").select("id", F.concat("p", F.array("id")).alias("path")))
        if front.isEmpty():
            return front.select("path")
        seen = cut(seen.unionByName(front.select("id")))


def _relaxed(edges: DataFrame, start, most: int | None) -> DataFrame:
    """``id, distance, prev, hops`` of all nodes reached; ``prev`` is the node before on a path of least distance.

    Among equal distances the fewest hops count, then the least predecessor.
    Hops grow along ``prev``, so edges of weight 0 make no circles.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    hop = cut(edges.groupBy("src", "dst").agg(F.min(w).alias("w")))
    if not hop.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    best = spark.createDataFrame([(start, 0.0, None, 0)], f"id {kind}, distance double, prev {kind}, hops long")
    front, rounds = best, 0
    while rounds != most:
        rounds += 1
        way = F.struct((F.col("distance") + F.col("w")).alias("distance"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("prev"))
        step = hop.join(front.select(F.col("id").alias("src"), "distance", "hops"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(way).alias("new"))
        old = best.select("id", F.struct("distance", "hops", "prev").alias("old"))
        front = cut(step.join(old, "id", "left").where(F.col("old").isNull() | (F.col("new") < F.col("old"))).select("id", "new.distance", "new.prev", "new.hops"))
        if front.isEmpty():
            break
        best = cut(best.join(front.select("id"), "id", "left_anti").select("id", "distance", "prev", "hops").unionByName(front))
    return best


def distances(edges: DataFrame, start, most: int | None = None) -> DataFrame:
    """``id, distance`` by relaxing non-negative weights (default 1) until nothing improves, or for ``most`` rounds if given."""
    return _relaxed(edges, start, most).select("id", "distance")


def shortest_path_weighted(edges: DataFrame, start, target) -> DataFrame:
    """One row ``path, distance``: the node list of least distance; no row if there is none.

    Predecessors are followed from the target, one join a hop.
    """
    best = _relaxed(edges, start, None)
    walk = best.where(F.col("id") == target).select(F.array("id").alias("path"), "prev", "distance")
    while not (more := walk.where(F.col("prev").isNotNull())).isEmpty():
        step = best.select(F.col("id").alias("prev"), F.col("prev").alias("_before"))
        walk = cut(more.join(step, "prev").select(F.concat(F.array("prev"), "path").alias("path"), F.col("_before").alias("prev"), "distance"))
    return walk.select("path", "distance")


def depth_first(edges: DataFrame, start, hops: int) -> DataFrame:
    """The set that a depth-first walk of bounded length can reach (each node at its least depth).

    A walk's order depends on the order of edges, which a table has not; the set
    does not, so ids come back with their depth.
    """
    return traverse(edges, start, hops)


def reachable(candidates: DataFrame, edges: DataFrame, start, hops: int = 1, label: str | None = None, key: str = "id") -> DataFrame:
    return candidates.join(traverse(edges, start, hops, label).select(F.col("id").alias(key)), key, "left_semi")
