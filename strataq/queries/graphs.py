"""Graphs: customers and suppliers by their orders, and a small weighted ring of nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.operators import graph
from strataq.queries.registry import query
from strataq.session import table

OFFSET = 10_000_000
EDGES = f"e AS (SELECT DISTINCT o_custkey AS src, l_returnflag AS label, l_suppkey + {OFFSET} AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), both_ways AS (SELECT src, label, dst FROM e UNION SELECT dst, label, src FROM e)"


def edges(s, d, both=False):
    j = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = j.select(F.col("o_custkey").alias("src"), F.col("l_returnflag").alias("label"), (F.col("l_suppkey") + OFFSET).alias("dst")).distinct()
    return e.unionByName(e.select(F.col("dst").alias("src"), "label", F.col("src").alias("dst"))) if both else e


def bfs(depth: int, label: str | None = None, edge: str = "both_ways", start: int = 1) -> str:
    only = f" AND label = '{label}'" if label else ""
    return f"WITH RECURSIVE {EDGES}, t(id, depth) AS (SELECT {start}::BIGINT, 0 UNION SELECT b.dst, t.depth + 1 FROM t JOIN {edge} b ON b.src = t.id{only} WHERE t.depth < {depth}) SELECT id, min(depth) AS depth FROM t GROUP BY id"


@query("g1_traverse", bfs(2))
def _(s, d):
    return graph.traverse(edges(s, d, True), 1, 2)


@query("g1_traverse_label", bfs(2, "R"))
def _(s, d):
    return graph.traverse(edges(s, d, True), 1, 2, "R")


@query("g2_bfs", bfs(1, edge="e"))
def _(s, d):
    return graph.traverse(edges(s, d), 1, 1)


@query("g3_dfs_set", f"SELECT id, depth FROM ({bfs(1)})")
def _(s, d):
    return graph.depth_first(edges(s, d, True), 1, 1)


@query("g4_neighbors", f"WITH {EDGES} SELECT DISTINCT dst AS id FROM e WHERE src = 4")
def _(s, d):
    return graph.neighbors(edges(s, d), 4).distinct()


@query("g5_inbound", f"WITH {EDGES} SELECT src AS id FROM e WHERE dst = {OFFSET + 1}")
def _(s, d):
    return graph.inbound(edges(s, d), OFFSET + 1)


@query("g6_neighbors_with_label", f"WITH {EDGES} SELECT dst AS id FROM e WHERE src = 4 AND label = 'N'")
def _(s, d):
    return graph.neighbors(edges(s, d), 4, "N")


RING = "r AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 7 + 3) % 25)::BIGINT AS dst, (1 + (n_nationkey * 5) % 7)::DOUBLE AS weight FROM nation UNION ALL SELECT n_nationkey, ((n_nationkey + 1) % 25)::BIGINT, (2 + n_nationkey % 4)::DOUBLE FROM nation)"


def ring(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    far = n.select("src", ((F.col("src") * 7 + 3) % 25).alias("dst"), (1 + (F.col("src") * 5) % 7).cast("double").alias("weight"))
    return far.unionByName(n.select("src", ((F.col("src") + 1) % 25).alias("dst"), (2 + F.col("src") % 4).cast("double").alias("weight")))


@query("g7_shortest_path", f"""
WITH RECURSIVE {RING}, t(id, path, depth) AS (SELECT 0::BIGINT, [0::BIGINT], 0 UNION ALL SELECT r.dst, list_append(t.path, r.dst), t.depth + 1 FROM t JOIN r ON r.src = t.id WHERE t.depth < 7 AND NOT list_contains(t.path, r.dst))
SELECT array_to_string(path, '>') AS path, len(path)::BIGINT - 1 AS hops FROM t WHERE id = 18 ORDER BY len(path), path LIMIT 1""")
def _(s, d):
    p = graph.shortest_path(ring(s, d), 0, 18)
    return p.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))


@query("g8_weighted_paths", f"WITH RECURSIVE {RING}, t(id, distance) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT r.dst, t.distance + r.weight FROM t JOIN r ON r.src = t.id WHERE t.distance < 120) SELECT id, min(distance) AS distance FROM t GROUP BY id")
def _(s, d):
    return graph.distances(ring(s, d), 0)


@query("g9_edit_edges", f"WITH {EDGES}, a AS (SELECT src, label, dst FROM e UNION SELECT 1, 'X', {OFFSET + 2} UNION SELECT {OFFSET + 2}, 'X', 1), k AS (SELECT * FROM a WHERE NOT (src = 4 AND dst IN (SELECT dst FROM e WHERE src = 4 AND label = 'N'))) SELECT label, count(*) AS n FROM k GROUP BY label")
def _(s, d):
    e = edges(s, d)
    more = s.createDataFrame([(1, "X", OFFSET + 2)] * 3, "src long, label string, dst long")
    kept = graph.remove_edges(graph.add_edges(e, more, both_ways=True), e.where("src = 4 AND label = 'N'"))
    return kept.groupBy("label").agg(F.count("*").alias("n"))


@query("g10_traverse_candidates", f"SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey IN (SELECT id FROM ({bfs(2)}))")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return graph.reachable(c, edges(s, d, True), 1, 2)


@query("g11_remove_record", f"WITH {EDGES} SELECT count(*) AS n FROM both_ways WHERE src <> 1 AND dst <> 1")
def _(s, d):
    return graph.remove_record(edges(s, d, True), 1).agg(F.count("*").alias("n"))
