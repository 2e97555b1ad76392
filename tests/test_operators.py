"""Small cases with known answers."""

import re

import pytest

from strataq.functions import scalar
from strataq.operators import geo, graph, hybrid, kv, text, timeseries, vector
from strataq.operators import relational as R
from strataq.operators.catalog import Attribute, Collection, violations
from strataq.operators.events import projection
from strataq.plans.build import Engine
from strataq.plans.cost import IndexSpec, explain
from strataq.plans.parser import parse
from strataq.plans.tree import Both, Either, Test


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, data):
    return spark.createDataFrame(data, "src long, label string, dst long")


def test_traverse_label(spark):
    e = edges(spark, [(1, "knows", 2), (1, "likes", 9), (2, "knows", 3), (3, "knows", 1)])
    assert rows(graph.traverse(e, 1, 2, "knows")) == [(1, 0), (2, 1), (3, 2)]


def test_edges_edit(spark):
    e = edges(spark, [(1, "f", 2), (1, "f", 3), (1, "b", 2)])
    assert rows(graph.neighbors(e, 1, "f")) == [(2,), (3,)]
    same = graph.add_edges(e, edges(spark, [(1, "f", 2)] * 3))
    assert same.count() == 3
    assert graph.remove_edges(e, edges(spark, [(1, "x", 2)])).count() == 1
    assert graph.add_edges(edges(spark, []), edges(spark, [(1, "f", 2)]), both_ways=True).count() == 2


def test_paths(spark):
    e = spark.createDataFrame([(1, "a", 2, 5.0), (1, "a", 3, 1.0), (3, "a", 2, 1.0), (2, "a", 4, None)], "src long, label string, dst long, weight double")
    assert graph.shortest_path(e, 1, 4).first().path == [1, 2, 4]
    assert graph.shortest_path(e, 1, 1).first().path == [1]
    assert graph.shortest_path(e, 4, 1).count() == 0
    assert rows(graph.distances(e, 1)) == [(1, 0.0), (2, 2.0), (3, 1.0), (4, 3.0)]


def test_long_paths(spark):
    n = 103
    data = [(i, "a", i + 1, 1.0) for i in range(n)] + [(0, "a", n, 500.0)]
    e = spark.createDataFrame(data, "src long, label string, dst long, weight double").coalesce(1)
    chain = e.where("weight < 500")
    assert graph.shortest_path(chain, 0, 52).first().path == list(range(53))
    assert {r.id: r.distance for r in graph.distances(e, 0).collect()} == {i: float(i) for i in range(n + 1)}


def test_weighted_paths(spark):
    data = [(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, None), (4, 1, 0.0), (2, 3, 0.0), (9, 1, 1.0)]
    e = spark.createDataFrame([(s, "a", d, w) for s, d, w in data], "src long, label string, dst long, weight double").coalesce(1)
    assert rows(graph.shortest_path_weighted(e, 1, 4)) == [([1, 3, 2, 4], 3.0)]
    assert rows(graph.shortest_path_weighted(e, 1, 1)) == [([1], 0.0)]
    assert graph.shortest_path_weighted(e, 1, 9).count() == 0


def test_text(spark):
    d = spark.createDataFrame([(1, "Fast storage, fast search"), (2, "Graph and vector search"), (3, None)], "id long, text string")
    assert rows(text.search(d, "id", "FAST", "text")) == [(1,)]
    assert rows(text.search(d, "id", "search", "text")) == [(1,), (2,)]
    b = {r.id: r.score for r in text.bm25(d, "id", "fast search", ("text",)).collect()}
    assert b[1] > b[2] > 0 and 3 not in b
    assert text.bm25(d, "id", "...", ("text",)).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vector.nearest(v, [0.0, 0.0], 10, allowed=v.where("vec_id in (2, 3)")).collect()] == [2, 3]
    assert vector.nearest(v, [1.0, 1.0], 1).first().vec_id == 2
    assert vector.similar_to(v, 99, 3).count() == 0


def test_geo_and_time(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 20.0, 0.0, 21.0, 1.0)], "id long, min_x double, min_y double, max_x double, max_y double")
    assert [r.id for r in geo.search(b, (5, 5, 6, 6)).collect()] == [1]
    assert [(r.id, r.distance) for r in geo.nearest(b, 12.0, 0.0, 2).collect()] == [(1, 2.0), (2, 8.0)]
    assert [r.id for r in geo.within(b, 12.0, 0.0, 2.0).collect()] == [1]
    t = spark.sql("SELECT timestamp_millis(150L) ts, 1 id UNION ALL SELECT timestamp_millis(250L), 2 UNION ALL SELECT timestamp_millis(-50L), 3")
    assert rows(timeseries.in_range(t, "ts", 120, 170).select("id")) == [(1,)]
    assert rows(t.select("id", timeseries.bucket(t.ts, 100))) == [(1, 100), (2, 200), (3, -100)]


def versions(spark, data):
    return spark.createDataFrame(data, "cf string, key string, seq long, op string, value string, expires_at_ms long")


def test_kv_snapshot_prefix(spark):
    v = versions(spark, [("d", "doc/a", 1, "put", "v1", None), ("d", "doc/b", 2, "put", "v1", None), ("d", "misc/z", 3, "put", "v0", None), ("d", "doc/a", 4, "put", "v2", None), ("d", "doc/b", 5, "delete", None, None), ("d", "doc/c", 6, "put", "v2", None)])
    assert rows(kv.scan_prefix(v, "doc/").select("key", "value")) == [("doc/a", "v2"), ("doc/c", "v2")]
    assert rows(kv.scan_prefix(v, "doc/", snapshot=3).select("key", "value")) == [("doc/a", "v1"), ("doc/b", "v1")]
    assert kv.scan(v, "doc/a", "doc/c").count() == 1


def test_kv_merge_ttl(spark):
    v = versions(spark, [("d", "hits", 1, "merge", "1", None), ("d", "hits", 2, "merge", "2", None), ("d", "t", 3, "put", "9", 1000)])
    assert rows(kv.state(v, now_ms=500, merge="sum_i64").select("key", "value")) == [("hits", 3), ("t", 9)]
    assert rows(kv.state(v, now_ms=1000, merge="sum_i64").select("key", "value")) == [("hits", 3)]
    assert rows(kv.state(v, now_ms=2000).select("value")) == [("12",)]


def test_kv_replay(spark):
    want, data = {}, []
    for i in range(500):
        k = f"key/{(i * 37) % 91:03}"
        if i % 7 == 0:
            want.pop(k, None)
            data.append(("d", k, i, "delete", None, None))
        else:
            want[k] = f"value/{i:04}"
            data.append(("d", k, i, "put", want[k], None))
    assert rows(kv.state(versions(spark, data)).select("key", "value")) == sorted(want.items())


def test_batches(spark):
    b = kv.Batch().put("d", "a", "1")
    at = b.savepoint()
    b.delete("d", "a")
    b.rollback_to(at)
    b.nested().merge("d", "a", "2")
    assert b.rows(spark, 7).count() == 2 and kv.horizon([50, 25], 100) == 25


def test_projection(spark):
    e = spark.createDataFrame([(1, "Insert", "u", "1", "Alice"), (2, "Update", "u", "1", "Bob"), (3, "Insert", "u", "2", "C"), (4, "Delete", "u", "3", None), (5, "Read", "u", "2", None)], "sequence long, kind string, collection string, record_id string, payload string")
    assert rows(projection(e).select("record_id", "payload")) == [("1", "Bob"), ("2", "C")]


def test_nest_join_and_predicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "id long, s string")
    b = spark.createDataFrame([(1, 10), (1, 5), (3, 7)], "k long, v long")
    out = R.nest_join(a, b, "id", "k", "m").collect()
    assert [(r.id, [x.v for x in r.m]) for r in out] == [(1, [5, 10])]
    assert a.where(R.predicate(a, "s", "!=", "x")).count() == 1  # missing is false
    assert a.where(R.predicate(a, "id", "<=", "many")).count() == 0
    assert a.where(R.predicate(a, "none", "=", 1)).count() == 0
    with pytest.raises(ValueError):
        R.aggregate("median", "id")


def test_scalars(spark):
    assert [scalar.literal(x) for x in ("1", "1.5", "true", "null", "abc", '{"a": 1}')] == [1, 1.5, True, None, "abc", {"a": 1}]
    df = spark.createDataFrame([("A", 0)], "a string, n long")
    assert df.select(scalar.computed("a + ' ' + a", df.columns), scalar.computed("n / n", df.columns)).first()[:] == ("A A", 0.0)


def test_catalog(spark):
    df = spark.createDataFrame([(1, "7", "x"), (2, "q", None)], "id long, n string, extra string")
    c = Collection("c", (Attribute("n", "int4"),), mode="strict")
    assert rows(violations(df, c, "id")) == [(1, "extra", "unknown"), (2, "n", "type")]
    assert c.with_attribute(Attribute("m")).version == 2


def test_parser():
    q = parse("SELECT a FROM t WHERE x = 1 OR y <> 'b c' AND z IS NOT NULL LIMIT 5 OFFSET 2")
    assert q.where == Either((Test("x", "=", 1), Both((Test("y", "<>", "b c"), Test("z", "is_not_null")))))
    assert (q.limit, q.offset) == (5, 2)
    q = parse("WITH a AS (SELECT * FROM u WHERE s = 'active'), b AS (SELECT * FROM a) SELECT * FROM b")
    assert [n for n, _ in q.ctes] == ["a", "b"] and not q.recursive
    assert parse("SELECT * FROM t WHERE id = $10", list(range(10))).where.value == 9
    for bad in ("SELECT * FROM t JUNK", "SELECT * FROM t WHERE a ~ 1", "NOTHING"):
        with pytest.raises(ValueError):
            parse(bad)


def test_explain_and_plans():
    text_ = explain(parse("SELECT * FROM t WHERE a = 1 ORDER BY b LIMIT 3"))
    assert "1. Filter" in text_ and "3. Limit" in text_ and "FullScan" in explain(parse("SELECT * FROM t"))
    assert hybrid.plan_order(["Vector", "Search", "Sql", "Graph"]) == ["inverted", "btree", "adjacency", "hnsw_or_ivf"]
    i = IndexSpec("e", ("tenant_id", "created_at"), ("payload",), 1_000_000, 10_000)
    assert i.kind == "composite" and i.key(b"12345678", b"x")[:4] == b"\0\0\0\x08" and i.range_cost() >= i.point_cost() and i.key(b"1") is None


def test_engine_changes(spark):
    e = Engine(spark, {})
    e.sql("CREATE COLLECTION p (name text, age int NULLABLE)")
    e.sql("ALTER COLLECTION p ADD ATTRIBUTE tag text NULLABLE")
    assert [a.name for a in e.schemas["p"].attributes] == ["name", "age", "tag"]
    e.sql("INSERT INTO p 1 SET name = 'A'")
    e.sql("UPDATE p 1 SET age = 3")
    e.sql("INSERT INTO p 2 SET name = 'B'")
    e.sql("DELETE FROM p WHERE id = 2")
    assert [(r.key, r.attributes) for r in e.current("p").collect()] == [("1", {"name": "A", "age": "3"})]


def test_filters_reach_the_scan(spark):
    """Comparisons, whole trees and retention show in the scan's pushed filters."""
    from strataq.queries import QUERIES

    for name, columns in (("pf2_filter", ("l_quantity", "l_returnflag")), ("pf3_filter_tree", ("o_",)), ("sc3_scalar_filter", ("o_orderstatus",)), ("pql_select", ("o_",)), ("t5_retention", ("ts",)), ("t5_drop_before", ("ts",))):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        pushed = " ".join(re.findall(r"PushedFilters: \[(.*), ReadSchema", plan))  # long lists end in dots
        assert re.search(r"GreaterThan|LessThan|EqualTo", pushed) and all(c in pushed for c in columns), (name, pushed)


def test_predicate_literals(spark):
    a = spark.sql("SELECT * FROM VALUES (1, 1.5D, 2.50BD, 'x'), (2, 2.5D, 3.25BD, 'y'), (NULL, NULL, NULL, NULL) t(i, f, d, s)")
    count = lambda *x: a.where(R.predicate(a, *x)).count()
    for op, value, n in (("<", "1.5", 1), ("<=", 1.5, 1), (">", "1.5", 1), (">=", "1.5", 1), ("=", "1.5", 0), ("!=", "1.5", 2), ("<", 2, 1), ("=", "2", 1), (">=", "1e30", 0), ("<", "1e30", 2), ("=", "nan", 0)):
        assert count("i", op, value) == n, (op, value)
    assert count("f", ">", "1.5") == 1 and count("d", "=", "2.5") == 1 and count("d", "<", "2.555") == 1 and count("s", "=", "x") == 1 and count("i", "like", 1) == 0


def test_max_u64_beyond_signed(spark):
    v = spark.createDataFrame([("d", "k", 1, "merge", str((1 << 64) - 2), None), ("d", "k", 2, "merge", "5", None)], "cf string, key string, seq long, op string, value string, expires_at_ms long")
    assert int(kv.state(v, merge="max_u64").first().value) == (1 << 64) - 2


def test_statements_beyond_the_basics(spark):
    rows = spark.createDataFrame([(1, "a%b", 2), (2, "axb", 3), (3, None, 3), (4, "b", None)], "id int, t string, n int")
    e = Engine(spark, {"r": rows, "chain": spark.range(1, 40).selectExpr("id AS src", "CASE WHEN id = 39 THEN 1 ELSE id + 1 END AS dst")}, {"chain": "src"})
    ids = lambda q: sorted(r.id for r in e.sql(q).collect())
    assert ids("SELECT id FROM r WHERE t LIKE 'a%b'") == [1, 2]
    assert ids("SELECT id FROM r WHERE t NOT LIKE 'a%b'") == [4]  # a missing value is on neither side
    assert ids("SELECT id FROM r WHERE NOT nowhere = 1") == []
    assert ids("SELECT id FROM r WHERE n IN (2, 5) OR n BETWEEN 3 AND 3") == [1, 2, 3]
    assert ids("SELECT id FROM r UNION ALL SELECT id FROM r WHERE id = 1 EXCEPT ALL SELECT id FROM r WHERE id > 2") == [1, 1, 2]
    assert ids("SELECT id FROM r INTERSECT SELECT n FROM r") == [2, 3]
    assert ids("WITH RECURSIVE w AS (SELECT dst AS id FROM chain WHERE src = 5 UNION SELECT dst FROM chain SEMI JOIN w ON chain.src = w.id) SELECT id FROM w") == list(range(1, 40))
    e.register("twice", lambda x: None if x is None else 2 * x, "int")
    assert sorted(r.m for r in e.sql("SELECT twice(id) AS m FROM r").collect()) == [2, 4, 6, 8]
    for bad in ("SELECT id FROM r WHERE id IN ()", "SELECT id FROM r WHERE id BETWEEN 1", "SELECT id FROM r UNION", "SELECT AVG(DISTINCT n) AS a FROM r"):
        with pytest.raises(ValueError):
            e.sql(bad)


def test_backup_less_one_row_moves_no_rows(spark, tmp_path, monkeypatch):
    from strataq.queries import QUERIES
    from strataq.sources import files

    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(5).coalesce(1)
    at = str(tmp_path / "orders.parquet")
    rows.limit(0).write.parquet(at)
    empty = QUERIES["sc15_backup_restore"](spark, str(tmp_path)).first()
    assert (empty["n"], empty["total"], empty["same"], empty["same_without_one"]) == (0, None, True, False)
    for _ in range(2):  # every row twice, in two files
        rows.write.mode("append").parquet(at)
    verify, seen = files.verify, []
    monkeypatch.setattr(files, "verify", lambda a, b: seen.append(b) or verify(a, b))
    got = QUERIES["sc15_backup_restore"](spark, str(tmp_path)).first()
    assert (got["n"], got["same"], got["same_without_one"]) == (10, True, False)
    assert [x.count() for x in seen] == [10, 9] and len(set(seen[1].collect())) == 5
    assert not any("Exchange" in x._jdf.queryExecution().executedPlan().toString() for x in seen)
