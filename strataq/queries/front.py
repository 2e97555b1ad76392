"""The statement language and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.operators.catalog import Attribute, Collection, violations, with_computed
from strataq.plans.build import Engine, graphql
from strataq.queries import graphs
from strataq.queries.registry import query
from strataq.session import table


def engine(s, d, *names, edges=None):
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id", "embeddings": "vec_id", "events": "event_id", "nation": "n_nationkey"}
    return Engine(s, {n: table(s, d, n) for n in names}, keys, edges)


@query("pql_select", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice >= 250000 OR o_custkey <= 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(s, d):
    return engine(s, d, "orders").sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice >= 250000 OR o_custkey <= 10) ORDER BY o_totalprice DESC LIMIT 50")


@query("pql_group_by", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus HAVING count(*) > 10")
def _(s, d):
    out = engine(s, d, "orders").sql("SELECT o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders GROUP BY o_orderstatus HAVING n > 10")
    return out.withColumn("total", F.round("total", 2))


@query("pql_distinct_params", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_custkey < 100")
def _(s, d):
    return engine(s, d, "orders").sql("SELECT DISTINCT o_orderpriority FROM orders WHERE o_custkey < $1", [100])


@query("pql_window", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC)::INTEGER AS rn FROM orders")
def _(s, d):
    return engine(s, d, "orders").sql("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders")


@query("pql_cte", "WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey FROM f WHERE o_totalprice > 100000")
def _(s, d):
    return engine(s, d, "orders").sql("WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey FROM f WHERE o_totalprice > 100000")


@query("pql_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_acctbal > 5000")
def _(s, d):
    return engine(s, d, "customer", "orders").sql("SELECT c_custkey FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey WHERE c_acctbal > 5000")


@query("pql_like_in_between", "SELECT o_orderkey FROM orders WHERE (o_orderpriority LIKE '%URGENT' OR o_orderstatus IN ('F', 'P')) AND o_totalprice BETWEEN 1000 AND 90000 AND NOT (o_custkey < 50 OR o_orderpriority LIKE '5%') AND o_custkey NOT IN (60, 61)")
def _(s, d):
    return engine(s, d, "orders").sql("SELECT o_orderkey FROM orders WHERE (o_orderpriority LIKE '%URGENT' OR o_orderstatus IN ('F', 'P')) AND o_totalprice BETWEEN 1000 AND 90000 AND NOT (o_custkey < 50 OR o_orderpriority LIKE '5%') AND o_custkey NOT IN (60, 61)")


@query("pql_left_join", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def _(s, d):
    out = engine(s, d, "customer", "orders").sql("SELECT * FROM customer LEFT JOIN orders ON customer.c_custkey = orders.o_custkey")
    return out.select("c_custkey", F.coalesce(F.size("`join.orders`"), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0).cast("long")))


@query("pql_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(s, d):
    return engine(s, d, "customer", "orders").sql("WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) SELECT c_custkey FROM customer LEFT ANTI JOIN big ON customer.c_custkey = big.o_custkey")


@query("pql_full_join", "SELECT n_nationkey, s_nationkey, coalesce(k, 0)::BIGINT AS k FROM (SELECT n_nationkey FROM nation WHERE n_nationkey < 12) FULL JOIN (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_nationkey > 5 GROUP BY s_nationkey) ON n_nationkey = s_nationkey")
def _(s, d):
    out = engine(s, d, "nation", "supplier").sql("WITH n AS (SELECT n_nationkey FROM nation WHERE n_nationkey < 12), s AS (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey > 5) SELECT * FROM n FULL JOIN s ON n.n_nationkey = s.s_nationkey")
    many = F.col("`join.s`")
    return out.select("n_nationkey", many[0]["s_nationkey"].alias("s_nationkey"), F.when(many.isNull(), 0).otherwise(F.size(many)).cast("long").alias("k"))


@query("pql_set_operations", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def _(s, d):
    return engine(s, d, "customer", "supplier", "nation").sql("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")


@query("pql_with_recursive", f"WITH RECURSIVE {graphs.EDGES}, r(id) AS (SELECT dst FROM e WHERE src = 1 UNION SELECT e.dst FROM e JOIN r ON e.src = r.id) SELECT id FROM r")
def _(s, d):
    e = Engine(s, {"e": graphs.edges(s, d).select("src", "dst")}, {"e": "src"})
    return e.sql("WITH RECURSIVE r AS (SELECT dst AS id FROM e WHERE src = 1 UNION SELECT dst FROM e SEMI JOIN r ON e.src = r.id) SELECT id FROM r")


@query("pql_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS near, lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM orders")
def _(s, d):
    out = engine(s, d, "orders").sql("SELECT o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near, LAG(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM orders")
    return out.withColumn("near", F.round("near", 2))


@query("pql_rollup", "SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS who, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(s, d):
    return engine(s, d, "orders").sql("SELECT o_orderstatus, o_orderpriority, COUNT(DISTINCT o_custkey) AS who, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")


@query("pql_functions", "SELECT c_custkey, upper(c_name) AS name, substring(c_name, 1, 4) AS head, abs(c_acctbal) AS size FROM customer")
def _(s, d):
    return engine(s, d, "customer").sql("SELECT c_custkey, UPPER(c_name) AS name, SUBSTRING(c_name, 1, 4) AS head, ABS(c_acctbal) AS size FROM customer")


@query("pql_find_match", "SELECT doc_id FROM documents WHERE lang = 'en' AND instr(lower(text), 'all rights reserved') > 0 ORDER BY doc_id LIMIT 15")
def _(s, d):
    return engine(s, d, "documents").sql("FIND documents WHERE lang = 'en' MATCH text 'All Rights Reserved' TOP 15").select("doc_id")


@query("pql_find_similar", "SELECT vec_id FROM (SELECT vec_id, label FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 5)) DESC, vec_id LIMIT 20) WHERE label < 8")
def _(s, d):
    return engine(s, d, "embeddings").sql("FIND embeddings WHERE label < 8 SIMILAR TO 5 TOP 20").select("vec_id")


@query("pql_find_traverse", f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT id FROM ({graphs.bfs(2)}))")
def _(s, d):
    return engine(s, d, "customer", edges=graphs.edges(s, d, True)).sql("FIND customer TRAVERSE 1 2 HOPS").select("c_custkey")


@query("pql_as_of", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id <= 4000 GROUP BY user_id")
def _(s, d):
    e = table(s, d, "events")
    rows = e.select("user_id", "event_type", F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.lit("main").alias("branch"))
    return Engine(s, {"users": rows.select("user_id", "event_type")}, {"users": "user_id"}, history={"users": rows}).sql("FIND users AS OF COMMIT 4000")


@query("pql_rank_by_graph", f"WITH {graphs.EDGES}, g AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT c_custkey FROM customer LEFT JOIN g ON src = c_custkey ORDER BY coalesce(n, 0) DESC, c_custkey LIMIT 12")
def _(s, d):
    return engine(s, d, "customer", edges=graphs.edges(s, d)).sql("FIND customer RANK BY connectivity LIMIT 12").select("c_custkey")


@query("pql_graphql", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey")
def _(s, d):
    return engine(s, d, "customer").sql(graphql('{ customer(where: "c_nationkey = 3") { c_custkey c_name } }'))


@query("pql_scalar", "SELECT 1 AS n")
def _(s, d):
    return engine(s, d).sql("SELECT COUNT(*) AS n").select(F.col("n").cast("int").alias("n"))


@query("m1_m3_mutations", "SELECT * FROM (VALUES ('a', 'name', 'Ann'), ('a', 'age', '31'), ('c', 'name', 'Cy')) AS t(key, attribute, value)")
def _(s, d):
    e = engine(s, d)
    for line in ("INSERT INTO people a SET name = 'Al', age = 30", "INSERT INTO people b SET name = 'Bo'", "UPDATE people a SET name = 'Ann', age = 31", "DELETE FROM people b", "INSERT INTO people c SET name = 'Cy'"):
        e.sql(line)
    return e.current("people").select("key", F.explode("attributes").alias("attribute", "value"))


@query("m1_m3_select_changed", "SELECT c_custkey, CASE WHEN c_custkey = 2 THEN 'Zed' WHEN c_custkey = 900000001 THEN 'New' ELSE c_name END AS c_name, CASE WHEN c_custkey = 2 THEN -5.5 WHEN c_custkey = 900000001 THEN NULL ELSE c_acctbal END AS c_acctbal FROM (SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT 900000001, 'x', 0) WHERE c_custkey <> 3 AND (c_custkey < 20 OR c_custkey = 900000001)")
def _(s, d):
    e = engine(s, d, "customer")
    e.keys["customer"] = "c_custkey"
    for line in ("UPDATE customer 2 SET c_name = 'Zed'", "DELETE FROM customer 3", "INSERT INTO customer 900000001 SET c_name = 'Old', c_acctbal = 4", "UPDATE customer 900000002 SET c_name = 'nobody'", "UPDATE customer 2 SET c_acctbal = -5.5", "INSERT INTO customer 900000001 SET c_name = 'New'"):
        e.sql(line)
    return e.sql("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey < 20 OR c_custkey = 900000001")


@query("m4_created_collection", "SELECT * FROM (VALUES ('1', 'A', 3), ('2', 'B', NULL)) AS t(id, name, age)")
def _(s, d):
    e = engine(s, d)
    for line in ("CREATE COLLECTION p (name text, age int NULLABLE)", "INSERT INTO p 1 SET name = 'A', age = 2", "INSERT INTO p 2 SET name = 'B'", "INSERT INTO p 3 SET name = 'C'", "UPDATE p 1 SET age = 3", "DELETE FROM p WHERE id = 3"):
        e.sql(line)
    return e.sql("SELECT id, name, age FROM p")


@query("m6_explain", "SELECT 2 AS steps")
def _(s, d):
    return engine(s, d, "orders").sql("EXPLAIN SELECT * FROM orders WHERE o_custkey = 1 LIMIT 5").where(F.col("plan").rlike(r"^  \d+\.")).agg(F.count("*").cast("int").alias("steps"))


@query("sc11_show_collections", "SELECT * FROM (VALUES ('customer'), ('orders')) AS t(name)")
def _(s, d):
    return engine(s, d, "orders", "customer").sql("SHOW COLLECTIONS")


@query("cat_violations", "SELECT doc_id, 'quality' AS attribute, 'missing' AS problem FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL UNION ALL SELECT doc_id, 'source', 'type' FROM documents WHERE try_cast(source AS BIGINT) IS NULL AND source IS NOT NULL")
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return violations(rows, Collection("docs", (Attribute("quality", "int4", nullable=False), Attribute("source", "int8"))), "doc_id")


@query("cat_strict", "SELECT p_partkey, 'p_brand' AS attribute, 'unknown' AS problem FROM part WHERE p_brand IS NOT NULL")
def _(s, d):
    return violations(table(s, d, "part").select("p_partkey", "p_name", "p_brand"), Collection("part", (Attribute("p_name"),), mode="strict"), "p_partkey")


@query("cat_vector_dimensions", "SELECT vec_id, 'embedding' AS attribute, 'dimensions' AS problem FROM embeddings WHERE len(embedding) <> 32")
def _(s, d):
    return violations(table(s, d, "embeddings").select("vec_id", "embedding"), Collection("v", (Attribute("embedding", dimensions=32),)), "vec_id")


@query("cat_computed", "SELECT s_suppkey, round(s_acctbal * 3, 4) AS triple, s_name || '!' AS shout FROM supplier")
def _(s, d):
    c = Collection("s", computed={"triple": ("s_acctbal * 3", "double"), "shout": ("s_name + '!'", "string")})
    return with_computed(table(s, d, "supplier"), c).select("s_suppkey", F.round("triple", 4).alias("triple"), "shout")
