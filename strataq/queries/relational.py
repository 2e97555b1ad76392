"""Scans, filters, joins, aggregates, windows, sorting, scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataq.functions import scalar
from strataq.operators import relational as R
from strataq.queries.registry import query
from strataq.session import shared_dir, table
from strataq.sources import files


def orders(s, d):
    return table(s, d, "orders")


@query("sc1_collection_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(s, d):
    return orders(s, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("sc2_point_get", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def _(s, d):
    return orders(s, d).where(F.col("o_orderkey") == 7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("sc3_scalar_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    o = orders(s, d)
    return o.where(R.predicate(o, "o_orderstatus", "=", "F")).select("o_orderkey", "o_orderpriority")


@query("sc4_scalar_index_range", "SELECT c_mktsegment, c_custkey FROM customer WHERE c_mktsegment > 'AUTOMOBILE' AND c_mktsegment <= 'HOUSEHOLD'")
def _(s, d):
    c = table(s, d, "customer")
    return c.where((F.col("c_mktsegment") > "AUTOMOBILE") & (F.col("c_mktsegment") <= "HOUSEHOLD")).select("c_mktsegment", "c_custkey")


@query("sc5_btree_range", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def _(s, d):
    return orders(s, d).where((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 900)).select("o_orderkey")


@query("sc6_lsm_scan", "SELECT p_partkey, p_brand FROM part WHERE p_partkey >= 50 AND p_partkey < 150")
def _(s, d):
    return table(s, d, "part").where((F.col("p_partkey") >= 50) & (F.col("p_partkey") < 150)).select("p_partkey", "p_brand")


@query("sc12_bitmap_postings", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(s, d):
    return table(s, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("sc15_backup_restore", "SELECT count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS total, TRUE AS same, FALSE AS same_without_one FROM orders")
def _(s, d):
    """A backup restored, digested against its source, and against the source less one row."""
    path = f"{shared_dir(s)}/backup-{uuid.uuid4().hex}"
    files.backup(orders(s, d), path)
    back = files.restore(s, path)
    less = files.without_first(orders(s, d))
    same, other = files.verify(back, orders(s, d)), less is not None and files.verify(back, less)
    return back.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total")).select("n", "total", F.lit(same).alias("same"), F.lit(other).alias("same_without_one"))


@query("pf1_projection", "SELECT c_custkey, c_name FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name")


@query("pf2_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag <> 'N'")
def _(s, d):
    t = table(s, d, "lineitem")
    return t.where(R.predicate(t, "l_quantity", ">=", 45) & R.predicate(t, "l_returnflag", "!=", "N")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("pf3_filter_tree", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice > 200000 OR o_orderpriority = '1-URGENT')")
def _(s, d):
    o = orders(s, d)
    p = lambda *a: R.predicate(o, *a)
    return o.where(R.all_of(p("o_orderstatus", "=", "O"), R.any_of(p("o_totalprice", ">", 200000), p("o_orderpriority", "=", "1-URGENT")))).select("o_orderkey")


@query("pf4_null_tests", "SELECT count(*) FILTER (WHERE quality IS NULL) AS missing, count(*) FILTER (WHERE quality IS NOT NULL) AS present FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return j.agg(F.count(F.when(R.predicate(j, "quality", "is_null"), 1)).alias("missing"), F.count(F.when(R.predicate(j, "quality", "is_not_null"), 1)).alias("present"))


@query("pf6_columnar_masks", "SELECT event_id, event_type = 'click' AS is_click, event_id BETWEEN 100 AND 5000 AS in_range FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", (F.col("event_type") == "click").alias("is_click"), F.col("event_id").between(100, 5000).alias("in_range"))


@query("pf8_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(s, d):
    return orders(s, d).select("o_orderstatus", "o_orderpriority").distinct()


@query("pf8_distinct_by_id", "SELECT l_orderkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    return R.distinct_by_id(table(s, d, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("pf9_intersect_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(s, d):
    rich = orders(s, d).where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.intersect_by_id(table(s, d, "customer"), rich, "c_custkey").select("c_custkey", "c_name")


@query("j1_nest_join", "SELECT c_custkey, count(*) AS n, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(s, d):
    j = R.nest_join(table(s, d, "customer").select("c_custkey"), orders(s, d).select("o_custkey", "o_orderkey", "o_totalprice"), "c_custkey", "o_custkey", "join.orders")
    a = F.col("`join.orders`")
    keys = F.transform(a, lambda x: x["o_orderkey"])
    total = F.aggregate(a, F.lit(0.0), lambda t, x: t + x["o_totalprice"])
    return j.select("c_custkey", F.size(a).cast("long").alias("n"), F.array_min(keys).alias("first_order"), F.array_max(keys).alias("last_order"), F.round(total, 2).alias("total"))


@query("j2_multi_join", "SELECT o.o_orderkey, (SELECT count(*) FROM customer WHERE c_custkey = o.o_custkey) AS customers, (SELECT count(*) FROM lineitem WHERE l_orderkey = o.o_orderkey) AS lines FROM orders o WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def _(s, d):
    base = orders(s, d).select("o_orderkey", "o_custkey")
    j = R.nest_join(base, table(s, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", "cs")
    j = R.nest_join(j, table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "o_orderkey", "l_orderkey", "ls")
    return j.select("o_orderkey", F.size("cs").cast("long").alias("customers"), F.size("ls").cast("long").alias("lines"))


@query("j3_flat_join", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY n_name")
def _(s, d):
    j = orders(s, d).join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j4_candidate_join", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(s, d):
    c = table(s, d, "customer").where("c_mktsegment = 'BUILDING'")
    c = c.join(orders(s, d).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return c.join(table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey")


@query("a1_a5_aggregates", "SELECT count(l_quantity) AS n, count(*) AS n_all, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def _(s, d):
    g = lambda f: R.aggregate(f, "l_quantity")
    return table(s, d, "lineitem").agg(g("count").alias("n"), R.aggregate("count").alias("n_all"), F.round(g("sum"), 2).alias("total"), F.round(g("avg"), 6).alias("mean"), g("min").alias("low"), g("max").alias("high"))


@query("a2_a3_empty", "SELECT coalesce(sum(o_totalprice), 0.0::DOUBLE) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS low FROM orders WHERE o_orderkey < 0")
def _(s, d):
    return orders(s, d).where("o_orderkey < 0").agg(R.aggregate("sum", "o_totalprice").alias("total"), R.aggregate("avg", "o_totalprice").alias("mean"), R.aggregate("min", "o_totalprice").alias("low"))


@query("a8_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query("a9_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
def _(s, d):
    return orders(s, d).groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@query("a15_percentiles", """
WITH v AS (SELECT event_type, list_sort(list(value)) AS a, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, a[1 + least(floor(0.5 * n), n - 1)::BIGINT] AS p50, a[1 + least(floor(0.95 * n), n - 1)::BIGINT] AS p95, a[1 + least(floor(0.99 * n), n - 1)::BIGINT] AS p99 FROM v""")
def _(s, d):
    return R.nearest_rank(table(s, d, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ("event_type",))


@query("a15_histogram", "SELECT CASE WHEN value <= 1 THEN 'le_1ms' WHEN value <= 10 THEN 'le_10ms' WHEN value <= 100 THEN 'le_100ms' WHEN value <= 1000 THEN 'le_1s' ELSE 'gt_1s' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(R.latency_bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


@query("w1_w2_windows", """
SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr,
 lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key,
 count(*) OVER w AS running_n, (sum(o_orderkey) OVER w)::BIGINT AS running_sum
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def _(s, d):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return orders(s, d).select(
        "o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(p).cast("long").alias("rk"), F.dense_rank().over(p).cast("long").alias("dr"),
        F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"), F.first("o_orderkey").over(w).alias("first_key"),
        F.last("o_orderkey").over(w).alias("last_key"), F.count("*").over(w).alias("running_n"), F.sum("o_orderkey").over(w).alias("running_sum"),
    )


@query("l1_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def _(s, d):
    return R.sort_by(orders(s, d), "o_totalprice", "o_orderkey", descending=True).select("o_orderkey", "o_totalprice").limit(100)


@query("l2_l3_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 25 OFFSET 40")
def _(s, d):
    return R.sort_by(orders(s, d), "o_orderdate", "o_orderkey").select("o_orderkey").offset(40).limit(25)


@query("l4_l5_rank_by_text", "SELECT doc_id, round(len(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) + sqrt(strlen(text)), 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20")
def _(s, d):
    score = F.round(scalar.text_relevance(F.col("text")), 6)
    return table(s, d, "documents").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("l6_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(s, d):
    return table(s, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("u2_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def _(s, d):
    return s.sql("WITH RECURSIVE t(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@query("u2_cte", "WITH a AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT r_name, n FROM a JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    return s.sql("WITH a AS (SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY 1) SELECT r_name, n FROM a JOIN {region} ON r_regionkey = n_regionkey", nation=table(s, d, "nation"), region=table(s, d, "region"))


@query("u3_set_intersection", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(s, d):
    return orders(s, d).where("o_orderstatus = 'F'").select("o_custkey").intersect(orders(s, d).where("o_orderstatus = 'O'").select("o_custkey"))


@query("s1_s3_computed_fields", "SELECT o_orderkey, o_orderstatus AS copy, o_orderstatus || ' ' || o_orderpriority AS label, CASE WHEN o_custkey = 0 THEN 0.0 ELSE round(o_totalprice / o_custkey, 3) END AS per_customer, round(o_totalprice * 2.0, 4) AS twice FROM orders")
def _(s, d):
    o = orders(s, d)
    c = lambda e: scalar.computed(e, o.columns)
    return o.select("o_orderkey", c("o_orderstatus").alias("copy"), c("o_orderstatus + ' ' + o_orderpriority").alias("label"), F.round(c("o_totalprice / o_custkey"), 3).alias("per_customer"), F.round(c("o_totalprice * 2.0"), 4).alias("twice"))


@query("s3_division_by_zero", "SELECT event_id, 0.0::DOUBLE AS ratio FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", scalar.arithmetic(F.col("value"), "/", F.lit(0)).alias("ratio"))


@query("s11_composite_key", "SELECT c_custkey, lpad(hex(strlen(c_mktsegment)), 8, '0') || hex(encode(c_mktsegment)) || lpad(hex(strlen(c_name)), 8, '0') || hex(encode(c_name)) AS k FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.hex(scalar.composite_key(F.col("c_mktsegment"), F.col("c_name"))).alias("k"))


@query("s13_heat_tiers", "WITH h AS (SELECT user_id, ((count(*) FILTER (WHERE event_type = 'view') + 4 * count(*) FILTER (WHERE event_type = 'purchase')) * 1000) // greatest(max(event_id) % 100, 1) AS score FROM events GROUP BY user_id) SELECT user_id, score, CASE WHEN score >= 1000 THEN 'hot' WHEN score >= 100 THEN 'warm' ELSE 'cold' END AS tier FROM h")
def _(s, d):
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    h = table(s, d, "events").groupBy("user_id").agg(scalar.heat(n("view"), n("purchase"), F.max("event_id") % 100).alias("score"))
    return h.withColumn("tier", scalar.tier(F.col("score")))


@query("s15_literals", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000.5 AND o_custkey <= 700 AND o_orderstatus = 'O'")
def _(s, d):
    o = orders(s, d)
    return o.where(R.all_of(*[R.predicate(o, a, op, scalar.literal(v)) for a, op, v in (("o_totalprice", ">", "150000.5"), ("o_custkey", "<=", "700"), ("o_orderstatus", "=", "O"))])).select("o_orderkey")


@query("s16_parameters", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 42 AND o_orderstatus = 'F'")
def _(s, d):
    return s.sql("SELECT o_orderkey, o_custkey FROM {o} WHERE o_custkey = :key AND o_orderstatus = :status", args={"key": 42, "status": "F"}, o=orders(s, d))
