"""Versioned key-value state and the event log, both over ``events``."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from strataq.operators import events as E
from strataq.operators import kv
from strataq.queries.registry import query
from strataq.session import table

NOW, SNAP = 1706000000000, 8000
TTL = 10 * 86_400_000
V = f"""v AS (SELECT 'users' AS cf, user_id::VARCHAR AS key, event_id AS seq,
 CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'put' WHEN 'signup' THEN 'put' ELSE 'merge' END AS op,
 CASE WHEN event_type = 'error' THEN NULL ELSE round(value * 100)::BIGINT END AS value,
 CASE WHEN event_type = 'signup' THEN (epoch_us(ts) // 1000) + {TTL} END AS expires_at_ms FROM events)"""


def versions(s, d):
    t = F.col("event_type")
    return table(s, d, "events").select(
        F.lit("users").alias("cf"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"),
        F.when(t == "error", "delete").when(t.isin("purchase", "signup"), "put").otherwise("merge").alias("op"),
        F.when(t != "error", F.round(F.col("value") * 100).cast("long")).alias("value"),
        F.when(t == "signup", F.unix_millis(F.col("ts").cast("timestamp")) + TTL).alias("expires_at_ms"),
    )


def fold(merge: str, snapshot: int = kv.LATEST, where: str = "TRUE") -> str:
    last = {"sum_i64": "(coalesce(b, 0) + coalesce(m, 0))::BIGINT", "max_u64": "greatest(coalesce(b, 0), m)::BIGINT"}[merge]
    agg = {"sum_i64": "sum", "max_u64": "max"}[merge]
    return f"""
WITH {V}, w AS (SELECT *, max(seq) FILTER (WHERE op <> 'merge') OVER (PARTITION BY cf, key) AS base FROM v WHERE seq <= {snapshot}),
f AS (SELECT cf, key, max(value) FILTER (WHERE op = 'put' AND seq = base AND (expires_at_ms IS NULL OR expires_at_ms > {NOW})) AS b,
 {agg}(value) FILTER (WHERE op = 'merge' AND (base IS NULL OR seq > base)) AS m FROM w GROUP BY cf, key)
SELECT cf, key, CASE WHEN m IS NULL THEN b ELSE {last} END AS value FROM f WHERE (b IS NOT NULL OR m IS NOT NULL) AND {where}"""


def state(s, d, **o):
    return kv.state(versions(s, d), now_ms=NOW, **({"merge": "sum_i64"} | o))


@query("kv1_get", fold("sum_i64", SNAP, "key = '8'"))
def _(s, d):
    return kv.get(versions(s, d), "8", "users", snapshot=SNAP, now_ms=NOW, merge="sum_i64")


@query("kv2_latest_version", f"WITH {V} SELECT cf, key, max(seq) AS seq, arg_max(op, seq) AS op FROM v WHERE op <> 'merge' AND seq <= {SNAP} GROUP BY cf, key")
def _(s, d):
    return kv.latest_version(versions(s, d), SNAP).select("cf", "key", "seq", "op")


@query("kv3_fold_snapshot", fold("sum_i64", SNAP))
def _(s, d):
    return state(s, d, snapshot=SNAP)


@query("kv4_ttl_puts", f"WITH {V} SELECT key, seq FROM v WHERE op = 'put' AND (expires_at_ms IS NULL OR expires_at_ms > {NOW})")
def _(s, d):
    return versions(s, d).where((F.col("op") == "put") & kv.live("expires_at_ms", NOW)).select("key", "seq")


@query("kv5_sum_i64", fold("sum_i64"))
def _(s, d):
    return state(s, d)


@query("kv6_max_u64", fold("max_u64"))
def _(s, d):
    return state(s, d, merge="max_u64").withColumn("value", F.col("value").cast("long"))


@query("kv7_append_bytes", f"""
WITH {V}, w AS (SELECT *, max(seq) FILTER (WHERE op <> 'merge') OVER (PARTITION BY cf, key) AS base FROM v),
f AS (SELECT cf, key, max(value) FILTER (WHERE op = 'put' AND seq = base AND (expires_at_ms IS NULL OR expires_at_ms > {NOW})) AS b,
 string_agg(value::VARCHAR, '' ORDER BY seq) FILTER (WHERE op = 'merge' AND (base IS NULL OR seq > base)) AS m FROM w GROUP BY cf, key)
SELECT cf, key, coalesce(b::VARCHAR, '') || coalesce(m, '') AS value FROM f WHERE b IS NOT NULL OR m IS NOT NULL""")
def _(s, d):
    return state(s, d, merge="append_bytes")


@query("kv8_compare_and_swap", f"WITH st AS ({fold('sum_i64')}) SELECT cf, key FROM st WHERE value % 2 = 0")
def _(s, d):
    now = state(s, d)
    requests = now.select("cf", "key", F.when(F.col("value") % 2 == 0, F.col("value")).otherwise(F.lit(-1)).alias("expected"), F.lit(0).alias("value"))
    v = versions(s, d).where(kv.live("expires_at_ms", NOW) | (F.col("op") != "put")).unionByName(versions(s, d).where(~kv.live("expires_at_ms", NOW) & (F.col("op") == "put")).withColumn("op", F.lit("delete")).withColumn("expires_at_ms", F.lit(None).cast("long")))
    return kv.compare_and_swap(v, requests, merge="sum_i64").select("cf", "key")


@query("kv9_conflicts", f"WITH {V} SELECT cf, key FROM (SELECT DISTINCT cf, key FROM v WHERE seq < 2000) WHERE key IN (SELECT key FROM v WHERE seq > 9900)")
def _(s, d):
    v = versions(s, d)
    return kv.conflicts(v, v.where("seq < 2000").select("cf", "key").distinct(), 9900)


def batch_fold(rows: str) -> str:
    """The append fold over literal rows (key, seq, op_index, op, value)."""
    return f"""
WITH v(key, seq, i, op, value) AS (VALUES {rows}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, i) AS r FROM v),
w AS (SELECT *, max(r) FILTER (WHERE op <> 'merge') OVER (PARTITION BY key) AS base FROM o),
f AS (SELECT key, max(value) FILTER (WHERE op = 'put' AND r = base) AS b, string_agg(value, '' ORDER BY r) FILTER (WHERE op = 'merge' AND (base IS NULL OR r > base)) AS m FROM w GROUP BY key)
SELECT key, coalesce(b, '') || coalesce(m, '') AS value FROM f WHERE b IS NOT NULL OR m IS NOT NULL"""


@query("kv11_write_batch", batch_fold("""
 ('a', 1, 0, 'put', '9'), ('a', 1, 1, 'put', '1'), ('b', 1, 2, 'put', '5'), ('b', 1, 3, 'delete', NULL), ('c', 1, 4, 'merge', '7'), ('c', 1, 5, 'put', '1'),
 ('d', 1, 6, 'merge', 'b'), ('d', 1, 7, 'merge', 'a'), ('e', 1, 8, 'delete', NULL), ('e', 1, 9, 'put', '3'), ('d', 2, 0, 'merge', 'z'), ('a', 2, 1, 'merge', '0')"""))
def _(s, d):
    one = kv.Batch().put("x", "a", "9").put("x", "a", "1").put("x", "b", "5").delete("x", "b").merge("x", "c", "7").put("x", "c", "1")
    one.merge("x", "d", "b").merge("x", "d", "a").delete("x", "e").put("x", "e", "3")
    two = kv.Batch().merge("x", "d", "z").merge("x", "a", "0")
    return kv.state(one.rows(s, 1).unionByName(two.rows(s, 2))).select("key", "value")


@query("kv12_nested_savepoint", batch_fold("('a', 1, 0, 'put', '1'), ('b', 1, 1, 'put', '2'), ('a', 1, 2, 'merge', 'x'), ('a', 1, 3, 'merge', 'y'), ('c', 1, 4, 'delete', NULL)"))
def _(s, d):
    """A child's operations follow its parent's, whenever they came; what a savepoint rolls back never was."""
    parent = kv.Batch().put("x", "a", "1")
    child = parent.nested().merge("x", "a", "x")
    mark = parent.savepoint()
    parent.delete("x", "a").put("x", "c", "9")
    parent.rollback_to(mark)
    parent.put("x", "b", "2")
    child.merge("x", "a", "y").nested().delete("x", "c")
    return kv.state(parent.rows(s, 1)).select("key", "value")


@query("kv14_compact_leveled", f"WITH {V}, m AS (SELECT *, max(seq) OVER (PARTITION BY cf, key) AS top, max(seq) FILTER (WHERE seq <= 3000) OVER (PARTITION BY cf, key) AS pinned FROM v) SELECT key, seq FROM m WHERE seq = pinned OR (seq = top AND op <> 'delete' AND (expires_at_ms IS NULL OR expires_at_ms > {NOW}))")
def _(s, d):
    return kv.compact(versions(s, d), "leveled", (3000,), NOW).select("key", "seq")


@query("kv14_compact_tiered", f"WITH {V} SELECT key, seq FROM v WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW}")
def _(s, d):
    return kv.compact(versions(s, d), "tiered", now_ms=NOW).select("key", "seq")


@query("kv14_compact_universal", f"WITH {V} SELECT key, seq FROM v WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW} QUALIFY row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC) <= 4")
def _(s, d):
    return kv.compact(versions(s, d), "universal", now_ms=NOW).select("key", "seq")


LIFE = f"WITH {V}, life AS (SELECT key, seq AS create_seq, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS delete_seq FROM v)"


def life(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("seq")
    return versions(s, d).select("key", F.col("seq").alias("create_seq"), F.lead("seq").over(w).alias("delete_seq"))


@query("kv15_gc_horizon", f"{LIFE} SELECT key, create_seq FROM life WHERE delete_seq <= 2500")
def _(s, d):
    return kv.collectable(life(s, d), kv.horizon([5000, 2500], 10000)).select("key", "create_seq")


@query("pf11_mvcc_visible", f"{LIFE} SELECT key, create_seq FROM life WHERE create_seq <= 4000 AND (delete_seq IS NULL OR delete_seq > 4000)")
def _(s, d):
    return life(s, d).where(kv.mvcc_visible("create_seq", "delete_seq", 4000)).select("key", "create_seq")


@query("pf10_ttl_visible", f"WITH {V} SELECT seq FROM v WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW}")
def _(s, d):
    return versions(s, d).where(kv.live("expires_at_ms", NOW)).select("seq")


@query("kv16_index_stats", f"WITH {V}, k AS (SELECT cf, key, count(*) AS n, arg_max(op, seq) AS last FROM v GROUP BY cf, key) SELECT cf, count(*) FILTER (WHERE last <> 'delete') AS live_keys, sum(n)::BIGINT AS versions, (sum(n) - count(*) FILTER (WHERE last <> 'delete'))::BIGINT AS stale FROM k GROUP BY cf")
def _(s, d):
    return kv.index_stats(versions(s, d))


@query("kv17_fetch_by_index", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def _(s, d):
    index = table(s, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("rid"))
    return kv.fetch_by_index(index, table(s, d, "customer"), "2-HIGH", "c_custkey").select("c_custkey", "c_name")


@query("sc7_get_at", fold("sum_i64", 500, "key = '11'"))
def _(s, d):
    return kv.get(versions(s, d), "11", "users", snapshot=500, now_ms=NOW, merge="sum_i64")


@query("sc8_kv_scan", f"SELECT * FROM ({fold('sum_i64', kv.LATEST, '''key >= '2' AND key < '5' ''')}) ORDER BY key LIMIT 30")
def _(s, d):
    return kv.scan(versions(s, d), "2", "5", 30, now_ms=NOW, merge="sum_i64")


@query("sc9_prefix_scan", fold("sum_i64", SNAP, "key LIKE '1%'"))
def _(s, d):
    return kv.scan_prefix(versions(s, d), "1", now_ms=NOW, snapshot=SNAP, merge="sum_i64")


KINDS = "CASE event_type WHEN 'error' THEN 'Delete' WHEN 'signup' THEN 'Insert' WHEN 'view' THEN 'Read' ELSE 'Update' END"


def log(s, d):
    t = F.col("event_type")
    return table(s, d, "events").select(
        F.col("event_id").alias("sequence"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.lit("users").alias("collection"), F.col("user_id").cast("string").alias("record_id"),
        F.when(t == "error", "Delete").when(t == "signup", "Insert").when(t == "view", "Read").otherwise("Update").alias("kind"), F.col("props").alias("payload"),
    )


@query("st1_events_since", f"SELECT event_id AS sequence, {KINDS} AS kind FROM events WHERE event_id >= 9000")
def _(s, d):
    return E.since(log(s, d), 9000, "users").select("sequence", "kind")


@query("st2_projection", f"SELECT user_id::VARCHAR AS record_id, arg_max(props, event_id) AS payload FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def _(s, d):
    return E.projection(log(s, d)).select("record_id", "payload")


@query("st3_hash_chain", """
WITH h AS (SELECT event_id, sha256(concat_ws(':', event_id, repeat('0', 64), (epoch_us(ts) // 1000), event_type, 'users', substr(props, 1, 32))) AS hash FROM events)
SELECT event_id AS sequence FROM h WHERE event_id <> (SELECT min(event_id) FROM events)""")
def _(s, d):
    # every event claims the genesis hash as its predecessor, so all but the first are broken
    e = log(s, d).withColumn("previous_hash", F.lit(E.GENESIS))
    e = e.withColumn("hash", E.link(F.col("previous_hash")))
    return E.broken_links(e)


@query("st3_tampered", "SELECT * FROM (VALUES (5::BIGINT), (9), (10)) t(sequence)")
def _(s, d):
    """A valid chain of twelve events, but for a payload changed afterwards (5) and an event put anew in place of 9, to which 10 does not link."""
    rows, before = [], E.GENESIS
    for i in range(1, 13):
        said = ":".join((str(i), before if i != 9 else "f" * 64, str(1000 * i), "Update", "users", f"payload {i}"))
        mine = hashlib.sha256(said.encode()).hexdigest()
        rows.append((i, before if i != 9 else "f" * 64, 1000 * i, "Update", "users", "forged" if i == 5 else f"payload {i}", mine))
        before = mine if i != 9 else "e" * 64
    return E.broken_links(s.createDataFrame(rows, "sequence long, previous_hash string, timestamp_ms long, kind string, collection string, payload string, hash string"))


@query("st3_link_hash", f"SELECT event_id AS sequence, sha256(concat_ws(':', event_id, repeat('0', 64), (epoch_us(ts) // 1000), {KINDS}, 'users', substr(props, 1, 32))) AS hash FROM events")
def _(s, d):
    return log(s, d).select("sequence", E.link(F.lit(E.GENESIS)).alias("hash"))


@query("st4_replay_from", "SELECT event_id AS sequence FROM events WHERE event_id >= 9500")
def _(s, d):
    return E.replay_from(log(s, d), 9500).select("sequence")


@query("st1_ring", "SELECT event_id AS sequence FROM events ORDER BY event_id DESC LIMIT 1000")
def _(s, d):
    return E.ring(log(s, d), 1000).select("sequence")
