"""Boxes, time series, and streams over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataq.functions import boxes as B
from strataq.operators import geo, timeseries
from strataq.queries.registry import query
from strataq.session import shared_dir, table
from strataq.streaming import watch

BOXES = "b AS (SELECT p_partkey AS id, p_size::DOUBLE AS min_x, p_retailprice AS min_y, p_size + (p_partkey % 5)::DOUBLE AS max_x, p_retailprice + (p_partkey % 11)::DOUBLE AS max_y FROM part)"


def boxes(s, d):
    k = F.col("p_partkey")
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(s, d, "part").select(k.alias("id"), x.alias("min_x"), y.alias("min_y"), (x + (k % 5).cast("double")).alias("max_x"), (y + (k % 11).cast("double")).alias("max_y"))


@query("ge1_box_search", f"WITH {BOXES} SELECT id FROM b WHERE min_x <= 20 AND max_x >= 10 AND min_y <= 960 AND max_y >= 930")
def _(s, d):
    return geo.search(boxes(s, d), (10, 930, 20, 960)).select("id")


@query("ge2_point_search", f"WITH {BOXES} SELECT id FROM b WHERE 15 BETWEEN min_x AND max_x AND 950 BETWEEN min_y AND max_y")
def _(s, d):
    return geo.search_point(boxes(s, d), 15.0, 950.0).select("id")


DIST = "sqrt(greatest(min_x - 15.0, 0, 15.0 - max_x) ** 2 + greatest(min_y - 950.0, 0, 950.0 - max_y) ** 2)"


@query("ge3_knn", f"WITH {BOXES} SELECT id, round({DIST}, 6) AS distance FROM b ORDER BY {DIST}, id LIMIT 12")
def _(s, d):
    return geo.nearest(boxes(s, d), 15.0, 950.0, 12).select("id", F.round("distance", 6).alias("distance"))


@query("ge4_within_distance", f"WITH {BOXES} SELECT id, round({DIST}, 6) AS distance FROM b WHERE {DIST} <= 25.0")
def _(s, d):
    return geo.within(boxes(s, d), 15.0, 950.0, 25.0).select("id", F.round("distance", 6).alias("distance"))


@query("s10_box_measures", f"WITH {BOXES} SELECT id, round((max_x - min_x) * (max_y - min_y), 4) AS area, min_x >= 0 AND max_x <= 30 AND min_y >= 910 AND max_y <= 980 AS inside, round((greatest(max_x, 30) - least(min_x, 0)) * (greatest(max_y, 980) - least(min_y, 910)), 4) AS merged_area FROM b")
def _(s, d):
    a, q = B.Box.of(), B.Box.lit(0, 910, 30, 980)
    return boxes(s, d).select("id", F.round(B.area(a), 4).alias("area"), B.contains(q, a).alias("inside"), F.round(B.area(B.merge(a, q)), 4).alias("merged_area"))


START, DAY, HOUR = 1704412800000, 86_400_000, 3_600_000


def events(s, d):
    return table(s, d, "events")


@query("t1_time_range", f"SELECT event_id, user_id FROM events WHERE (epoch_us(ts) // 1000) BETWEEN {START} AND {START + 2 * DAY}")
def _(s, d):
    return timeseries.in_range(events(s, d), "ts", START, START + 2 * DAY).select("event_id", "user_id")


@query("a13_count_range", f"SELECT count(*) AS n FROM events WHERE (epoch_us(ts) // 1000) BETWEEN {START} AND {START + 5 * DAY}")
def _(s, d):
    return timeseries.in_range(events(s, d), "ts", START, START + 5 * DAY).agg(F.count("*").alias("n"))


@query("l7_latest_oldest", "(SELECT 'latest' AS side, event_id FROM events ORDER BY ts DESC, event_id LIMIT 10) UNION ALL (SELECT 'oldest', event_id FROM events ORDER BY ts, event_id LIMIT 10)")
def _(s, d):
    e = events(s, d)
    new = timeseries.latest(e, "ts", "event_id", 10).select(F.lit("latest").alias("side"), "event_id")
    return new.unionByName(timeseries.oldest(e, "ts", "event_id", 10).select(F.lit("oldest").alias("side"), "event_id"))


@query("t4_tumbling", f"SELECT ((epoch_us(ts) // 1000) // {HOUR} * {HOUR})::BIGINT AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return events(s, d).groupBy(timeseries.bucket(F.col("ts"), HOUR).alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("t5_retention", f"SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) // {DAY} * {DAY} >= {START + 20 * DAY} - {10 * DAY}")
def _(s, d):
    return timeseries.retained(events(s, d), "ts", DAY, 10 * DAY, START + 20 * DAY).select("event_id")


@query("t5_drop_before", f"SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) // {DAY} * {DAY} >= {START + 3 * DAY}")
def _(s, d):
    return timeseries.drop_before(events(s, d), "ts", DAY, START + 3 * DAY).select("event_id")


def _folders(s):
    return f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"


def _stream(s, d):
    e = events(s, d).schema
    return watch.source(s, d, e, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st_tumbling_stream", f"SELECT ((epoch_us(ts) // 1000) // {DAY} * {DAY})::BIGINT AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    out = _folders(s)
    agg = watch.tumbling(_stream(s, d), "ts", "1 day", "1 day", "event_type", n=F.count("*"))
    watch.run_to_end(agg, watch.append_to(f"{out}/rows"), f"{out}/checkpoint", "complete")
    return s.read.parquet(f"{out}/rows").select("start_ms", "event_type", "n")


@query("m7_watch", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 10")
def _(s, d):
    out = _folders(s)
    seen = watch.watch(_stream(s, d), (F.col("event_type") == "error") & (F.col("value") > 10)).select("event_id", "user_id")
    watch.run_to_end(seen, watch.append_to(f"{out}/rows"), f"{out}/checkpoint")
    return s.read.parquet(f"{out}/rows").select("event_id", "user_id")


@query("st2_projection_stream", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(s, d):
    out = _folders(s)
    last = watch.latest_by_sequence(_stream(s, d), "user_id", "event_id", "event_type")
    watch.run_to_end(last, watch.append_to(f"{out}/rows"), f"{out}/checkpoint", "complete")
    return s.read.parquet(f"{out}/rows").select("user_id", "event_id", "event_type")
