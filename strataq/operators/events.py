"""Event log: replay to a projection, the hash chain, replication replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def since(events: DataFrame, seq: int, collection: str | None = None) -> DataFrame:
    rows = events.where(F.col("sequence") >= seq)
    return rows if collection is None else rows.where(F.col("collection") == collection)


def projection(events: DataFrame) -> DataFrame:
    """``collection, record_id, payload`` after all inserts, updates and deletes; other kinds and events without a record are skipped."""
    rows = events.where(F.col("record_id").isNotNull() & F.col("kind").isin("Insert", "Update", "Delete"))
    last = rows.groupBy("collection", "record_id").agg(F.max_by(F.struct("kind", "payload"), "sequence").alias("v"))
    return last.where(F.col("v.kind") != "Delete").select("collection", "record_id", F.col("v.payload").alias("payload"))


def link(previous: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.col("sequence"), previous, F.col("timestamp_ms"), F.col("kind"), F.col("collection"), F.substring("payload", 1, 32)), 256)


def broken_links(events: DataFrame) -> DataFrame:
    """Events ``sequence, hash, previous_hash, ...`` whose link or own hash is wrong.

    The predecessor is joined by sequence, so no window puts the log in one task;
    the first event's predecessor is the genesis hash.
    """
    first = events.agg(F.min("sequence").alias("_first"))
    before = events.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("_before"))
    rows = events.join(before, "sequence", "left").crossJoin(F.broadcast(first))
    expected = F.when(F.col("sequence") == F.col("_first"), F.lit(GENESIS)).otherwise(F.col("_before"))
    bad = ~F.col("previous_hash").eqNullSafe(expected) | ~F.col("hash").eqNullSafe(link(F.col("previous_hash")))
    return rows.where(bad).select("sequence")


def replay_from(log: DataFrame, position: int) -> DataFrame:
    return log.where(F.col("sequence") >= position)


def ring(events: DataFrame, capacity: int) -> DataFrame:
    """The newest ``capacity`` events."""
    return events.orderBy(F.desc("sequence")).limit(capacity)


def latest_two(events: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("sequence"))
    return events.withColumn("_n", F.row_number().over(w)).where("_n <= 2").drop("_n")
