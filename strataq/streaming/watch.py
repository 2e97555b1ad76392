"""Structured Streaming: watching a change log, tumbling windows, projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def source(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def watch(stream: DataFrame, condition: Column | None = None) -> DataFrame:
    """Changes as they come, optionally only those that meet a condition."""
    return stream if condition is None else stream.where(condition)


def tumbling(stream: DataFrame, ts: str, width: str, late: str, *by: str, **aggregates: Column) -> DataFrame:
    """Windowed aggregates; the watermark bounds state and drops what is later."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.unix_millis("window.start").alias("start_ms"), *by, *aggregates)


def sessions(stream: DataFrame, ts: str, gap: str, late: str, *by: str, **aggregates: Column) -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.unix_millis("session_window.start").alias("start_ms"), F.unix_millis("session_window.end").alias("end_ms"), *by, *aggregates)


def latest_by_sequence(stream: DataFrame, key: str, sequence: str, *values: str) -> DataFrame:
    """Last write by sequence, not by arrival, of each key (complete or update mode)."""
    last = stream.groupBy(key).agg(F.max_by(F.struct(sequence, *values), sequence).alias("v"))
    return last.select(key, f"v.{sequence}", *[f"v.{c}" for c in values])


def run_to_end(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, batch by batch; a restart goes on from the checkpoint."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that writes each batch to its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
