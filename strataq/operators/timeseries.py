"""Time ranges, buckets and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def in_range(df: DataFrame, ts: str, start: int, end: int) -> DataFrame:
    """Closed interval of epoch milliseconds; a time counts as its whole millisecond."""
    return df.where(F.col(ts).cast("timestamp").between(F.timestamp_millis(F.lit(start)), F.timestamp_micros(F.lit(end * 1000 + 999))))


def bucket(ts: Column, width_ms: int) -> Column:
    """Start of the bucket; floors, so times before 1970 fall into the right one."""
    return F.floor(ms(ts) / F.lit(width_ms)).cast("long") * F.lit(width_ms)


def latest(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(ts), key).limit(n)


def oldest(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return df.orderBy(ts, key).limit(n)


def retained(df: DataFrame, ts: str, width_ms: int, retention_ms: int, now_ms: int) -> DataFrame:
    """Without whole buckets that start before now - retention."""
    return drop_before(df, ts, width_ms, now_ms - retention_ms)


def drop_before(df: DataFrame, ts: str, width_ms: int, cutoff_ms: int) -> DataFrame:
    """Without whole buckets that start before the cutoff: times from the first kept bucket's start on, so scans can skip the rest."""
    first = -(-cutoff_ms // width_ms) * width_ms
    return df.where(F.col(ts) >= F.timestamp_millis(F.lit(first)).cast(df.schema[ts].dataType))
