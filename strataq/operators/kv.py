"""Versioned key-value state: an append-only table ``cf, key, seq[, op_index], op, value, expires_at_ms``.

Versions are in the order of their sequence and, within a batch, of ``op_index``.

``op`` is put, merge or delete.  Reading folds a key's versions up to a snapshot:
the last put or delete is the base (an expired put is none), later merges apply
to it in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATEST = (1 << 63) - 1


def _sum_i64(base: Column, deltas: Column) -> Column:
    return F.coalesce(base.cast("long"), F.lit(0)) + F.coalesce(F.sum(deltas.cast("long")), F.lit(0))


def _max_u64(base: Column, deltas: Column) -> Column:
    return F.greatest(F.coalesce(base.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")), F.max(deltas.cast("decimal(20,0)")))


def _append(base: Column, deltas: Column) -> Column:
    parts = F.array_sort(F.collect_list(F.when(deltas.isNotNull(), F.struct("_at", deltas.cast("string").alias("v")))))
    return F.concat(F.coalesce(base.cast("string"), F.lit("")), F.array_join(F.transform(parts, lambda p: p["v"]), ""))


#: merge operators by name; a new one is a function of (base, deltas) to an aggregate
MERGES = {"sum_i64": _sum_i64, "max_u64": _max_u64, "append_bytes": _append}


def live(expires: str, now_ms: int) -> Column:
    return F.col(expires).isNull() | (F.col(expires) > F.lit(now_ms))


def mvcc_visible(create: str, delete: str, snapshot: int) -> Column:
    return (F.col(create) <= snapshot) & (F.col(delete).isNull() | (F.col(delete) > snapshot))


def _placed(versions: DataFrame) -> DataFrame:
    """With ``_at``, the place of a version in the order of all."""
    index = F.col("op_index") if "op_index" in versions.columns else F.lit(0)
    return versions.withColumn("_at", F.struct(F.col("seq").alias("seq"), index.alias("op_index")))


def state(versions: DataFrame, snapshot: int = LATEST, now_ms: int = 0, merge: str = "append_bytes") -> DataFrame:
    """``cf, key, value`` of what is visible at the snapshot.  One shuffle, on (cf, key)."""
    base_at = F.max(F.when(F.col("op") != "merge", F.col("_at"))).over(Window.partitionBy("cf", "key"))
    rows = _placed(versions.where(F.col("seq") <= snapshot)).withColumn("_base", base_at)
    rows = rows.where(F.col("_base").isNull() | (F.col("_at") >= F.col("_base")))
    is_base = (F.col("op") == "put") & (F.col("_at") == F.col("_base")) & live("expires_at_ms", now_ms)
    base = F.max(F.when(is_base, F.col("value")))
    is_delta = F.col("op") == "merge"
    folded = MERGES[merge](base, F.when(is_delta, F.col("value")))
    out = rows.groupBy("cf", "key").agg(base.alias("_put"), F.count(F.when(is_delta, 1)).alias("_n"), folded.alias("_folded"))
    kind = out.schema["_folded"].dataType.simpleString()
    return out.where(F.col("_put").isNotNull() | (F.col("_n") > 0)).select("cf", "key", F.when(F.col("_n") > 0, F.col("_folded")).otherwise(F.col("_put").cast(kind)).alias("value"))


def get(versions: DataFrame, key, cf: str, **options) -> DataFrame:
    return state(versions.where((F.col("key") == key) & (F.col("cf") == cf)), **options)


def scan(versions: DataFrame, start=None, end=None, limit: int | None = None, **options) -> DataFrame:
    """Half-open key range in key order; bounds are pushed below the fold."""
    if start is not None:
        versions = versions.where(F.col("key") >= start)
    if end is not None:
        versions = versions.where(F.col("key") < end)
    out = state(versions, **options).orderBy("cf", "key")
    return out if limit is None else out.limit(limit)


def scan_prefix(versions: DataFrame, prefix: str, limit: int | None = None, **options) -> DataFrame:
    out = state(versions.where(F.col("key").startswith(prefix)), **options).orderBy("cf", "key")
    return out if limit is None else out.limit(limit)


def latest_version(versions: DataFrame, snapshot: int = LATEST) -> DataFrame:
    """The last put or delete of each key."""
    rows = _placed(versions.where((F.col("seq") <= snapshot) & (F.col("op") != "merge")))
    return rows.groupBy("cf", "key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "_at").alias("v")).select("cf", "key", "seq", "v.op", "v.value")


def compare_and_swap(versions: DataFrame, requests: DataFrame, merge: str = "append_bytes") -> DataFrame:
    """Requests ``cf, key, expected, value`` whose key is in the expected state (null: absent)."""
    now = state(versions, merge=merge).withColumnRenamed("value", "_now")
    return requests.join(now, ["cf", "key"], "left").where(F.col("_now").cast("string").eqNullSafe(F.col("expected").cast("string"))).drop("_now")


def conflicts(versions: DataFrame, writes: DataFrame, snapshot: int) -> DataFrame:
    """Written keys whose latest version is newer than the snapshot."""
    newer = versions.where(F.col("seq") > snapshot).select("cf", "key").distinct()
    return writes.join(newer, ["cf", "key"], "left_semi")


def compact(versions: DataFrame, style: str, pins: tuple[int, ...] = (), now_ms: int = 0, keep: int = 4) -> DataFrame:
    """Versions that compaction keeps.

    leveled: each key's newest if it is live, and what each pinned snapshot sees;
    tiered: all unexpired; universal: the newest few unexpired.
    """
    fresh = versions.where(live("expires_at_ms", now_ms))
    if style == "tiered":
        return fresh
    w = Window.partitionBy("cf", "key").orderBy(F.desc("_at"))
    if style == "universal":
        return _placed(fresh).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n", "_at")
    whole = Window.partitionBy("cf", "key")
    kept = (F.col("_at") == F.max("_at").over(whole)) & (F.col("op") != "delete") & live("expires_at_ms", now_ms)
    for p in pins:
        kept = kept | (F.col("_at") == F.max(F.when(F.col("seq") <= p, F.col("_at"))).over(whole))
    return _placed(versions).withColumn("_k", F.coalesce(kept, F.lit(False))).where("_k").drop("_k", "_at")


def horizon(pins: list[int], latest: int) -> int:
    return min(pins) if pins else latest


def collectable(versions: DataFrame, at: int, delete: str = "delete_seq") -> DataFrame:
    return versions.where(F.col(delete) <= at)


def index_stats(versions: DataFrame) -> DataFrame:
    """``cf, live_keys, versions, stale``, the most stale first."""
    keys = _placed(versions).groupBy("cf", "key").agg(F.count("*").alias("n"), F.max_by("op", "_at").alias("last"))
    out = keys.groupBy("cf").agg(F.count(F.when(F.col("last") != "delete", 1)).alias("live_keys"), F.sum("n").alias("versions"))
    return out.withColumn("stale", F.col("versions") - F.col("live_keys")).orderBy(F.desc("stale"), "cf")


def fetch_by_index(index: DataFrame, records: DataFrame, key, rid: str) -> DataFrame:
    """Records that the index key points to; dangling pointers find nothing."""
    return records.join(index.where(F.col("key") == key).select("rid"), records[rid] == F.col("rid"), "left_semi")


class Batch:
    """Writes that share one sequence; savepoints and nested batches are lists of operations."""

    def __init__(self, parent: Batch | None = None):
        self.ops: list[tuple] = []
        self.parent, self.children = parent, []

    def put(self, cf, key, value, ttl_at_ms=None) -> Batch:
        self.ops.append((cf, key, "put", value, ttl_at_ms))
        return self

    def merge(self, cf, key, value) -> Batch:
        self.ops.append((cf, key, "merge", value, None))
        return self

    def delete(self, cf, key) -> Batch:
        self.ops.append((cf, key, "delete", None, None))
        return self

    def savepoint(self) -> int:
        return len(self.ops)

    def rollback_to(self, savepoint: int) -> None:
        del self.ops[savepoint:]

    def nested(self) -> Batch:
        self.children.append(Batch(self))
        return self.children[-1]

    def all_ops(self) -> list[tuple]:
        """Own operations, then the children's."""
        return self.ops + [op for c in self.children for op in c.all_ops()]

    def rows(self, spark, seq: int) -> DataFrame:
        return spark.createDataFrame([(cf, k, seq, i, op, v, e) for i, (cf, k, op, v, e) in enumerate(self.all_ops())], "cf string, key string, seq long, op_index int, op string, value string, expires_at_ms long")
