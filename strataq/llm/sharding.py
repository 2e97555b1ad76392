"""Sharding by a two-pass external shuffle.

Pass one scatters records over buckets that fit in memory, by a seeded hash.
Pass two shuffles every bucket with Fisher-Yates and writes it.  The buckets one
after another are a uniform permutation of all records, and shard ``s`` is the
``s``-th of ``n`` equal stretches of it: counts are at most one apart, and almost
every bucket lies in a single shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import written

#: bytes of text that a bucket should hold
BUCKET_BYTES = 24 << 20
#: bytes, about, that a task hands back at a time
OUT_BYTES = 2 << 20


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1: from the end, swap each place with one at or before it."""
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    out = order.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def shard(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: tuple[str, ...] = (),
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Records with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Carried: the id, the text and ``columns``; nothing else is read, so other
    columns' names cannot clash.  Null ids and texts are records like any other.
    Repeated rows are hashed with their place in the scan, so a key that holds a
    third of all rows is scattered like the rest.  An empty table gives no rows.
    The scan must be repeatable (files or a checkpoint).  A task holds one
    bucket; the driver sees one count a bucket.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in columns])
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)
    total = chosen.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    keyed = chosen.withColumn("_place", F.xxhash64(F.lit(seed), F.col("doc_id"), F.monotonically_increasing_id()))
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_place")), F.lit(buckets)).cast("int"))
    scattered = keyed.repartitionById(buckets, F.col("_bucket"))
    names = chosen.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        bucket = TaskContext.get().partitionId()
        place = np.concatenate([np.asarray(x.column(x.num_columns - 2)) for x in got])
        rows = pa.Table.from_batches(got).select(names).combine_chunks()
        got.clear()
        n = rows.num_rows
        # fetches arrive in any order; a hash decides
        order = np.argsort(place, kind="stable")[fisher_yates(n, np.random.default_rng([seed, bucket]))]
        step = max(1, OUT_BYTES * n // max(1, rows.nbytes))
        for at in range(0, n, step):  # the bucket is held once, its output piece by piece
            part = rows.take(pa.array(order[at : at + step]))
            part = part.append_column("_bucket", pa.array(np.full(len(part), bucket, np.int32)))
            yield from part.append_column("_at", pa.array(np.arange(at, at + len(part)))).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    shuffled = written(scattered.mapInArrow(run, f"{fields}, _bucket int, _at long"), "shards")
    before, starts = 0, []
    for b, n in sorted(tuple(r) for r in shuffled.groupBy("_bucket").count().collect()):
        starts.append((b, before))
        before += n
    base = docs.sparkSession.createDataFrame(starts, "_bucket int, _base long")
    out = shuffled.join(F.broadcast(base), "_bucket").withColumn("_place", F.col("_base") + F.col("_at"))
    rows = max(1, before)
    out = out.withColumn("shard", F.expr(f"cast((_place * {n_shards}L) div {rows}L as int)"))
    first = F.expr(f"(shard * {rows}L + {n_shards}L - 1L) div {n_shards}L")
    return out.withColumn("slot", F.col("_place") - first).select(*names, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, its files in the order of the slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
