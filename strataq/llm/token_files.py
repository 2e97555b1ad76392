"""Token-id files: documents as Simple-8b images, and the way back.

A file of the format is a Parquet data set of segments, so that Spark's commit
protocol holds for it and any store that Spark reads will do.  A segment holds
some whole documents in ascending id order as two Simple-8b images: their ids one
after another, and their lengths.  Shards are consecutive ranges of ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import simple8b
from strataq.llm.bpe import default_path, encoded
from strataq.llm.common import scratch_dir

#: ids after which a segment ends (a longer document has a segment of its own)
SEGMENT_IDS = 1 << 20
#: chunks that a worker's encoder keeps when it has twice as many
CACHE_ENTRIES = 300_000


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = 2,
    block: int = 512,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode whole texts and write them to ``path`` in ascending id order.

    Null and empty texts have only the end id; null ids come first; repeated ids
    stand side by side; an empty table gives a data set without segments.  Only
    the two named columns are read.  One range shuffle; a task holds a segment.
    """
    tok = tokenizer_path or default_path()
    kind = "bigint" if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    key = pa.int64() if kind == "bigint" else pa.string()
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(key)), ("lengths", pa.binary()), ("ids", pa.binary())])
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        keys, parts, sizes, before, segment = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [shard, segment, before, len(ids), keys, simple8b.encode(np.array(sizes, np.uint64), block), simple8b.encode(ids, block)]
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema)], schema=schema)

        held = 0
        for doc, ids in encoded(batches, tok, CACHE_ENTRIES):
            keys.append(doc)
            parts.append(ids + end)
            sizes.append(len(parts[-1]) // 4)
            held += sizes[-1]
            if held >= segment_ids:
                yield close()
                before, segment, held = before + held, segment + 1, 0
                keys, parts, sizes = [], [], []
        if keys:
            yield close()

    chosen = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text"))
    ranged = chosen.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ranged.mapInArrow(run, f"shard int, segment int, ids_before long, n_ids long, doc_ids array<{kind}>, lengths binary, ids binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) from the files.

    ``start`` counts the ids of all documents before.  The driver sees one count
    a shard, whose number the writer's partitions bound.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    base, bases = 0, []
    for shard, n in sorted((r.shard, r.n) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        bases.append((shard, base))
        base += n
    starts = spark.createDataFrame(bases, "shard int, base long")
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, keys, lengths, image in zip(*(c.to_pylist() for c in b.columns)):
                sizes = simple8b.decode(lengths).astype(np.int64)
                ids = simple8b.decode(image).astype("<u4")
                ends = np.cumsum(sizes)
                data = memoryview(ids.tobytes())
                texts = [bytes(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), pa.array(at + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], schema=schema)

    segments = files.join(F.broadcast(starts), "shard").select((F.col("base") + F.col("ids_before")).alias("at"), "doc_ids", "lengths", "ids")
    return segments.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a data set in the shared folder and read it back."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    return read_tokens(spark, path)
