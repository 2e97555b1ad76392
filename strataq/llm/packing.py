"""Packing of documents into fixed windows by Karmarkar-Karp differencing.

Every task packs the documents it scans; nothing is shuffled.  A document's
whole windows become sequences of their own.  What is left of it joins a pool;
when the pool holds ``group_windows`` windows' worth of tokens, multiway
differencing deals its pieces to windows: each piece starts as a partial
partition with one loaded window, and the two partial partitions with the
largest spread are merged again and again, heaviest windows onto lightest, so
that their imbalances cancel.  If a window exceeds the capacity, the deal is
done again with more windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.bpe import default_path, encoded
from strataq.llm.common import release

#: sequence ids: the task's number times this, plus a count from 0
SEQUENCES_A_TASK = 1 << 40


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items of the given sizes to ``k`` windows; returns item numbers by window.

    Karmarkar-Karp: ties break on the order in which partitions were made, so
    the same sizes always give the same deal.  Empty input gives empty windows.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # both hold their loaded windows, heaviest first; the rest are empty
        over = max(0, len(a) + len(b) - k)
        lone, tail, turn = len(b) - over, a[len(a) - over :], b[len(b) - over :][::-1]
        merged = a[: len(a) - over] + b[:lone] + [(x + y, (m, n)) for (x, m), (y, n) in zip(tail, turn)]
        merged.sort(key=itemgetter(0), reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, made, merged))
        made += 1
    out = []
    for _, tree in heap[0][2]:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            todo.extend(x) if isinstance(x, tuple) else items.append(x)
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows none of which exceeds ``capacity``.

    The count starts at the least that could hold everything and rises by what
    the fullest window exceeds the capacity.
    """
    if any(s > capacity for s in sizes):
        raise ValueError("a piece is larger than the capacity")
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        dealt = difference(sizes, k)
        most = max(sum(sizes[i] for i in w) for w in dealt)
        if most <= capacity:
            return [w for w in dealt if w]
        k += max(1, (most - capacity) * k // capacity)


class _Packer:
    """The pieces of one task's documents, in the order in which they come."""

    def __init__(self, capacity: int, group_windows: int, cut: int, slack: int, first: int):
        self.capacity, self.cut = capacity, cut
        self.room = group_windows * (capacity - slack)
        self.next, self.pool, self.held = first, [], 0

    def add(self, doc, ids: memoryview) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while n - at >= self.capacity:
            yield doc, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], n, self.next, 0, self.capacity
            self.next += 1
            at += self.capacity
        while at < n:
            size = min(self.cut, n - at, self.room - self.held)
            self.pool.append((doc, at, size, bytes(ids[4 * at : 4 * (at + size)]), n))
            self.held += size
            at += size
            if self.held >= self.room:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for w in windows([p[2] for p in self.pool], self.capacity) if self.pool else ():
            full, offset = sum(self.pool[i][2] for i in w), 0
            for i in w:
                doc, at, size, ids, n = self.pool[i]
                yield doc, at, size, ids, n, self.next, offset, full
                offset += size
            self.next += 1
        self.pool, self.held = [], 0


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = 1024,
    end_id: int = 0,
    group_windows: int = 128,
    cut: int = 256,
    slack: int = 1,
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row a piece: ``doc_id, start, length, ids`` (little-endian unsigned
    32-bit), ``doc_tokens, sequence_id, offset, sequence_tokens``.  A document
    is its ids and then ``end_id``.  Null and empty texts have only the end id;
    a null id is kept as null; repeated rows are packed as often as they come;
    an empty table gives no rows; columns other than the two named are not
    read, so clashing names do no harm.  Texts of any length are cut freely.
    Memory: one Arrow batch and ``group_windows`` windows a task.  The scan must
    be repeatable (files or a checkpoint): a task that runs again then packs
    the same documents under the same sequence ids.
    """
    path = tokenizer_path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([
        ("doc_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("start", pa.int64()), ("length", pa.int64()),
        ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()),
    ])
    spark_kind = kind if kind in ("bigint", "int") else "string"
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, group_windows, cut, slack, TaskContext.get().partitionId() * SEQUENCES_A_TASK)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows, size = [], 0
        for doc, ids in encoded(batches, path):
            for piece in packer.add(doc, memoryview(ids + end)):
                rows.append(piece)
                size += piece[2]
                if size >= 1 << 19:
                    yield batch(rows)
                    rows, size = [], 0
                    release()  # what the encoder has used meanwhile is twice what it keeps
        rows += packer.flush()
        if rows:
            yield batch(rows)

    chosen = docs.select(F.col(id_col).cast(spark_kind).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {spark_kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long")
