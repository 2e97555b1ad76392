"""N-gram Jaccard self-join by chosen paths.

A document is its set of word shingles.  Equal sets form a class; one member
stands for it.  Each set has a signature of minimum hashes.  A path is a sequence
of signature places with their values: at the root of every run some places are
chosen, sets that agree on one share its bucket, and buckets that are still large
are split on places which the path itself chooses, and so on.  Small buckets are
compared by brute force on signatures, those still large at the last level in
pairs of blocks.
Runs are repeated until the chance that a pair at the threshold has met reaches
the target recall.  Pairs that may be similar join groups, and within the groups
all pairs are verified on whole shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import tidy, written
from strataq.llm.components import components

PLACES = 64
#: places chosen at the root, and at each later node, of a path
ROOT_PLACES, NODE_PLACES = 8, 6
#: members up to which a bucket is compared rather than split; members of a verified block
LEAF, BLOCK = 12288, 2048
#: rows of a verified block whose pairs are judged at once
STRIP = 128
LEVELS = 3

_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; a shorter text that has words has one."""
    words = text.encode("utf-8", "replace").translate(_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.flatnonzero(np.diff(out, prepend=out[:1] + np.uint64(1)))]


def _places(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, PLACES, np.uint32)[:, None] | np.uint32(1), rng.integers(0, 1 << 32, PLACES, np.uint32)[:, None]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    low = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(low, (x[None, at : at + 4096] * a + b).min(1), out=low)
    return low


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold has met with the target chance.

    A pair survives a level if one chosen place agrees; places agree with the
    chance of the similarity, and a pair goes through all levels at worst.
    """
    alone = (1 - (1 - threshold) ** ROOT_PLACES) * (1 - (1 - threshold) ** (NODE_PLACES - 2)) ** (LEVELS - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alone)))


def _walk(m: int, reach) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of m nodes; ``reach(x, rest)`` marks those of ``rest`` next to x.

    Every node is compared with the nodes not yet reached only, so a group of
    mutually similar sets costs one comparison each.
    """
    rest, left, right = np.arange(m), [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = reach(x, rest)
            if hit.any():
                new = rest[hit]
                left.append(np.full(len(new), x))
                right.append(new)
                queue += new.tolist()
                rest = rest[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal leading key columns, of a partition sorted by them."""
    held: list[pa.RecordBatch] = []

    def same(x: pa.RecordBatch, i: int, y: pa.RecordBatch, j: int) -> bool:
        return all(x.column(k)[i].as_py() == y.column(k)[j].as_py() for k in range(keys))

    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k)) for k in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        if held and not same(held[-1], held[-1].num_rows - 1, b, 0):
            yield pa.Table.from_batches(held)
            held = []
        for i, (s, e) in enumerate(zip(edges, edges[1:])):
            held.append(b.slice(s, e - s))
            if i < len(edges) - 2:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _signatures(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u4").reshape(-1, PLACES)


def _similar_signatures(sig: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the sets whose signatures agree in ``least`` places or more."""
    held: list = [None, None]

    def reach(x: int, rest: np.ndarray) -> np.ndarray:
        if held[0] is not rest:  # copied only when the rest has shrunk
            held[:] = [rest, sig[rest]]
        return (held[1] == sig[x]).sum(1) >= least

    return _walk(len(sig), reach)


def _compare(buckets: DataFrame, least: int) -> DataFrame:
    """Edges (a forest of each part) of buckets ``path, part, row, sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = ([], []), 0
        for t in _groups(batches, 2):
            if t.num_rows < 2:
                continue
            rows, sig = np.asarray(t.column("row")), _signatures(t.column("sig"))
            x, y = _similar_signatures(sig, least)
            out[0].append(rows[x])
            out[1].append(rows[y])
            n += len(x)
            if n > 100_000:
                yield pa.RecordBatch.from_pydict({"u": np.concatenate(out[0]), "v": np.concatenate(out[1])})
                out, n = ([], []), 0
        if n:
            yield pa.RecordBatch.from_pydict({"u": np.concatenate(out[0]), "v": np.concatenate(out[1])})

    dealt = buckets.repartition("path", "part").sortWithinPartitions("path", "part")
    return dealt.select("path", "part", "row", "sig").mapInArrow(tidy(run), "u long, v long")


def _in_blocks(members: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """Adds ``part`` and ``side``: groups of up to ``block`` have one part, larger ones a part for each pair of blocks."""
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("row"), F.col("_blocks")).cast("int")
    out = members.withColumn("_blocks", blocks).withColumn("side", own)
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    pair = lambda o: F.least(F.col("side"), o) * F.col("_blocks") + F.greatest(F.col("side"), o)
    parts = out.withColumn("_parts", F.transform(others, pair)).select("*", F.explode("_parts").alias("part"))
    return parts.drop("_parts")


def _candidates(sets: DataFrame, runs: int, threshold: float) -> DataFrame:
    """Edges ``u, v`` between sets ``row, n, sig`` whose signatures agree well enough."""
    # five standard deviations below the threshold: about one pair in three million is missed here
    least = max(1, math.floor(PLACES * threshold - 5 * math.sqrt(PLACES * threshold * (1 - threshold))))
    value = lambda i: F.substring("sig", i * 4 + 1, 4)
    edges = None
    for run in range(runs):
        rng = np.random.default_rng(7 + run)
        chosen = sorted(rng.choice(PLACES, ROOT_PLACES, replace=False).tolist())
        roots = F.array(*[F.xxhash64(F.lit(run), F.lit(i), value(i)) for i in chosen])
        level = sets.select("row", F.explode(roots).alias("path"))
        for depth in range(LEVELS):
            sizes = level.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
            level = level.join(sizes, "path").join(sets.select("row", "sig"), "row")
            level = written(level, "paths")
            last = depth == LEVELS - 1
            small = level if last else level.where(F.col("members") <= LEAF)
            found = _compare(_in_blocks(small, "path", "members", LEAF), least)
            edges = found if edges is None else edges.unionByName(found)
            large = level.where(F.col("members") > LEAF)
            if last or large.isEmpty():
                break
            # a node's places follow from its path, so all its members use the same
            choice = [F.pmod(F.xxhash64("path", F.lit(depth), F.lit(j)), F.lit(PLACES)).cast("int") for j in range(NODE_PLACES)]
            children = F.array_distinct(F.array(*[F.xxhash64("path", c, F.substring("sig", c * 4 + 1, F.lit(4))) for c in choice]))
            level = large.select("row", F.explode(children).alias("path"))
    return edges


def _verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links of groups ``root, part, side, blocks, row, copies, text``: rows ``row, links, v``.

    ``links`` counts documents in other classes that are similar to the row;
    ``v`` joins it to its class (a forest); rows without links do not come back.
    """
    top, bottom = 1000, round(1000 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2):
            if t.num_rows < 2:
                continue
            rows, copies, side = (np.asarray(t.column(c)) for c in ("row", "copies", "side"))
            sets = [shingles(x.as_py() or "", n) for x in t.column("text")]
            links, u, v = _exact(rows, copies, side, sets, bottom, top)
            got = np.flatnonzero(links)
            extra = [(x, 0, y) for x, y in zip(u.tolist(), v.tolist())]
            out = [(int(rows[i]), int(links[i]), int(rows[i])) for i in got] + extra
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["row", "links", "v"])

    dealt = members.repartition("root", "part").sortWithinPartitions("root", "part")
    return dealt.select("root", "part", "side", "row", "copies", "text").mapInArrow(tidy(run), "row long, links long, v long")


def _exact(rows: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], bottom: int, top: int):
    """Similar documents of each row and a forest of the similar pairs, on whole sets."""
    m = len(rows)
    sizes = np.array([len(s) for s in sets], np.int64)
    two = len(set(side.tolist())) == 2
    shared = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    keep = np.bincount(code)[code] > 1  # a shingle of one set is shared with none
    owner, code = owner[keep], code[keep]
    if len(code):
        dense = np.unique(code, return_inverse=True)[1]
        order = np.argsort(dense, kind="stable")
        owner, dense = owner[order], dense[order]
        width = max(1, min(int(dense[-1]) + 1, 16_000_000 // m))
        for at in range(0, int(dense[-1]) + 1, width):
            s, e = np.searchsorted(dense, [at, at + width])
            x = np.zeros((m, width), np.float32)
            x[owner[s:e], dense[s:e] - at] = 1
            shared += x @ x.T
            del x
    del values, owner, code, keep
    # whole numbers take eight bytes a pair: a strip of rows at a time
    linked, links = np.zeros((m, m), bool), np.zeros(m, np.int64)
    for at in range(0, m, STRIP):
        part = slice(at, min(at + STRIP, m))
        both = shared[part].astype(np.int64)
        union = sizes[part, None] + sizes[None, :] - both
        linked[part] = (top * both >= bottom * union) & (union > 0)
        if two:
            linked[part] &= side[part, None] != side[None, :]
        else:
            linked[np.arange(at, part.stop), np.arange(at, part.stop)] = False
        links[part] = linked[part].astype(copies.dtype) @ copies
    del shared
    i, j = _walk(m, lambda x, rest: linked[x, rest])
    return links, rows[i], rows[j]


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """``row, doc_id, class_id, n_links, n_shingles`` of every row.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    ``n_links`` counts the other rows whose sets have a Jaccard similarity of the
    threshold or more; ``class_id`` is the least id that a row reaches by links.
    Rows of equal sets are all linked.  A text of fewer than n words has one
    shingle, all its words; empty, null and wordless texts are linked to the
    texts equal to them only (null counts as empty).  Null ids are allowed (a
    class of none but null ids has a null id); repeated rows are copies; an empty
    table gives no rows; only the two named columns are read.  The scan must be
    repeatable (files or a checkpoint).
    """
    a, b = _places(1)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("row", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for row, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py()
                    s = shingles(text, n)
                    body = s.tobytes() if len(s) else text.encode("utf-8", "replace")
                    out.append((row, hashlib.blake2b(body, digest_size=16, person=b"set" if len(s) else b"text").digest(), len(s), signature(s, a, b).tobytes() if len(s) else b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    signed = base.select("row", "text").mapInArrow(tidy(sign), "row long, key binary, n long, sig binary")
    signed = written(signed, "sets")
    classes = written(signed.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    sets = classes.where("n > 0").select(F.col("first").alias("row"), "n", "sig")
    found = components(_candidates(sets, runs_for(recall, threshold), threshold))
    found = written(found, "groups")
    size = found.groupBy("root").agg(F.count("*").alias("members"))
    members = found.join(size, "root").withColumnRenamed("node", "row")
    members = members.join(classes.select(F.col("first").alias("row"), "copies"), "row").join(base.select("row", "text"), "row")
    checked = written(_verified(_in_blocks(members, "root", "members", BLOCK), n, threshold), "links")
    links = checked.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(checked.where("row <> v").select(F.col("row").alias("u"), "v"))
    grouped = classes.select("key", F.col("first"), "copies", "n").join(links.withColumnRenamed("row", "first"), "first", "left")
    grouped = grouped.join(roots.withColumnRenamed("node", "first"), "first", "left")
    grouped = grouped.select("key", F.coalesce("root", "first").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    ids = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"))
    rows = written(signed.select("row", "key", "n").join(grouped, "key").join(ids, "row").drop("key"), "joined")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("keep"))
    out = rows.join(least, "root")
    return out.select("row", "doc_id", "class_id", "n_links", F.col("n").alias("n_shingles"), (F.col("row") == F.col("keep.row")).alias("kept"))
