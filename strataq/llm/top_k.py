"""Exact top-k search by distributed histogram selection.

Queries go in waves of a fixed number, so what is shipped to the tasks is
bounded.  For each wave every candidate is scored in blocks; the tasks add up
histograms of scores, and the bin that holds a query's k-th score is refined
until few scores are left at or above its edge.  A last pass keeps what reaches
the edge; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm.common import written

BINS = 256
#: queries in a wave: 8192 of 64 components are 4 MB
WAVE = 8192
_BLOCK, _QUERIES = 2048, 512
_MOST = 1 << 62


def _whole(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, ids and floored vectors of a batch by length of vector; unusable vectors are left out."""
    rows, ids, vecs = batch.column(0), batch.column(1), batch.column(2)
    sizes = np.asarray(vecs.value_lengths().fill_null(-1), np.int64)
    good = sizes > 0
    if ids.null_count:
        good &= np.asarray(ids.is_valid())
    for n in np.unique(sizes[good]).tolist():
        at = np.flatnonzero(good & (sizes == n))
        flat = vecs.take(pa.array(at)).flatten().cast(pa.float64())
        x = np.asarray(flat.fill_null(np.nan)).reshape(-1, n)
        keep = np.isfinite(x).all(1)
        yield np.asarray(rows)[at[keep]], np.asarray(ids.fill_null(0))[at[keep]], np.floor(scale * x[keep])


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of floored vectors, exact; beyond 2**62 they count as 2**62."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2.0**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in c], object).T
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, wave: dict) -> Iterator[tuple]:
    """(query numbers, candidates' rows, ids, scores) in blocks of bounded size."""
    for b in batches:
        for at in range(0, b.num_rows, _BLOCK):
            for rows, ids, c in _whole(b.slice(at, _BLOCK), scale):
                number, q_rows, q = wave.get(c.shape[1], (None, None, None))
                for k in range(0, len(number) if number is not None else 0, _QUERIES):
                    s = scores(q[k : k + _QUERIES], c)
                    yield number[k : k + _QUERIES], q_rows[k : k + _QUERIES, None] != rows[None, :], rows, ids, s


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024, wave: int = WAVE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best other rows.

    Components are floor(scale * x).  Vectors that are null, empty, or hold null
    or non-finite components take no part; rows with a null id neither; only
    vectors of the query's own length are its candidates.  A repeated row is a
    candidate of its own.  Ties go to the smaller id.  Fewer candidates than k
    give fewer rows, an empty table none; other columns are not read.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    asked = written(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), queries.alias("asked")).where("asked").drop("asked"), "queries")
    count = asked.count()
    waves = -(-count // wave)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for b in batches:
            for _, _, c in _whole(b, scale):
                most = max([most, *np.sqrt((c * c).sum(1)).tolist()])
        yield pa.RecordBatch.from_pydict({"norm": [most]})

    norm = chosen.mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 0.0
    # a hash of the row deals queries to waves of about equal size
    parts = [asked.where(F.pmod(F.xxhash64("row"), F.lit(waves)) == i) for i in range(waves)] if waves > 1 else [asked]
    return reduce(DataFrame.unionByName, [_wave(spark, chosen, part, k, scale, norm) for part in parts])


def _wave(spark, chosen: DataFrame, part: DataFrame, k: int, scale: float, norm: float) -> DataFrame:
    pulled = part.toArrow()
    q_ids, by_dim, bounds = [], {}, []
    for b in pulled.to_batches():
        for rows, ids, q in _whole(b, scale):
            n, (numbers, q_rows, qs) = len(q_ids), by_dim.setdefault(q.shape[1], ([], [], []))
            numbers.append(np.arange(n, n + len(ids)))
            q_rows.append(rows)
            qs.append(q)
            q_ids += ids.tolist()
            bounds += np.sqrt((q * q).sum(1)).tolist()
    wave = {d: tuple(map(np.concatenate, x)) for d, x in by_dim.items()}
    shipped = spark.sparkContext.broadcast((wave, np.array(q_ids, np.int64)))

    # |score| is at most the product of the norms
    high = np.array([min(float(_MOST), b * norm * (1 + 1e-9) + 1) for b in bounds])
    low, width = -high.astype(object), np.array([max(1, -(-2 * int(h) // BINS) + 1) for h in high], object)
    low = np.array([-int(h) - 1 for h in high], object)
    above = np.zeros(len(high), np.int64)
    edge = low.copy()
    open_ = np.ones(len(high), bool)
    while open_.any():
        lows, widths, live = low.astype(np.float64), width.astype(np.float64), open_.copy()
        if (width < 1 << 40).all():
            lows, widths = low.astype(np.int64), width.astype(np.int64)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist = np.zeros((len(lows), BINS), np.int64)
            for number, others, _, _, s in _blocks(batches, scale, shipped.value[0]):
                bins = np.floor_divide(s - lows[number, None], widths[number, None])
                ok = others & (bins >= 0) & (bins < BINS) & live[number, None]
                q, c = np.nonzero(ok)
                hist += np.bincount(number[q] * BINS + bins[q, c].astype(np.int64), minlength=hist.size).reshape(hist.shape)
            # from the top, bins past the k-th score of this task cannot hold the k-th of all
            needed = np.cumsum(hist[:, ::-1], 1)[:, ::-1] - hist < k
            q, b = np.nonzero((hist > 0) & needed)
            yield pa.RecordBatch.from_pydict({"q": q.astype(np.int32), "bin": b.astype(np.int32), "n": hist[q, b]})

        got = chosen.mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # of each query, the highest bins down to the one with the k-th score: k rows at most
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        got = got.withColumn("over", F.sum("n").over(down) - F.col("n"))
        goal = spark.createDataFrame([(i, int(k - above[i])) for i in np.flatnonzero(open_).tolist()], "q int, goal long")
        last = got.join(F.broadcast(goal), "q").where(F.col("over") < F.col("goal")).groupBy("q").agg(F.min_by(F.struct("bin", "n", "over"), "bin").alias("b"))
        seen = {r.q: r.b for r in last.collect()}
        for i in np.flatnonzero(open_).tolist():
            b = seen.get(i)
            if b is None:  # fewer than k candidates at or above the edge
                open_[i] = False
                continue
            edge[i] = low[i] + b.bin * width[i]
            total = above[i] + b.over + b.n
            if total < k or total <= 4 * k or width[i] == 1:
                open_[i] = False
                edge[i] = edge[i] if total >= k else -_MOST
            else:
                above[i] += b.over
                low[i], width[i] = edge[i], max(1, -(-int(width[i]) // BINS))
    edges = np.array([max(-_MOST, int(e)) for e in edge], np.int64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave_, names = shipped.value
        held = [np.zeros(0, np.int64)] * 3

        def best(q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
            order = np.lexsort((ids, -s, q))
            q, s, ids = q[order], s[order], ids[order]
            first = np.searchsorted(q, q, "left")
            ok = np.arange(len(q)) - first < k
            return [q[ok], s[ok], ids[ok]]

        for number, others, _, ids, s in _blocks(batches, scale, wave_):
            q, c = np.nonzero(others & (s >= edges[number, None]))
            held = [np.concatenate(x) for x in zip(held, (number[q], s[q, c], ids[c]))]
            if len(held[0]) > 500_000:
                held = best(*held)
        q, s, ids = best(*held)
        yield pa.RecordBatch.from_pydict({"q": q.astype(np.int32), "query_id": names[q], "vec_id": ids, "score": s})

    ranked = chosen.mapInArrow(keep, "q int, query_id long, vec_id long, score long")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
