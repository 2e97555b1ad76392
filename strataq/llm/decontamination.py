"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every window of eight words the least hash of its 5-grams is its fingerprint:
equal windows have equal fingerprints, so any shared span of eight words or more
is found.  Fingerprints of documents and benchmark are joined and a hit is
extended to its whole window, whose words are compared.

A document's words stay one array while its positions are unrolled: unrolling,
hashing, join and comparison are one generated loop over that array, which
copies nothing.  ``posexplode_outer`` matters there: for ``posexplode`` the
optimizer adds a filter on the array that would evaluate its expression again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import written

SPAN = 8
GRAM = 5
#: benchmark windows (about 150 bytes each) up to which their table is broadcast
BROADCAST_WINDOWS = 400_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def words_of(text: Column) -> Column:
    """Words of digits, letters and non-ASCII characters, with A-Z lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def fingerprints(df: DataFrame, *keep: str) -> DataFrame:
    """``at, print`` of each window of eight of ``words``, besides the columns to keep.

    The last word's row, or the one row of no words, has the fingerprint 0: no
    window starts there.  Other rows at which no window starts have null.
    """
    rows = df.select(*keep, "words", F.posexplode_outer("words").alias("at", "_word"))
    word = lambda i: F.get("words", F.col("at") + i)
    grams = [F.xxhash64(*[word(i + j) for j in range(GRAM)]) for i in range(SPAN - GRAM + 1)]
    last = F.col("at").isNull() | (F.col("at") == F.size("words") - 1)
    return rows.select(*keep, "words", "at", F.when(last, F.lit(0).cast("long")).when(F.col("at") <= F.size("words") - SPAN, F.least(*grams)).alias("print"))


def _windows(items: DataFrame) -> DataFrame:
    """``item, span, print, window``: every window of each item that has words."""
    long = fingerprints(items, "item").where(F.col("at") <= F.size("words") - SPAN)
    long = long.select("item", F.lit(SPAN).alias("span"), "print", F.array_join(F.slice("words", F.col("at") + 1, SPAN), " ").alias("window"))
    short = items.where((F.size("words") > 0) & (F.size("words") < SPAN)).withColumn("window", F.array_join("words", " "))
    return long.unionByName(short.select("item", F.size("words").alias("span"), F.xxhash64("window").alias("print"), "window")).distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_items: int = 2,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_hit, n_items, items, contaminated``.

    ``items`` are the sorted ids, as strings, of items with a window in the
    document; ``whole`` is whether one of the windows has all eight words.  A null or empty text has no words and no hits; items without
    words or without an id have no windows; repeated rows of documents each have
    a row, repeated items count once; empty tables give no rows or no hits; only
    the named columns are read.  Documents are scanned once.  The benchmark's
    windows are broadcast only if counted to be at most ``broadcast_windows``;
    else the fingerprints are joined by a shuffle.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words"))
    windows = written(_windows(items), "windows")
    counts = {r.span: r.n for r in windows.groupBy("span").agg(F.count_distinct("window").alias("n")).collect()}  # 8 rows at most
    small = sum(counts.values()) <= broadcast_windows
    texts = windows.select("span", "print", "window").distinct()

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    marked = fingerprints(base, "row", "doc_id")
    # each document's last row meets a window of no words: documents without hits stay
    end = docs.sparkSession.range(1).select(F.lit(0).alias("span"), F.lit(0).cast("long").alias("print"), F.lit("").alias("window"))
    eight = texts.where(F.col("span") == SPAN).unionByName(end)
    same = F.when(F.col("span") == 0, F.col("at").isNull() | (F.col("at") == F.size("words") - 1))
    same = same.otherwise(F.array_join(F.slice("words", F.col("at") + 1, F.col("span")), " ") == F.col("window"))
    found = ["row", "doc_id", F.size("words").alias("n_words"), "at", "span", "window"]
    if small:
        hits = marked.join(F.broadcast(eight), "print").where(same).select(*found)
    else:
        met = marked.select("row", "at", "print").join(eight, "print").drop("print")
        hits = base.join(met, "row").where(same).select(*found)
    for n in sorted(s for s in counts if s < SPAN):
        grams = F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("words", i, n), " ")))
        some = base.where(F.size("words") >= n).select("row", "doc_id", "words", F.posexplode(grams).alias("at", "print"))
        few = texts.where(F.col("span") == n)
        hits = hits.unionByName(some.join(F.broadcast(few) if small else few, "print").where(same).select(*found))
    hits = written(hits, "hits")

    spans = F.array_sort(F.collect_set(F.when(F.col("span") > 0, F.struct("at", "span"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    end_of = lambda s: s["at"] + s["span"]
    covered = F.aggregate(
        spans, start,
        lambda a, s: F.struct(F.greatest(a["end"], end_of(s)).alias("end"), (a["n"] + F.greatest(end_of(s) - F.greatest(a["end"], s["at"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    rows = hits.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), F.max(F.col("span") == SPAN).alias("whole"))
    pairs = hits.where(F.col("span") > 0).select("row", "window").distinct().join(windows.select("window", "item"), "window").select("row", "item").distinct()
    lists = pairs.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = rows.join(lists, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_items = F.size("items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), "items", (n_items >= min_items).alias("contaminated"), "row", "whole")
