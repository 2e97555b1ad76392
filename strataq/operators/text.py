"""Full text: postings, dictionary, BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions.scalar import ascii_lower, tokens
from strataq.session import cut

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, *fields: str) -> DataFrame:
    """``key, field, term`` for every token."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias("terms")) for f in fields])
    return docs.select(key, F.explode(each).alias("f")).select(key, "f.field", F.explode("f.terms").alias("term"))


def search(docs: DataFrame, key: str, term: str, *fields: str) -> DataFrame:
    """Ids of records that hold the term (the whole input is one term)."""
    has = [F.array_contains(tokens(F.coalesce(F.col(f), F.lit(""))), ascii_lower(F.lit(term))) for f in fields]
    where = has[0]
    for h in has[1:]:
        where = where | h
    return docs.where(where).select(key).distinct()


def bm25(docs: DataFrame, key: str, query: str, fields: tuple[str, ...], field: str | None = None) -> DataFrame:
    """``key, score`` of records with a query term; query terms count with multiplicity.

    One pass tokenises each record to its length and its query terms' frequencies;
    these few numbers are written, and the statistics and scores read them.  df is of ``field`` if given;
    the number of records and their mean length are always of all fields.
    """
    spark = docs.sparkSession
    terms = [t for t in spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t]
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    text = lambda f: F.coalesce(tokens(F.col(f)), F.array().cast("array<string>"))
    every = F.concat(*[text(f) for f in fields])
    wanted = text(field) if field else every
    distinct = sorted(set(terms))
    # exploding an array of one keeps the optimizer from tokenising anew in every expression below
    base = docs.select(key, F.explode(F.array(F.struct(every.alias("all"), wanted.alias("in")) if field else F.struct(every.alias("all")))).alias("_w"))
    inside = F.col("_w.in") if field else F.col("_w.all")
    times = lambda t: F.size(F.filter(inside, lambda x: x == t))
    counted = cut(base.select(key, F.size("_w.all").alias("dl"), *[times(t).alias(f"_t{i}") for i, t in enumerate(distinct)]))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f"_t{i}") > 0, 1)).alias(f"_df{i}") for i in range(len(distinct))])
    scored = counted.crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for t in terms:
        i = distinct.index(t)
        f, df = F.col(f"_t{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    some = F.greatest(*[F.col(f"_t{i}") for i in range(len(distinct))], F.lit(0))
    return scored.where(some > 0).select(key, total.alias("score"))


def match(docs: DataFrame, field: str, query: str) -> DataFrame:
    """Records whose text holds the query, ASCII case aside."""
    return docs.where(F.instr(ascii_lower(F.col(field)), query.translate({c: c + 32 for c in range(65, 91)})) > 0)


def corpus_stats(docs: DataFrame, field: str) -> DataFrame:
    n = F.size(tokens(F.coalesce(F.col(field), F.lit(""))))
    return docs.agg(F.count("*").alias("doc_count"), F.sum(n).alias("total_terms"), F.avg(n).alias("average_length"))
