"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import pipeline
from strataq.llm.common import table
from strataq.llm.decontamination import decontaminate
from strataq.llm.jaccard_join import similar
from strataq.llm.licenses import scan
from strataq.llm.lm_scoring import score as lm_score
from strataq.llm.packing import pack
from strataq.llm.sharding import shard
from strataq.llm.token_counts import count_tokens
from strataq.llm.token_files import round_trip
from strataq.llm.top_k import top_k
from strataq.llm.toxicity import score as toxicity_score


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(table(spark, sf_dir, "documents"), end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shard(table(spark, sf_dir, "documents"), n_shards=16).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), n=5, threshold=0.8).select("doc_id", "class_id", "n_links", "n_shingles")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_decontamination": op4_decontamination,
    "op5_top_k": op5_top_k,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_licenses": op9_licenses,
    "op10_jaccard_join": op10_jaccard_join,
    "pipeline": pipeline.run,
}

#: the lower-cased words of a text
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT item, least(len(w), 8) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 8) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' '))) AS win FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM k),
x AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, ns WHERE len(w) >= n),
h AS (SELECT x.doc_id, x.pos, x.n, k.item FROM x JOIN k ON k.n = x.n AND k.win = array_to_string(list_slice(x.w, x.pos, x.pos + x.n - 1), ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(h.pos, h.pos + h.n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(i.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op5_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
}
