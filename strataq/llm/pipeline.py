"""The corpus pipeline: toxicity, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of ``documents``, whatever these are called.
A stage reads its input more than once, so between stages the documents are a
written table, which is read the same way each time: a document's place in the scan
is its identity there.  Null texts count as empty and are kept; repeated rows are
copies; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.common import discard, table, written
from strataq.llm.decontamination import decontaminate
from strataq.llm.jaccard_join import similar
from strataq.llm.packing import pack
from strataq.llm.toxicity import score

#: expressible stages would need SQL for all four; toxicity and packing have none
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below 0.7.  Without labels of both kinds nothing goes."""
    return score(docs, table(spark, sf_dir, "labels"), threshold=0.7, carry=True).where("predicted = 0").select("carried.*")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose place in the scan is not among ``gone.row``."""
    place = "_row"
    while place.lower() in map(str.lower, docs.columns):
        place += "_"
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    return placed.join(gone.select(F.col("row").alias(place)), place, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a similarity of 0.8 or more of their five-word
    shingles, the one of the least doc_id stays (null last; of repeated rows the first).
    Empty texts are copies of one another."""
    return _without(docs, similar(docs, n=5, threshold=0.8).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a whole eight-word window of a benchmark item (one item is
    enough here), or have hits of two items of any length.  Without items nothing goes."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated or whole"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences of at most 1024; an empty text has its end only."""
    pieces = pack(docs, end_id=0)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result for ``documents``; what a stage has read is deleted behind it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
