"""Sessions, input tables, and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the plans are written for; AQE sizes the shuffles."""
    b = SparkSession.builder.master(master).appName("strataq").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Tables as temporary views, for SQL text."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set for checkpoints; on one machine, where neither is set, a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found and not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    if not (found or sc.getCheckpointDir()):
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strataq-"))
    return (found or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
