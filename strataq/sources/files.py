"""Reading and writing collections, backup and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader if schema is None else reader.schema(schema)).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", compression: str | None = None, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), bloom: tuple[str, ...] = ()) -> None:
    """Compression is none, lz4, zstd or any other of the format; ``bloom`` names columns that get bloom filters."""
    w = df.write.mode(mode).format(kind)
    if compression:
        w = w.option("compression", compression)
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def digest(df: DataFrame) -> DataFrame:
    """``rows, digest``: equal for equal multisets of rows, in whatever order."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))


def backup(df: DataFrame, path: str) -> None:
    write(df, path, mode="overwrite")


def restore(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path)


def without_first(df: DataFrame) -> DataFrame | None:
    """A Parquet scan less the first row of its first file that has rows (none has: None); no row leaves the task that reads it."""
    at, file = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    first = df.where(at == 0).agg(F.min(file)).first()[0]
    return None if first is None else df.where((at != 0) | (file != first))


def verify(a: DataFrame, b: DataFrame) -> bool:
    return digest(a).first() == digest(b).first()
