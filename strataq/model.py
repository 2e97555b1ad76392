"""The data model: records, types, and how declared type names map to Spark."""

from __future__ import annotations

from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("relationship_type", T.StringType()), T.StructField("target", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])

#: a logical record; attributes are typed columns where a schema is declared, JSON text else
RECORD = T.StructType([
    T.StructField("id", T.StructType([T.StructField("collection", T.StringType()), T.StructField("key", T.StringType())])),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("vectors", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
    T.StructField("edges", T.ArrayType(EDGE)),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

# Declared type names and their Spark types; any other name is text.
DDL_TYPES = {
    "string": "string", "text": "string", "int": "int", "integer": "int", "int2": "smallint", "smallint": "smallint", "int4": "int",
    "int8": "bigint", "bigint": "bigint", "float": "double", "float8": "double", "double": "double", "float4": "float", "real": "float",
    "bool": "boolean", "boolean": "boolean", "json": "string", "jsonb": "string", "uuid": "string", "timestamp": "timestamp", "date": "date",
    "time": "string", "binary": "binary", "bytes": "binary", "document": "string", "sparse_vector": "map<int,float>", "keyvalue": "binary", "kv": "binary",
}


def spark_type(name: str) -> str:
    return DDL_TYPES.get(name.strip().lower(), "string")


#: where a value of a type would live; physical placement itself is Parquet's
STORAGE_CLASSES = {"json": "external", "jsonb": "external", "timestamp": "inline", "text": "inline", "binary": "external", "sparse_vector": "segment"}


def storage_class(name: str) -> str:
    return STORAGE_CLASSES.get(name.strip().lower(), "inline")


def storage_key(collection: str, key: str) -> str:
    return f"{collection}:{key}"
