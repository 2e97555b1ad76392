"""A Python data source: change events of a JSON-lines folder, batch and stream free of schema inference."""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sequence long, timestamp_ms long, kind string, collection string, record_id string, payload string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".jsonl")]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                if line.endswith("\n"):  # a torn last line is not read
                    e = json.loads(line)
                    yield e["sequence"], e.get("timestamp_ms"), e.get("kind"), e.get("collection"), e.get("record_id"), e.get("payload")


class ChangeLog(DataSource):
    """``spark.dataSource.register(ChangeLog)``, then ``spark.read.format("changelog").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])
