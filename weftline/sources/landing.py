"""A Spark data source over a folder of landed captures: one JSON document per line with url, status, content_type, final_url, body."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, content_type string, final_url string, html string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_File]:
        return [_File(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".jsonl")]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            for line in f:
                if line.strip():
                    d = json.loads(line)
                    yield d.get("url"), d.get("status"), d.get("content_type"), d.get("final_url", d.get("url")), d.get("body")


class LandedPages(DataSource):
    """spark.dataSource.register(LandedPages); spark.read.format("landed_pages").load(folder). The folder has to be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])
