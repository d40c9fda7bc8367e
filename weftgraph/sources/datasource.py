"""Python providers as Spark data sources, batch and streaming.

A provider lists descriptors on the driver and reads each into items; here the descriptors are spread
over partitions, so reading is distributed. A provider with `changes_after(cursor)`, which returns
(descriptors, new cursor), can be streamed: cursors are the offsets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id string, text string, title string, path string, url string, mime_type string, source_type string, parent_id string, metadata string, updated_at string, hash string"
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def _rows(provider: Any, descriptors: list) -> Iterator[tuple]:
    for d in descriptors:
        got = provider.read(d)
        for item in [got] if isinstance(got, dict) else got:
            yield tuple(item.get(f) for f in _FIELDS)


class Descriptors(InputPartition):
    def __init__(self, values: list):
        super().__init__(len(values))
        self.values = values


def provider_source(provider: Any, name: str, partitions: int = 8, options: Any = None) -> type[DataSource]:
    """A data source class for a provider; register it with spark.dataSource.register. Options, if there are any, are
    what its list is called with."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            listed = list(provider.list() if options is None else provider.list(options))
            return [Descriptors(listed[i::partitions]) for i in range(min(partitions, len(listed)))] or [Descriptors([])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return _rows(provider, partition.values)

    class StreamReader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"cursor": None}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            found, cursor = provider.changes_after(start["cursor"])
            return iter(list(_rows(provider, found))), {"cursor": cursor}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            found, _ = provider.changes_after(start["cursor"])
            return _rows(provider, found)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: Any) -> DataSourceReader:
            return Reader()

        def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
            return StreamReader()

    return Source


def read_provider(spark: SparkSession, provider: Any, name: str = "weftgraph_provider", partitions: int = 8, options: Any = None) -> DataFrame:
    """The items of a provider, read in parallel."""
    spark.dataSource.register(provider_source(provider, name, partitions, options))
    return spark.read.format(name).load()
