"""Pluggable sources as Python data sources, so that connectors read like tables or streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class Connector:
    """What a connector offers: its columns, its pages (independent units of work), and the rows of a page."""

    name = "connector"
    schema = "id string, title string, content string, updated_at string"

    def __init__(self, options: dict[str, str]):
        self.options = options

    def pages(self) -> list[str]:
        raise NotImplementedError

    def rows(self, page: str) -> Iterator[tuple]:
        raise NotImplementedError

    def since(self, offset: int) -> tuple[list[tuple], int]:
        """New rows beyond an offset, and the next offset."""
        raise NotImplementedError


class _Page(InputPartition):
    def __init__(self, page: str):
        self.page = page


def register(spark: SparkSession, connector: type[Connector]) -> None:
    """Makes spark.read.format(connector.name) and spark.readStream.format(connector.name) work."""
    make: Callable[[dict], Connector] = connector

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = dict(options)

        def partitions(self):
            return [_Page(p) for p in make(self.options).pages()]

        def read(self, partition):
            yield from make(self.options).rows(partition.page)

    class StreamReader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = dict(options)

        def initialOffset(self):  # noqa: N802
            return {"offset": 0}

        def read(self, start):
            rows, after = make(self.options).since(start["offset"])
            return iter(rows), {"offset": after}

        def readBetweenOffsets(self, start, end):  # noqa: N802
            return iter(make(self.options).since(start["offset"])[0][: end["offset"] - start["offset"]])

        def commit(self, end):
            pass

    class Source(DataSource):
        @classmethod
        def name(cls):
            return connector.name

        def schema(self):
            return connector.schema

        def reader(self, schema):
            return Reader(self.options)

        def simpleStreamReader(self, schema):  # noqa: N802
            return StreamReader(self.options)

    spark.dataSource.register(Source)
