"""A search as a data source: a partition a topic, answered by a function of the caller's."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sourceweave.sources.feeds import CANDIDATE

NAME = "sourceweave_search"
FIELDS = tuple(part.split()[0] for part in CANDIDATE.split(", "))


@dataclass
class Topic(InputPartition):
    value: str


class SearchReader(DataSourceReader):
    """Reads what ``fetch`` (option, `module:function` of a topic and a limit) yields for each of ``topics`` (one a line)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.topics = [t for t in options.get("topics", "").split("\n") if t]
        self.limit, self.fetch = int(options.get("limit", "50")), options["fetch"]

    def partitions(self) -> list[InputPartition]:
        return [Topic(t) for t in self.topics]

    def read(self, partition: Topic) -> Iterator[tuple]:
        module, function = self.fetch.split(":")
        found = getattr(importlib.import_module(module), function)(partition.value, self.limit)
        for row in islice(found, self.limit):
            yield (partition.value, *[row.get(f) for f in FIELDS])


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"topic string, {CANDIDATE}"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def searched(spark: SparkSession, topics: list[str], fetch: str, limit: int = 50) -> DataFrame:
    """(topic, candidate columns): at most ``limit`` answers a topic, fetched where the partitions are read. No topics, no rows."""
    spark.dataSource.register(SearchSource)
    return spark.read.format(NAME).option("topics", "\n".join(topics)).option("fetch", fetch).option("limit", str(limit)).load()
