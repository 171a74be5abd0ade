"""News feeds as a stream: a partition a feed, an offset of the last date and guid that was read of each."""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from sourceweave.sources.published import _place

NAME = "sourceweave_feeds"
SCHEMA = "feed string, guid string, published timestamp, xml string"
_ITEM, _GUID = re.compile(r"<item[\s>].*?</item>", re.I | re.S), re.compile(r"<guid(?:\s[^>]*)?>(.*?)</guid>", re.I | re.S)
_DATE, _LINK = re.compile(r"<pubDate>(.*?)</pubDate>", re.I | re.S), re.compile(r"<link>(.*?)</link>", re.I | re.S)
#: Where a feed is read from before anything was read of it.
START = ["", ""]


class FolderFeeds:
    """Feeds as folders ``feed=<name>`` of RSS files under ``path``: what a job that fetches them leaves there."""

    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.root = _place(options["path"])

    def names(self) -> list[str]:
        listed = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(i.base_name[5:] for i in listed if i.base_name.startswith("feed="))

    def xml(self, feed: str) -> Iterator[str]:
        for info in self.files.get_file_info(fs.FileSelector(f"{self.root}/feed={feed}", allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name[0] not in "._":
                with self.files.open_input_stream(info.path) as held:
                    yield held.read().decode("utf-8", "replace")


def items(xml: str) -> Iterator[tuple[list[str], str]]:
    """(date and guid, XML) of each item. The link stands for a missing guid; an item without either, or without a date, has no place and is left out."""
    for found in _ITEM.finditer(xml):
        item = found.group()
        guid, date = _GUID.search(item) or _LINK.search(item), _DATE.search(item)
        try:
            when = parsedate_to_datetime(date.group(1).strip()) if date else None
        except ValueError:
            when = None
        if guid and guid.group(1).strip() and when:
            utc = when.timestamp()
            yield [f"{utc:017.3f}", guid.group(1).strip()], item


@dataclass
class Range(InputPartition):
    """Items of a feed after one offset, up to another."""

    feed: str
    start: list[str]
    end: list[str]


class FeedReader(DataSourceStreamReader):
    """Reads what ``feeds`` (option, `module:class` like :class:`FolderFeeds`) has beyond the offsets.

    An offset names the last (date, guid) of each feed, so a feed may repeat items from one fetch to the next: each is given once. An item
    that turns up with a date before the offset is not given: feeds are read forwards. The driver keeps one offset a feed.
    """

    def __init__(self, options: dict[str, str]) -> None:
        module, made = options.get("feeds", f"{__name__}:FolderFeeds").split(":")
        self.feeds = getattr(importlib.import_module(module), made)(options)

    def initialOffset(self) -> dict:
        return {"feeds": "{}"}

    def latestOffset(self) -> dict:
        ends = {}
        for feed in self.feeds.names():
            last = max((at for xml in self.feeds.xml(feed) for at, _ in items(xml)), default=None)
            if last is not None:
                ends[feed] = last
        return {"feeds": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A partition for each feed that has moved on; one that is gone, or was set back, has nothing to give."""
        old, now = json.loads(start["feeds"]), json.loads(end["feeds"])
        return [Range(f, old.get(f, START), now[f]) for f in sorted(now) if now[f] > old.get(f, START)]

    def read(self, partition: Range) -> Iterator[tuple]:
        import datetime as dt

        seen = set()
        for xml in self.feeds.xml(partition.feed):
            for at, item in items(xml):
                if partition.start < at <= partition.end and tuple(at) not in seen:
                    seen.add(tuple(at))
                    yield partition.feed, at[1], dt.datetime.fromtimestamp(float(at[0]), dt.timezone.utc), item

    def commit(self, end: dict) -> None:
        """Nothing is to be told to a feed."""


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options)


def streamed(spark: SparkSession, path: str, feeds: str | None = None) -> DataFrame:
    """The stream (feed, guid, published, xml) of the items of all feeds; ``feeds.parse_feed`` reads the fields of ``xml``."""
    spark.dataSource.register(FeedSource)
    reader = spark.readStream.format(NAME).option("path", path)
    return (reader.option("feeds", feeds) if feeds else reader).load()
