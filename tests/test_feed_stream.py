from __future__ import annotations

import pytest

from sourceweave.sources import feed_stream


def item(guid, day, more=""):
    return f"<item><title>T {guid}</title><link>https://x.org/{guid}</link><guid isPermaLink='false'>{guid}</guid><pubDate>Mon, {day:02d} Jan 2024 10:00:00 +0200</pubDate>{more}</item>"


def write(root, feed, *found):
    folder = root / "feeds" / f"feed={feed}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "feed.xml").write_text("<rss><channel>" + "\n".join(found) + "</channel></rss>")


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "feeds").mkdir()

    def go():
        stream = feed_stream.streamed(spark, f"file://{tmp_path}/feeds")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.feed, r.guid) for r in spark.read.schema(feed_stream.SCHEMA).parquet(f"{tmp_path}/out").collect())

    return go


def test_items_have_a_place():
    found = list(feed_stream.items(item("a", 2) + "<item><title>no date</title><guid>b</guid></item><item><pubDate>soon</pubDate><guid>c</guid></item>" + "<item>\n<link>l</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>"))
    assert [at[1] for at, _ in found] == ["a", "l"] and found[0][0][0] > found[1][0][0]


def test_triggers_give_each_item_once(run, tmp_path):
    write(tmp_path, "one", item("a", 1), item("b", 2))
    write(tmp_path, "two", item("a", 1))
    write(tmp_path, "none")
    assert run() == [("one", "a"), ("one", "b"), ("two", "a")]
    # the next fetch repeats an item, has two of one time, and one that is older than what was read
    write(tmp_path, "one", item("b", 2), item("c", 3), item("d", 3), item("old", 1))
    write(tmp_path, "three", item("x", 1), item("x", 1))
    every = [("one", "a"), ("one", "b"), ("one", "c"), ("one", "d"), ("three", "x"), ("two", "a")]
    assert run() == every
    assert run() == every  # nothing new: a restart repeats none
    write(tmp_path, "one", item("a", 1))  # a feed that was set back
    assert run() == every


def test_a_replayed_range_gives_the_same(tmp_path):
    write(tmp_path, "one", item("a", 1), item("b", 2))
    reader = feed_stream.FeedReader({"path": f"file://{tmp_path}/feeds"})
    first = reader.latestOffset()
    (part,) = reader.partitions(reader.initialOffset(), first)
    rows = list(reader.read(part))
    write(tmp_path, "one", item("a", 1), item("b", 2), item("c", 3))  # items that came later are of the next range
    assert list(reader.read(part)) == rows and [r[1] for r in rows] == ["a", "b"]
    (later,) = reader.partitions(first, reader.latestOffset())
    assert [r[1] for r in reader.read(later)] == ["c"] and reader.partitions(first, first) == []
