from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sourceweave.streaming import windows

START = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """(id, user, minutes after the start) as events."""
    return spark.createDataFrame([(i, u, START + dt.timedelta(minutes=m), 1.0) for i, u, m in rows], "id bigint, u int, ts timestamp_ntz, value double").withColumn("ts", F.col("ts").cast("timestamp"))


def test_sliding_counts_of_a_table(spark):
    found = windows.sliding_counts(events(spark, [(1, 1, 5), (2, 1, 65), (3, 2, 5)]), "ts", "u", "2 hours", "1 hour").collect()
    at = lambda r: (r.u, int((r.start - START).total_seconds() // 3600), r.n)
    assert sorted(map(at, found)) == [(1, -1, 1), (1, 0, 2), (1, 1, 1), (2, -1, 1), (2, 0, 1)]


def test_interval_join_of_tables(spark):
    first = events(spark, [(1, 1, 0), (2, 1, 30), (3, None, 0), (4, 2, 0)]).select("id", "u", "ts")
    then = events(spark, [(10, 1, 0), (11, 1, 60), (12, 1, 91), (13, None, 1), (14, 2, -1)]).select(F.col("id").alias("then_id"), "u", "ts")
    found = windows.interval_join(first, then, "u", "ts", "60 MINUTES")
    assert found.columns == ["id", "u", "ts", "then_id", "then_ts"]
    assert sorted((r.id, r.then_id) for r in found.collect()) == [(1, 10), (1, 11), (2, 11)]


@pytest.fixture
def feed(spark, tmp_path):
    """Adds rows to a stream, and gives the stream."""

    def add(name, rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema("id bigint, u int, ts timestamp, value double").parquet(f"{tmp_path}/{name}")

    return add


def test_late_rows_are_counted_and_restarts_repeat_nothing(spark, feed, tmp_path):
    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"
    run = lambda s: windows.arrived(windows.sliding_counts(s, "ts", "u", "2 hours", "1 hour", "1 hour"), out, mark)
    assert run(feed("in", [(1, 1, 5), (2, 1, 600)])) == 0
    # the watermark is at 540 minutes: windows that end by then are closed, so this row has lost one of its two
    assert run(feed("in", [(3, 1, 500), (4, 1, 900)])) == 1
    assert run(feed("in", [(5, 1, 10)])) == 2
    assert run(spark.readStream.schema("id bigint, u int, ts timestamp, value double").parquet(f"{tmp_path}/in")) == 0
    found = spark.read.parquet(out)
    hours = sorted((int((r.start - START).total_seconds() // 3600), r.n) for r in found.collect())
    assert hours == [(-1, 1), (0, 1), (8, 1), (9, 1), (10, 1)]


def test_a_join_of_streams_finds_what_a_join_of_tables_does(spark, feed, tmp_path):
    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"
    views = [[(1, 1, 0), (2, 2, 100)], [(3, 1, 200)], [(4, 1, 1000)]]
    clicks = [[(10, 1, 30)], [(11, 1, 250), (12, 2, 110)], [(13, 1, 5), (14, 1, 1010)]]  # 12 is in time, 13 is not
    late = []
    for a, b in zip(views, clicks):
        first = feed("views", a).select("id", "u", "ts")
        then = feed("clicks", b).select(F.col("id").alias("then_id"), "u", "ts")
        late.append(windows.arrived(windows.interval_join(first, then, "u", "ts", "60 MINUTES", "1 hour"), out, mark))
    pairs = sorted((r.id, r.then_id) for r in spark.read.parquet(out).collect())
    assert pairs == [(1, 10), (2, 12), (3, 11), (4, 14)]
    assert late[:2] == [0, 0] and late[2] >= 1
