"""Queries over streams in several arrivals: sliding windows over ``events`` and views joined to clicks, some rows of which come an arrival later; feeds made of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave import shared
from sourceweave.sources import feed_stream, feeds
from sourceweave.sources.tables import scan
from sourceweave.streaming import windows

ARRIVALS = 3
FIELDS = "event_id bigint, user_id bigint, ts timestamp, event_type string, value double"


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with their arrival: a third of the time each, but every twentieth row comes with the next."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    at = F.floor((F.unix_micros("ts") - F.lit(low or 0)) * ARRIVALS / F.lit((high or 0) - (low or 0) + 1))
    return rows.withColumn("arrival", F.least(F.lit(ARRIVALS - 1), at + F.when(F.col("event_id") % 20 == 7, 1).otherwise(0)))


def _streamed(spark: SparkSession, sf_dir: str, name: str, plan) -> DataFrame:
    """What ``plan`` of the stream has written once all arrivals are in."""
    rows, path = shared.stored(_arrivals(spark, sf_dir), "arrivals"), shared.scratch_path(spark, name)
    for k in range(ARRIVALS):
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{path}/in")
        windows.arrived(plan(spark.readStream.schema(FIELDS).parquet(f"{path}/in")), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(plan(spark.read.schema(FIELDS).parquet(f"{path}/in")).schema).parquet(f"{path}/out")


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each event type a day, every six hours, of the windows that are closed; what came later than an hour is left out of closed ones."""
    found = _streamed(spark, sf_dir, "sliding", lambda s: windows.sliding_counts(s, "ts", "event_type"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# times are microseconds; a watermark is that of the arrivals before, in whole milliseconds
_ARRIVED = f"""
t AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS u FROM events), b AS (SELECT min(u) AS low, max(u) AS high FROM t),
e AS (SELECT t.*, least({ARRIVALS - 1}, CAST(floor((u - low) * {ARRIVALS} / (high - low + 1)::DOUBLE) AS BIGINT) + CASE WHEN event_id % 20 = 7 THEN 1 ELSE 0 END) AS arrival FROM t, b)"""
SQL_SLIDING = f"""
WITH {_ARRIVED},
marks AS (SELECT k AS arrival, (SELECT max(u) FROM e WHERE arrival < k) // 1000 * 1000 - 3600000000 AS mark FROM range({ARRIVALS + 1}) r(k)),
w AS (SELECT event_type, value, mark, (u // 21600000000 - j) * 21600000000 AS start FROM e JOIN marks USING (arrival), range(4) s(j))
SELECT strftime(make_timestamp(start), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w
WHERE (mark IS NULL OR start + 86400000000 > mark) AND start + 86400000000 <= (SELECT mark FROM marks WHERE arrival = {ARRIVALS}) GROUP BY ALL
"""

WITHIN = 6


def view_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user within six hours of a view, joined as two streams; rows more than an hour behind both are left out."""

    def plan(events: DataFrame) -> DataFrame:
        views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), "ts")
        clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ts")
        return windows.interval_join(views, clicks, "user_id", "ts", f"{WITHIN} HOURS")

    found = _streamed(spark, sf_dir, "view-clicks", plan)
    return found.select("user_id", "view_id", "click_id", ((F.unix_micros("then_ts") - F.unix_micros("ts")) / 1000000).alias("seconds"))


SQL_CLICKS = f"""
WITH {_ARRIVED},
marks AS (SELECT k AS arrival, least((SELECT max(u) FROM e WHERE arrival < k AND event_type = 'view'), (SELECT max(u) FROM e WHERE arrival < k AND event_type = 'click')) // 1000 * 1000 - 3600000000 AS mark FROM range({ARRIVALS}) r(k)),
kept AS (SELECT e.* FROM e JOIN marks USING (arrival) WHERE mark IS NULL OR u > mark)
SELECT v.user_id, v.event_id AS view_id, c.event_id AS click_id, (c.u - v.u) / 1000000.0::DOUBLE AS seconds
FROM kept v JOIN kept c ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click' AND c.u BETWEEN v.u AND v.u + {WITHIN} * 3600000000
"""

FEED = 50


def streamed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of feeds that are fetched three times, each item once; a fetch still has the items of the one before. A feed has fifty pages."""
    path = shared.scratch_path(spark, "feeds")
    arrival, link = F.col("page_id") % ARRIVALS, F.replace("url", F.lit("&"), F.lit("&amp;"))
    date = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), arrival.cast("int")), "EEE, dd MMM yyyy")
    item = F.concat(F.lit("<item><title>Page "), "page_id", F.lit("</title><link>"), link, F.lit("</link><guid>"), F.format_string("%012d", "page_id"), F.lit("</guid><pubDate>"), date, F.lit(" 08:00:00 GMT</pubDate></item>"))
    pages = shared.stored(scan(spark, sf_dir, "pages", "page_id", "url").select(F.expr(f"page_id div {FEED}").alias("feed"), arrival.alias("arrival"), item.alias("value")), "items")
    for k in range(ARRIVALS):
        pages.where(F.col("arrival").isin(k, k - 1)).repartition("feed").select("feed", "value").write.mode("overwrite").partitionBy("feed").text(f"{path}/in")
        items = feed_stream.streamed(spark, f"{path}/in")
        windows.arrived(items, f"{path}/out", f"{path}/checkpoint")
    rows = spark.read.schema(feed_stream.SCHEMA).parquet(f"{path}/out")
    return feeds.parse_feed(rows, keep=("feed", "guid")).select(F.col("feed").cast("bigint").alias("feed"), F.col("guid").cast("bigint").alias("guid"), "title", "url", "date")


SQL_STREAMED = f"""
SELECT page_id // {FEED} AS feed, page_id AS guid, 'Page ' || page_id AS title, url, strftime(DATE '2024-01-01' + CAST(page_id % {ARRIVALS} AS INTEGER), '%Y-%m-%d') AS date FROM pages
"""

QUERIES = {f.__name__: f for f in (sliding_counts, view_clicks, streamed_feeds)}
SQL = {"sliding_counts": SQL_SLIDING, "view_clicks": SQL_CLICKS, "streamed_feeds": SQL_STREAMED}
