"""Topics over time: equal bins, closed on the right, every bin with every topic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the day that a corpus without any date counts as.
FALLBACK_DAY = dt.datetime(2026, 5, 22)
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy", "MMMM d, yyyy", "MM/dd/yyyy")


def parse_date(said: Column) -> Column:
    """A timestamp from any of the usual forms, a weekday before it or not; null from others."""
    bare = F.regexp_replace(F.trim(said), r"^[A-Za-z]{3,9}, (?=\d)", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS])


def bin_count(days: int) -> int:
    """Six bins for a week or less, else one a week, from 6 to 20."""
    return max(6, min(20, days // 7)) if days > 7 else 6


def topics_over_time(rows: DataFrame, when: str, topic: str) -> DataFrame:
    """(topic, bin, timestamp, frequency): counts in equal bins between the first and the last time, zeros included.

    A row on an edge belongs to the bin before it, the first of all to the first bin; rows without a time are left out.
    Only the two ends come to the driver.
    """
    clean = rows.select(F.col(when).cast("timestamp").alias("_t"), F.col(topic).alias("topic"))
    micros = clean.select(F.unix_micros("_t").alias("_u"), "topic")
    ends = micros.agg(F.min("_u").alias("low"), F.max("_u").alias("high")).first()
    fallback = int(FALLBACK_DAY.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    low, high = (ends.low, ends.high) if ends.low is not None else (fallback, fallback)
    day = 86_400_000_000
    high = high + day if low == high else high
    bins = bin_count((high - low) // day)
    width = (high - low) / bins
    at = F.greatest(F.lit(0), F.ceil((F.col("_u") - low) / F.lit(width)).cast("int") - 1)
    counts = micros.where("_u is not null").groupBy(F.least(at, F.lit(bins - 1)).alias("bin"), "topic").agg(F.count(F.lit(1)).alias("frequency"))
    grid = clean.select("topic").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    middle = F.timestamp_micros((F.lit(low) + (F.col("bin") + 0.5) * F.lit(width)).cast("bigint"))
    return grid.join(counts, ["bin", "topic"], "left").select("topic", "bin", middle.alias("timestamp"), F.coalesce("frequency", F.lit(0)).alias("frequency"))


def date_range(rows: DataFrame, when: str) -> DataFrame:
    """One row (first, last, days) of the times that can be read."""
    t = F.col(when).cast("timestamp")
    return rows.agg(F.min(t).alias("first"), F.max(t).alias("last")).withColumn("days", F.datediff("last", "first"))
