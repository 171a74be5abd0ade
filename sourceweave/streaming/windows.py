"""Event-time windows: an extension, on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, when: str, late: str | None) -> DataFrame:
    timed = events.withColumn(when, F.col(when).cast("timestamp"))
    return timed.withWatermark(when, late) if late and events.isStreaming else timed


def tumbling_counts(events: DataFrame, when: str, key: str, width: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` a window and key; on a stream, rows later than ``late`` are left out."""
    grouped = _timed(events, when, late).groupBy(F.window(when, width), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, when: str, key: str, gap: str = "6 hours", late: str | None = "1 hour") -> DataFrame:
    """Counts of the sessions of a key: rows less than ``gap`` apart."""
    grouped = _timed(events, when, late).groupBy(F.session_window(when, gap), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def sliding_counts(events: DataFrame, when: str, key: str, width: str = "1 day", step: str = "6 hours", late: str | None = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` a key and window of ``width`` every ``step``; a row is in each window that it falls into.

    On a stream a row that is late is left out of the windows that the watermark has closed, and counts in those still open.
    """
    grouped = _timed(events, when, late).groupBy(F.window(when, width, step), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def interval_join(first: DataFrame, then: DataFrame, key: str, when: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of a row of ``first`` and a row of ``then`` with the same ``key``, the latter at most ``within`` after the former.

    Columns are those of each side, ``then`` without the key and with ``when`` named ``then_`` + when. On streams both sides have a watermark,
    so state is bounded by ``within`` and ``late``: a row of ``first`` is kept until the watermark is ``within`` past it, one of ``then`` until
    the watermark reaches it. Rows behind the watermark are left out. Null keys and times pair with nothing. The join is by
    key and time: a key with very many rows inside ``within`` makes as many pairs as there are.
    """
    other = f"then_{when}"
    a, b = _timed(first, when, late), _timed(then, when, late).withColumnRenamed(when, other).withColumnRenamed(key, "_key")
    span = F.expr(f"INTERVAL {within}")
    return a.join(b, (a[key] == b["_key"]) & (b[other] >= a[when]) & (b[other] <= a[when] + span)).drop("_key")


def arrived(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Append what a stream has ready to the table under ``path`` and stop; what came too late: rows of a join; of windows, their partial counts,
    which are made before the watermark is looked at, so late rows of one task, window and key are one.

    A run that is begun again goes on from its checkpoint, and a batch that was written is not written twice.
    """
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
