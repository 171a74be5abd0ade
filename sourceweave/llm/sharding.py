"""Contiguous shards of near equal bytes from global prefix sums.

Rows are ordered by doc_id across range parts; the totals of the parts (one row a part) give each part's start, and a
running sum inside the part gives each row its place in the whole. The byte line is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.llm.common import materialise, shuffle_partitions

SHARDS = 16


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    The law is `bytes`: a row belongs to the shard whose stretch of the byte line its middle lies in, so that no shard
    is further from its target than the largest row. size is the UTF-8 length plus one (null: none), slots
    count from 0 in doc_id order. Null doc_ids come first; rows of one doc_id are ordered by size and crc, and rows
    alike in all of these are interchangeable; a text longer than a shard's share has the shard of its middle byte. An empty table gives an empty result; columns beyond doc_id and text
    are not read. grown_shard is null: it belongs to another law.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    sized = materialise(sized, "sizes")
    order = ["doc_id", "size", "text_crc32", "row"]
    parts = materialise(sized.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "parts")
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    known = sorted((r.part, r.bytes, r.rows) for r in totals.collect())  # one row a part
    starts, at_byte, at_row = [], 0, 0
    for part, n_bytes, n_rows in known:
        starts.append((part, at_byte, at_row))
        at_byte, at_row = at_byte + n_bytes, at_row + n_rows
    before = spark.createDataFrame(starts, "part int, bytes_before bigint, rows_before bigint")
    running = Window.partitionBy("part").orderBy(*order)
    placed = parts.withColumns({"upto": F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(running)})
    placed = placed.join(F.broadcast(before), "part").select(
        "doc_id", "size", "text_crc32",
        F.expr(f"cast((cast(2 * (bytes_before + upto) - size as decimal(38,0)) * {shards}) div {max(1, 2 * at_byte)} as int)").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
    )
    placed = materialise(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` under ``path``, a folder a shard, in several files each; doc_id must be unique."""
    placed = assign(docs, shards).select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(placed, docs["doc_id"] == placed["_id"]).drop("_id")
    spread = max(1, shuffle_partitions(docs.sparkSession) // shards)
    rows.repartition("_shard", F.pmod("_slot", F.lit(spread))).sortWithinPartitions("_shard", "_slot").withColumnRenamed("_shard", "shard").drop("_slot").write.partitionBy("shard").parquet(path)
