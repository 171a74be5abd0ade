"""Tables in the shared folder, look-ups of hot keys, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells into which the rows of one key are dealt by :func:`lookup`.
CELLS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder, removed at exit; on a cluster that is an error,
    for executors would write to folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sourceweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the file system removes it when the application ends."""
    path = f"{shared_dir(spark)}/sourceweave/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later plan reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_scratch(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """:func:`write_scratch` for tables that stay until the application ends."""
    return write_scratch(df, name, compression)[0]


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in the order of ``by``, from 0, as column ``name``; equals are ordered by chance.

    Rows are dealt into ranges and written, so that a range keeps its rows; a row's place is the number of rows in the ranges
    before its own, one figure a range, and its place in its own range. No task has more than a range.
    """
    dealt = stored(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return dealt.withColumn(name, own).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def lookup(rows: DataFrame, key: list[str], table: DataFrame, spread: Column) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row a key, no null key) that no hot key can hold up.

    Rows of a key are dealt into :data:`CELLS` cells by ``spread``; the distinct (key, cell) pairs, at most
    CELLS a key, fetch the value, and the rows fetch it from their own cell.
    """
    dealt = rows.withColumn("_cell", F.pmod(spread, F.lit(CELLS)).cast("int"))
    cells = dealt.select(*key, "_cell").distinct().join(table, key, "left")
    return dealt.join(cells, [*key, "_cell"], "left").drop("_cell")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint, a != b) as (node, root), root being the smallest node.

    Alternates the large-star and small-star contractions; every round is written to the shared folder, and the
    only figures that reach the driver are a row count and a checksum. A hub fetches its least neighbour by
    :func:`lookup`, so its edges never meet in one task. Neither roots nor nodes without an edge are returned.
    """
    spark = edges.sparkSession
    now, path = write_scratch(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = lookup(both.where("b > a"), ["a"], least, F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(large, ["a"], low, F.xxhash64("b")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after, after_path = write_scratch(small, "edges")
        drop_scratch(spark, path)
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now, path = after, after_path
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
