"""Exports that are published in versions: tasks write parts, one manifest makes them a version, and readers join manifest and parts.

Under a path lie ``parts/<run>/`` with Parquet files and ``versions/<number>.json``, each the list of a version's parts. A part that no
manifest lists doesn't count, so a task that fails, is run twice, or is left behind by a lost executor changes nothing.
A version is whole as soon as its manifest has its name, and the one before stays what it was. One job publishes at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "sourceweave_published"
#: Bytes of rows after which a task begins its next part, at the end of an Arrow batch.
PART_BYTES = 128 << 20
#: Bytes of an Arrow batch that a task gets, so that long texts do not add up.
BATCH_BYTES = 4 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    found, inside = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return found, inside.rstrip("/")


def _numbers(files: fs.FileSystem, root: str) -> list[int]:
    listed = files.get_file_info(fs.FileSelector(f"{root}/versions", allow_not_found=True))
    return sorted(int(i.base_name[:-5]) for i in listed if i.base_name.endswith(".json"))


@dataclass
class Written(WriterCommitMessage):
    """The parts of one task: name, rows, bytes of each."""

    parts: list[tuple[str, int, int]]


class PublishWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.part_bytes, self.schema = options["path"], int(options.get("partbytes", PART_BYTES)), schema.json()
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Parts of one task attempt, in files of its own. A task without rows writes none."""
        files, root = _place(self.path)
        context = TaskContext.get()
        own = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        folder, parts, sink, name, rows, held = f"{root}/parts/{self.run}", [], None, "", 0, 0

        def finish() -> None:
            nonlocal sink, rows, held
            if sink is not None:
                sink.close()
                parts.append((name, rows, files.get_file_info(f"{root}/{name}").size))
            sink, rows, held = None, 0, 0

        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if sink is None:
                    files.create_dir(folder, recursive=True)
                    name = f"parts/{self.run}/{own}-{len(parts):04d}.parquet"
                    sink = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=files)
                sink.write_batch(batch)
                rows, held = rows + batch.num_rows, held + batch.nbytes
                if held >= self.part_bytes:
                    finish()
            finish()
        finally:
            if sink is not None:
                sink.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        """Publish what all tasks have written: the manifest gets its name when it is whole."""
        files, root = _place(self.path)
        number = max(_numbers(files, root), default=0) + 1
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        told = {"version": number, "schema": json.loads(self.schema), "rows": sum(p[1] for p in parts), "parts": [{"name": n, "rows": r, "bytes": b} for n, r, b in parts]}
        files.create_dir(f"{root}/versions", recursive=True)
        draft = f"{root}/versions/{number:010d}-{self.run}.draft"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps(told).encode())
        files.move(draft, f"{root}/versions/{number:010d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Take away the parts of this run; the version before is left as it was."""
        files, root = _place(self.path)
        if files.get_file_info(f"{root}/parts/{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/parts/{self.run}")


class PublishSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> PublishWriter:
        return PublishWriter(self.options, schema)


def publish(df: DataFrame, path: str, part_bytes: int = PART_BYTES) -> int:
    """Publish all rows as the next version, and say its number. Nothing is collected, and no topic needs one task or row."""
    df.sparkSession.dataSource.register(PublishSource)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.write.format(NAME).mode("append").option("path", path).option("partbytes", str(part_bytes)).save()
    return versions(path)[-1]


def versions(path: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    return _numbers(*_place(path))


def manifest(path: str, version: int | None = None) -> dict:
    """Schema, rows and parts of a version, the newest unless it is named; ``LookupError`` where there is none."""
    files, root = _place(path)
    known = _numbers(files, root)
    if not known or (version is not None and version not in known):
        raise LookupError(f"no version {version if version is not None else ''} under {path}")
    with files.open_input_stream(f"{root}/versions/{(version or known[-1]):010d}.json") as held:
        return json.loads(held.read())


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, read by Spark from the parts that its manifest lists."""
    told = manifest(path, version)
    schema = StructType.fromJson(told["schema"])
    names = [f"{path.rstrip('/')}/{p['name']}" for p in told["parts"]]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def expire(path: str, keep: int = 2) -> list[int]:
    """Remove all versions but the newest ``keep`` and the parts that no version left lists; the numbers removed.

    Manifests go first, so a reader never finds a version whose parts are gone. Not to be run beside a job that publishes.
    """
    files, root = _place(path)
    known = _numbers(files, root)
    gone = known[: max(0, len(known) - max(1, keep))]
    for number in gone:
        files.delete_file(f"{root}/versions/{number:010d}.json")
    used = {p["name"].split("/")[1] for n in known[len(gone) :] for p in manifest(path, n)["parts"]}
    for run in files.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True)):
        if run.base_name not in used:
            files.delete_dir(run.path)
    return gone


def digests(df: DataFrame, key: str) -> DataFrame:
    """(key, n, digest): of the rows of each key their number and a digest of their values, whatever their order.

    Two sums of 64-bit hashes of a row's SHA-256: partial sums are made before the shuffle, so a key may have any number of rows.
    Rows that repeat count as often as they are there.
    """
    whole = F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring("_row", at, 15), 16, 10).cast("decimal(38,0)")
    summed = df.select(key, whole.alias("_row")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("_a"), F.sum(part(17)).alias("_b"))
    return summed.select(key, "n", F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("digest"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, n_before, n_after): keys that are "new", "changed" or "gone" between two versions; null is a key like any other."""
    old = digests(before, key).select(F.col(key).alias("_key"), F.col("n").alias("n_before"), F.col("digest").alias("_old"))
    now = digests(after, key).select(key, F.col("n").alias("n_after"), F.col("digest").alias("_now"))
    both = old.join(now, old["_key"].eqNullSafe(now[key]), "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_old") != F.col("_now"), "changed")
    named: Column = F.when(F.col("_now").isNull(), F.col("_key")).otherwise(F.col(key))
    return both.select(named.alias(key), change.alias("change"), F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after")).where("change is not null")


def changes_since(spark: SparkSession, path: str, after: int, key: str) -> tuple[DataFrame | None, int]:
    """What each version later than ``after`` changed, as (version, key, change, n_before, n_after), and the number to ask with next time.

    Version 0 is the empty one, so ``after=0`` tails from the start. None where nothing was published since. A reader whose
    version has expired gets ``LookupError`` and starts from the newest.
    """
    later = [v for v in versions(path) if v > after]
    if not later:
        return None, after
    if after > 0:
        manifest(path, after)
    found, old = [], None if after == 0 else published(spark, path, after)
    if after == 0 and later[0] != 1:
        raise LookupError(f"version 1 is no longer under {path}")
    for version in later:
        now = published(spark, path, version)
        found.append(changes(now.limit(0) if old is None else old, now, key).select(F.lit(version).alias("version"), key, "change", "n_before", "n_after"))
        old = now
    return reduce(DataFrame.union, found), later[-1]
