"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.shared import components, drop_scratch, lookup, numbered, scratch_path, write_scratch
from sourceweave.shared import stored as materialise

__all__ = ["components", "drop_scratch", "keep_rows", "lookup", "materialise", "numbered", "scratch_path", "slices", "small_batches", "text_hash", "write_scratch"]

#: Bytes of an Arrow batch that a Python worker gets; a single longer row makes a batch by itself.
BATCH_BYTES = 4 << 20
#: Characters of a text whose words are held at once.
SLICE = 2 << 20
_BLANK, _BLANK_BYTE = re.compile("[ \t-\r]"), re.compile(rb"[ \t-\r]")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: Arrow batches of a few MB, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(text, size: int = SLICE):
    """A text (str or bytes) in stretches of about ``size`` that end before white space, so that no word is cut.

    What is made of a text's words is then bounded by the stretch, however long the text is.
    """
    blank = _BLANK if isinstance(text, str) else _BLANK_BYTE
    at = 0
    while at < len(text):
        found = blank.search(text, at + size) if len(text) > at + size else None
        stop = found.start() if found else len(text)
        yield text if stop - at == len(text) else text[at:stop]
        at = stop


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the identifier as text; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def keep_rows(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is in ``survivors`` (doc_id, text_hash), each (doc_id, text) once.

    All columns of ``docs`` come back unchanged, whatever their names. Of rows that repeat doc_id and text the one whose other
    columns are least, read as JSON, stays, so the choice does not hang on the shuffle. One shuffle of the rows, by an
    identifier and a hash of the text, so that neither a hot source nor a hot text meets in one task.
    """
    wrapped = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    others = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("")
    keyed = wrapped.select(F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("\0")).alias("_id"), text_hash("_row.text").alias("_hash"), tie.alias("_tie"), "_row")
    wanted = survivors.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("_id"), F.col("text_hash").alias("_hash"))
    return keyed.join(wanted, ["_id", "_hash"], "left_semi").groupBy("_id", "_hash").agg(F.min_by("_row", "_tie").alias("_row")).select("_row.*")


def text_hash(column: str = "text") -> Column:
    return F.xxhash64(text_or_empty(column))
