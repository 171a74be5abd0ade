"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions alone.

Rows are dealt into :data:`RUNS` runs by their place in the scan, whatever their source, id or text. A run is reduced to one
entry a digest and ordered once: it lies in cells, one for each of as many ranges of digests as keep a cell at about
:data:`CELL` entries, and a cell is one row with its entries in ascending order. In every round FAN_IN neighbouring runs
meet, range by range, and their cells are merged: the sorted arrays are put one after the other and sorted by a sort that
takes ascending stretches as they are (the runs, merged by comparing their heads), equal digests then lie next to each
other, at most one from each run, and the first of them has the smallest identifier. What comes out is ordered again, so no round sorts
rows, and each reads the order of the one before. After log(RUNS) / log(FAN_IN) rounds of this binomial tree one run is left.
A digest with a third of all rows is down to RUNS entries before the first round. Only digests, ids and counts are exchanged, never texts.

A digest is verified: entries are equal in SHA-256, byte length and an independent 64-bit hash of the normalised
text, so that texts with the same SHA-256 that differ in either are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions.vectors import let
from sourceweave.llm.common import keep_rows, materialise, text_hash, text_or_empty

RUNS = 64
FAN_IN = 4
#: Entries of a cell of the last run, about: what a task holds of a range at once.
CELL = 4096
KEY = ("digest", "check", "n_bytes")


def normalised(column: str = "text") -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, row, text_hash, run, and the verified digest of the normalised text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_hash().alias("text_hash"), normalised().alias("_norm"))
    return materialise(
        rows.select(
            "doc_id", "row", "text_hash", F.pmod("row", F.lit(RUNS)).cast("int").alias("run"),
            F.unhex(F.sha2("_norm", 256)).alias("digest"), F.xxhash64("_norm").alias("check"), F.octet_length("_norm").cast("bigint").alias("n_bytes"),
        ),
        "digests",
    )


def _slot(slots: int) -> Column:
    """The range of digests, of so many equal ones, that a digest lies in."""
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    return F.shiftright(head * slots, 32).cast("int")


def sorted_runs(rows: DataFrame, slots: int) -> DataFrame:
    """(run, slot, cell): each run of :func:`digests` with one entry a digest, in cells of ascending entries."""
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    entries = rows.withColumn("slot", _slot(slots)).groupBy("run", "slot", *KEY).agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("n"))
    return entries.groupBy("run", "slot").agg(F.sort_array(F.collect_list(F.struct(*KEY, "least", "n"))).alias("cell"))


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One round: each ``fan_in`` neighbouring runs become one, in order, with the smallest identifier and the count of each digest."""

    def merged(cells: Column) -> Column:
        def entry(i: Column) -> Column:
            return F.get(cells, i)

        def equal(i: Column, j: Column) -> Column:
            a, b = entry(i), entry(j)
            return F.coalesce((a["digest"] == b["digest"]) & (a["check"] == b["check"]) & (a["n_bytes"] == b["n_bytes"]), F.lit(False))

        def sums(i: Column) -> Column:
            # of one digest there is at most one entry a run, so no more than fan_in stand together
            others = [F.when(equal(i, i + k), entry(i + k)["n"]).otherwise(0) for k in range(1, fan_in)]
            first = entry(i)
            return F.struct(*[first[c].alias(c) for c in (*KEY, "least")], sum(others, first["n"]).alias("n"))

        heads = F.filter(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: ~equal(i, i - 1))
        return F.transform(heads, sums)

    gathered = runs.withColumn("run", F.expr(f"run div {fan_in}").cast("int")).groupBy("run", "slot").agg(F.collect_list("cell").alias("cells"))
    return gathered.select("run", "slot", let(F.sort_array(F.flatten("cells")), merged).alias("cell"))


def decisions(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, text_hash, digest (binary), keep_id, group_size, kept.

    Of rows with equal normalised text the one with the smallest doc_id stays. Null doc_ids come after all others; of
    rows that share the smallest doc_id exactly one is kept (the first in the scan). Null texts count as empty and
    group with empty ones. An empty table gives an empty result; a very long text is one digest like any other; columns
    beyond doc_id and text are not read, whatever their names.
    """
    rows = digests(docs)
    first = materialise(sorted_runs(rows, max(1, -(-rows.count() // CELL))), "runs")
    merged, left = first, RUNS
    while left > 1:
        merged, left = merge_runs(merged), left // FAN_IN
    whole = merged.select(F.explode("cell").alias("e")).select(*[f"e.{c}" for c in KEY], F.col("e.least.doc_id").alias("keep_id"), F.col("e.least.row").alias("keep_row"), F.col("e.n").alias("group_size"))
    # back down the tree: at most RUNS rows a digest fetch the result, rows fetch it from their own run
    by_run = first.select("run", F.explode("cell").alias("e")).select("run", *[f"e.{c}" for c in KEY]).join(whole, [*KEY])
    return rows.join(by_run, ["run", *KEY]).select("doc_id", "text_hash", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns, as :func:`decisions` says.

    Of rows that repeat the kept doc_id and text the one whose other columns are least as JSON stays. An empty table
    gives an empty one.
    """
    return keep_rows(docs, decisions(docs).where("kept").select("doc_id", "text_hash"))
