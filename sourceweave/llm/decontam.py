"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of benchmark items: ten consecutive words, or a whole item of fewer. For each pattern length
a shift table tells by the block of words under the cursor how far no pattern can end; where the shift is zero, the
suffix block selects a bucket, the prefix block the few patterns in it, and a direct comparison confirms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.llm.common import materialise, slices, small_batches, text_hash

WINDOW = 10
BLOCK = 2
#: Bytes of benchmark text in one broadcast, whose tables take about a hundred times that in a worker; a larger
#: benchmark is searched in as many passes as it takes.
PASS_BYTES = 1 << 20

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "n_words bigint, n_hit bigint, spans array<struct<start: bigint, stop: bigint>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: digits, letters and all characters beyond ASCII."""
    return _lowered(text).split()


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES)


class WuManber:
    """Search tables for the windows of ``items``: (identifier, text) pairs."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        patterns: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                size = min(window, len(words))
                of_size = patterns.setdefault(size, {})
                for at in range(len(words) - size + 1):
                    of_size.setdefault(tuple(words[at : at + size]), set()).add("" if item is None else str(item))
        self.tables = [self._tables(size, of_size) for size, of_size in sorted(patterns.items())]

    @staticmethod
    def _tables(size: int, patterns: dict[tuple[bytes, ...], set[str]]) -> tuple:
        block = min(BLOCK, size)
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]]] = {}
        for pattern, items in patterns.items():
            for end in range(block, size + 1):
                key = pattern[end - block : end]
                shift[key] = min(shift.get(key, size), size - end)
            buckets.setdefault(pattern[size - block :], {}).setdefault(pattern[:block], {})[pattern] = items
        return size, block, size - block + 1, shift, buckets

    def search_text(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, spans and items of a whole text, a stretch at a time with as many words before it as it takes."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = max((t[0] for t in self.tables), default=1)
        last: list[bytes] = []
        n = 0
        for part in slices(_lowered(text)):
            fresh = part.split()
            found, hit = self.search(last + fresh)
            start = n - len(last)
            spans += [(a + start, b + start) for a, b in found]
            items |= hit
            n += len(fresh)
            last = (last + fresh)[1 - longest :] if longest > 1 else []
        return n, _union(spans), items

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, stop) of words inside occurrences, and the items whose windows occur."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        n = len(words)
        for size, block, most, shift, buckets in self.tables:
            at, step_of = size - 1, shift.get
            while at < n:
                key = (words[at - 1], words[at]) if block == 2 else (words[at],)
                step = step_of(key, most)
                if step:
                    at += step
                    continue
                start = at - size + 1
                if candidates := buckets[key].get(tuple(words[start : start + block])):
                    if (hit := candidates.get(tuple(words[start : at + 1]))) is not None:
                        found.append((start, at + 1))
                        items |= hit
                at += 1
        return _union(found), items


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _passes(benchmark: DataFrame, pass_bytes: int):
    """A function for each pass that fetches its items: no two passes are on the driver together."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    small_batches(benchmark.sparkSession)
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    passes = 1 if total <= pass_bytes else -(-2 * total // pass_bytes)

    def fetch(at: int):
        return lambda: [(r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == at).collect()]

    return [fetch(at) for at in range(passes)]


def _scanner(sent: Broadcast):
    """A function over Arrow batches that searches each text with the tables sent."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value.search_text
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_hit": [], "spans": [], "items": []}
            for text in batch.column("text"):
                n, spans, hit = search(text.as_py())
                out["n_words"].append(n)
                out["n_hit"].append(sum(stop - start for start, stop in spans))
                out["spans"].append([{"start": a, "stop": b} for a, b in spans])
                out["items"].append(sorted(hit))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(out[k], kind) for k, kind in zip(out, kinds)]], names=["doc_id", *out])

    return scan


def _by_pass(passes: list, search: Callable[[Broadcast], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What ``search`` finds in all passes, each written before the next: one pass's tables are with the executors at a time."""
    parts = []
    for items in passes:
        sent = spark.sparkContext.broadcast(WuManber(items()))
        parts.append(materialise(search(sent), name))
        sent.destroy()
    return reduce(DataFrame.union, parts)


def _joined_spans(lists: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.array([[{"start": a, "stop": b} for a, b in _union([(s["start"], s["stop"]) for s in spans])] for spans in lists.to_pylist()], kind)


def find_overlap(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit, spans of hit words, items (sorted, as strings).

    Null and wordless texts have no words and no hits; null items are skipped, items without words have no window;
    a null item_id is reported as the empty string; items that share an identifier are one item. Repeated rows are
    searched each by itself; an empty benchmark hits nothing and an empty table gives an empty result; the words of a
    very long text are searched a stretch at a time, with the seams; other columns of either table are not read. If the
    benchmark is larger than ``pass_bytes``, every pass searches all documents and the passes are merged by row.
    """
    spark = docs.sparkSession
    schema = f"doc_id bigint, {RESULT}"
    passes = _passes(benchmark, pass_bytes)
    if len(passes) == 1:
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(_scanner(spark.sparkContext.broadcast(WuManber(passes[0]()))), schema)
    numbered = materialise(docs.select(F.col("doc_id").cast("bigint").alias("id"), F.monotonically_increasing_id().alias("doc_id"), F.col("text").cast("string").alias("text")), "decontam")
    whole = _by_pass(passes, lambda sent: numbered.select("doc_id", "text").mapInArrow(_scanner(sent), schema), spark, "decontam-pass")
    rows = whole.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = rows.withColumn("spans", F.arrow_udf(_joined_spans, "array<struct<start: bigint, stop: bigint>>")("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return numbered.select("doc_id", "id").join(rows, "doc_id").select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "spans", "items")


def clean_documents(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, with all their columns.

    Null and wordless texts stay, null identifiers and rows that repeat too. With one pass the rows are not shuffled; with several, each pass writes the keys that it has hit, so that no two
    passes' tables are in memory together, and the rows are shuffled once.
    """
    spark, passes = docs.sparkSession, _passes(benchmark, pass_bytes)
    if len(passes) == 1:
        return docs.where(~_hit_udf(spark.sparkContext.broadcast(WuManber(passes[0]())))(F.col("text").cast("string")))
    wrapped = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    keyed = wrapped.select(F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("\0")).alias("_id"), text_hash("_row.text").alias("_hash"), "_row")
    hit = _by_pass(passes, lambda sent: keyed.where(_hit_udf(sent)(F.col("_row.text").cast("string"))).select("_id", "_hash").distinct(), spark, "hits")
    return keyed.join(hit.distinct(), ["_id", "_hash"], "left_anti").select("_row.*")


def _hit_udf(sent: Broadcast):
    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        return pa.array([bool(sent.value.search_text(t.as_py())[1]) for t in texts], pa.bool_())

    return hit


def items_digest(items: str = "items") -> Column:
    """SHA-256 of the sorted item identifiers, comma-joined."""
    return F.sha2(F.array_join(F.col(items), ","), 256)
