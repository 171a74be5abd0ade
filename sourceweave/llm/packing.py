"""Best-fit-decreasing packing of token sequences, exact over the whole table.

Only lengths decide where best-fit decreasing puts a piece, and there are at most CAPACITY of them. The driver packs
the histogram of lengths: bins with the same remaining capacity form a class, a segment tree over the capacities finds
the tightest class that a length fits into, and all pieces that go there move at once. The outcome is that of placing
piece after piece, in a number of steps that depends on CAPACITY alone. Pieces get their rank within their length
from per-part counts, and the plan turns (length, rank) into a bin and an offset.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.llm.common import SLICE, materialise, shuffle_partitions, small_batches
from sourceweave.llm.tokens import byte_symbols

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Characters of the texts whose ids a worker keeps, and of the longest of them: longer ones hardly come twice.
CACHE_CHARS, KEPT_CHARS = 4 << 20, 64

_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Token ids of whole texts as the library gives them, by way of the vocabulary's pattern and ranks.

    A text is split and merged in one call, which is several times as fast as the library. Texts with a special string,
    and those with runs of white space too long for the pattern, go to the library. Ids of short texts are kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        to_byte = {c: b for b, c in byte_symbols().items()}
        ranks = {bytes(map(to_byte.__getitem__, token)): n for token, n in self.library.get_vocab(with_added_tokens=False).items()}
        # the pattern is that of the library's byte-level splitter; a vocabulary that splits in another way is left to the library
        splitter = json.loads(self.library.to_str())["pre_tokenizer"] or {}
        self.by_ranks = (splitter.get("type"), splitter.get("use_regex"), splitter.get("add_prefix_space")) == ("ByteLevel", True, False) and self.library.normalizer is None
        self.merge = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for text in texts:
            yield self._short(text) if len(text) <= KEPT_CHARS else self._ids(text)

    def _ids(self, text: str) -> bytes:
        return self._stretch(text) if len(text) <= SLICE else b"".join(map(self._stretch, _stretches(text)))

    def _stretch(self, text: str) -> bytes:
        if not self.by_ranks or any(s in text for s in self.special):
            return self._whole(text)
        try:
            return self.merge(text).astype("<u4", copy=False).tobytes()
        except ValueError:  # the pattern goes back over white space, and gives up on some hundred thousand characters of it in a row
            return self._whole(text)

    def _short(self, text: str) -> bytes:
        """Ids of a short text, which may well come again; as many are kept as CACHE_CHARS hold."""
        ids = self.cache.get(text)
        if ids is None:
            ids = self._ids(text)
            if self.held > CACHE_CHARS:
                self.cache.clear()
                self.held = 0
            self.cache[text] = ids
            self.held += len(text)
        return ids


def _stretches(text: str) -> Iterator[str]:
    """A long text cut before blanks between other characters, where a token begins in any case."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + SLICE) if len(text) > at + SLICE else None
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The encoder of this process for a vocabulary: a worker keeps its cache from task to task."""
    if tokenizer not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[tokenizer] = Encoder(tokenizer if os.sep in tokenizer else public_tokenizers.path(tokenizer))
    return _ENCODERS[tokenizer]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, after a first piece that may be shorter."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


class SegmentTree:
    """Counts of open bins by remaining capacity."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, capacity: int, count: int) -> None:
        at = capacity + self.size
        while at:
            self.sums[at] += count
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open bin has."""
        at = least + self.size
        if self.sums[at]:
            return least
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.size:
                    at *= 2
                    if not self.sums[at]:
                        at += 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces a bin, first bin, offset) of best-fit decreasing, and the number of bins.

    Row by row, the pieces of a length from a rank on fill bins that follow each other, each with as many of them.
    """
    tree, open_bins, bins, rows = SegmentTree(capacity), [deque() for _ in range(capacity + 1)], 0, []

    def leave(bin_at: int, count: int, remaining: int) -> None:
        if count and remaining:
            open_bins[remaining].append((bin_at, count))
            tree.add(remaining, count)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                each, first, have = capacity // length, bins, -(-left // (capacity // length))
                remaining, bins = capacity, bins + have
            else:
                each = remaining // length
                first, have = open_bins[remaining].popleft()
                tree.add(remaining, -have)
            full = min(have, left // each)
            if full:
                rows.append((length, rank, each, first, capacity - remaining))
                leave(first, full, remaining - each * length)
                rank, left = rank + full * each, left - full * each
            if left and full < have:  # fewer than fill a bin of this class
                rows.append((length, rank, left, first + full, capacity - remaining))
                leave(first + full, 1, remaining - left * length)
                full, rank, left = full + 1, rank + left, 0
            if full < have:
                open_bins[remaining].appendleft((first + full, have - full))
                tree.add(remaining, have - full)
    return np.array(rows, dtype=np.int64).reshape(-1, 5), bins


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Rows doc_id, row, piece, start, length, ids_crc32: the tokenised documents, cut to ``capacity``."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for at, ids in enumerate(encode(t.as_py() or "" for t in batch.column("text"))):
                view = memoryview(ids + end)
                out += [(at, k, start, length, zlib.crc32(view[4 * start : 4 * (start + length)])) for k, (start, length) in enumerate(cut(len(view) // 4, capacity))]
            table = np.array(out, dtype=np.int64).reshape(-1, 5)
            take = pa.array(table[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(table[:, 1].astype(np.int32)), *[pa.array(table[:, k]) for k in (2, 3, 4)]],
                names=["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tokenise, "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``.

    A document is its token ids and END_ID, so null and empty texts make a piece of one token; a very long text makes as
    many pieces as it needs. Null identifiers stay null; rows that repeat are packed each by itself. Sequences hold at most ``capacity`` tokens without gaps. An empty table gives an empty
    result; columns beyond doc_id and text are not read.
    """
    spark = docs.sparkSession
    cut_rows = materialise(pieces(docs, tokenizer, capacity).withColumn("part", F.pmod("row", F.lit(max(64, shuffle_partitions(spark)))).cast("int")), "pieces")
    counts = materialise(cut_rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, _ = best_fit_plan(histogram, capacity)
    by_length = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("part", "length").orderBy("row", "piece")
    ranked = cut_rows.withColumn("rank", F.row_number().over(in_part) - 1).join(before, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    sent = spark.sparkContext.broadcast(plan[order])  # rows: by the number of lengths, not of documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        keys = (table[:, 0] << 48) | table[:, 1]
        kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            found = table[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            nth = rank - found[:, 1]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found[:, 3] + nth // found[:, 2]), pa.array(found[:, 4] + nth % found[:, 2] * length)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
