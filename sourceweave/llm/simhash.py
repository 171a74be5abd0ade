"""SimHash near-duplicates, found through the perfect binary Golay code.

Fingerprints are cut into three segments of 22, 21 and 21 bits. Two fingerprints at most two bits apart have a
segment without an error (pigeonhole) and at most two errors in the segment that follows it. The second one is read
as a word of the [23, 12, 7] Golay code: any two words at most two bits apart share a codeword within distance four,
and a word has one or six such codewords. A key is therefore an exact segment with the index of one codeword near the
next segment: at most 18 keys a fingerprint, none of the wanted pairs lost. Keys are joined and pairs verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import components, keep_rows, lookup, materialise, slices, small_batches, text_hash

#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_POLYNOMIAL = 0b110001110101
#: First bit and width of each segment of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
SHINGLE = 3
MAX_BITS = 2


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY_POLYNOMIAL << (bit - 11), 0)
    return rest


def golay_errors() -> np.ndarray:
    """For each of the 2,048 syndromes the error patterns of weight four at most, -1 where there are no more.

    A coset has its leader (weight three at most, the code being perfect) and, if that weighs three, exactly five
    patterns of weight four.
    """
    table = np.full((2048, 6), -1, dtype=np.int64)
    used = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(23), weight)], dtype=np.int64)
        for pattern, at in zip(patterns.tolist(), _syndrome(patterns).tolist()):
            table[at, used[at]] = pattern
            used[at] += 1
    return table


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["errors"] = golay_errors()
        _TABLES["low"] = _syndrome(np.arange(1 << 12))
        _TABLES["high"] = _syndrome(np.arange(1 << 11) << 12)
    return _TABLES["errors"], _TABLES["low"], _TABLES["high"]


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 message bits) of the codewords within distance four of 23-bit words, in six columns, -1 if fewer."""
    errors, low, high = _tables()
    found = errors[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(found >= 0, (words[:, None] ^ found) >> 11, -1)


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each key of each fingerprint (uint64)."""
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [near_codewords(part) for part in parts]
    rows, keys = [], []
    for kind in range(3):
        key = np.where(near[(kind + 1) % 3] >= 0, (np.int64(kind) << 34) | (parts[kind][:, None] << 12) | near[(kind + 1) % 3], -1)
        row, column = np.nonzero(key >= 0)
        rows.append(row)
        keys.append(key[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no word."""
    ones, n, last = np.zeros(64, dtype=np.int64), 0, []
    for part in slices((text or "").encode("utf-8", "replace").lower()):
        words = last + part.split()
        values = _shingle_hashes(words)
        for at in range(0, len(values), 1 << 16):  # eight bytes a shingle become 64
            block = values[at : at + (1 << 16)]
            ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n, last = n + len(values), words[1 - SHINGLE :]
    if not n:  # fewer words than a shingle has
        if not last:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(last), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the runs of SHINGLE words, one for each word that begins one."""
    if len(words) < SHINGLE:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    width = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(width + 1) - 1
    starts = (ends - width)[: len(words) - SHINGLE + 1]
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())], dtype=np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(values)], names=["doc_id", "text_hash", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("fp").to_numpy()
        row, key = golay_keys(values.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(values[row])], names=["key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp: bigint) for each row, written to the shared folder: texts are read once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(_fingerprints, "doc_id bigint, text_hash bigint, fp bigint"), "simhash")


def links(classes: DataFrame, most: int = 64) -> DataFrame:
    """Verified links (a, b) between different fingerprints (column fp, each once) of ``classes``.

    A bucket of at most ``most`` fingerprints is joined with itself and every pair verified, so a row meets ``most``
    others at most. In a larger bucket each fingerprint names itself and its 64 one-bit neighbours: two fingerprints
    are within two bits exactly if they name a common word, and all that name a word are linked to the smallest of
    them. That is exact as well, reaches the same components, and is linear in the bucket. A bucket of any size fetches
    its size and its smallest word by cells, so its rows never meet in one task.
    """
    keys = materialise(classes.select("fp").mapInArrow(_keys, "key bigint, fp bigint"), "golay")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = lookup(keys, ["key"], sizes, F.xxhash64("fp")).where("size is not null")
    small = shared.where(F.col("size") <= most).select("key", "fp")
    left, right = small.alias("l"), small.alias("r")
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= MAX_BITS))
    few = pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("bigint") for b in range(64)])
    named = shared.where(F.col("size") > most).select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    least = named.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = lookup(named, ["word"], least, F.xxhash64("fp")).where("fp <> a").select("a", F.col("fp").alias("b"))
    return few.union(many).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row of ``docs``.

    component_id is the smallest doc_id that links of two or fewer differing bits reach, the row itself included.
    Null, empty and blank texts have fingerprint zero and link like others; rows that repeat share a component; null
    identifiers count as larger than all others (a component of these alone has a null identifier); a very long text
    is shingled whole, a stretch at a time; an empty table gives an empty result; columns beyond doc_id and text are not read.
    """
    rows = fingerprints(docs)
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fingerprint = lookup(rooted.select("fp", "root"), ["root"], best, F.col("fp")).select("fp", "component_id")
    return lookup(rows, ["fp"], by_fingerprint, F.coalesce(F.xxhash64("doc_id", "text_hash"), F.lit(0))).select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest doc_id stays.

    Rows that repeat (doc_id, text) count once, the one whose other columns are least as JSON; if one doc_id has several
    texts in a component, the text with the smallest hash stays. Null and empty texts are near duplicates of each other.
    All columns are kept; an empty table gives an empty one.
    """
    found = near_duplicates(docs)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id", "fp").agg(F.min("text_hash").alias("text_hash"))
    one = first.groupBy("component_id").agg(F.min_by("text_hash", F.struct("fp", "text_hash")).alias("text_hash"))
    return keep_rows(docs, one.withColumnRenamed("component_id", "doc_id"))
