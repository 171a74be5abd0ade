"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (one to three letters, words padded by a blank) in order
of frequency. A document's own list is compared with each profile by the out-of-place distance: the sum over the
document's n-grams of how far the ranks are apart, PROFILE for n-grams that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.llm.common import id_crc, small_batches

PROFILE = 400
#: Documents a language that its profile is learnt from, in expectation: a hash of the identifier chooses them.
FIT_ROWS = 4000
#: Values of lang that there may be: a profile each goes to all workers.
MOST_LANGUAGES = 10_000
UNDETERMINED = "und"
#: Characters whose n-grams are counted together; longer texts are counted in blocks that are added up.
BLOCK_CHARS = 1 << 20
FOLDS = 5

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000))
    return _LETTERS[0]


def _runs(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(starts, len(values))) if weights is None else (np.add.reduceat(weights, starts) if len(starts) else weights)
    return values[starts], counts


def _block_ngrams(text: str, before: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams that end in a block of lower-case text, and the two symbols that the next block follows.

    ``before`` are the symbols that stand before the block: letters, and one blank between words and at either end.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    kept = letter | np.append(before[-1] != 32, letter[:-1])
    fresh = np.where(letter, points, 32)[kept].astype(np.int64)
    line = np.concatenate((before, fresh, [32] if last else [])).astype(np.int64)
    new = len(line) - len(before)
    one = line[len(line) - new :]
    one = one[one != 32]
    two = (line[:-1] << 21 | line[1:])[max(0, len(before) - 1) :]
    two = two[two != (32 << 21 | 32)]
    three = (line[:-2] << 42 | line[1:-1] << 21 | line[2:])[line[1:-1] != 32]
    return *_runs(np.concatenate((one, two, three))), line[-2:]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of a whole text: code points in 21 bits each.

    A long text is counted block by block; a block goes on where the last one stopped, in the middle of a word as well.
    """
    low = (text or "").lower()
    before, parts = np.array([32], dtype=np.int64), []
    for at in range(0, len(low), BLOCK_CHARS):
        keys, counts, before = _block_ngrams(low[at : at + BLOCK_CHARS], before, at + BLOCK_CHARS >= len(low))
        parts.append((keys, counts))
    if len(parts) == 1:
        return parts[0]
    return _runs(np.concatenate([np.zeros(0, dtype=np.int64), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, dtype=np.int64), *(p[1] for p in parts)]))


def top_ngrams(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys in order of rank; of equally frequent ones the smaller key comes first."""
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    """The profiles of all languages, for one look-up at a time."""

    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.names = sorted(profiles)
        self.sorted = []
        for name in self.names:
            keys = np.array(profiles[name], dtype=np.int64)
            order = np.argsort(keys)
            self.sorted.append((keys[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much further the second nearest profile is, as a share of its distance.

        Of equally near languages the first by name is taken, with score 0. With a single profile, the score is one
        minus its distance as a share of the largest one.
        """
        keys, counts = ngrams(text)
        if not len(keys) or not self.names:
            return UNDETERMINED, 0.0
        own = top_ngrams(keys, counts)
        ranks = np.arange(len(own))
        distances = []
        for known, order in self.sorted:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            distances.append(int(np.where(known[at] == own, np.abs(order[at] - ranks), PROFILE).sum()))
        best = int(np.argmin(distances))
        if len(distances) == 1:
            return self.names[0], 1 - distances[0] / (PROFILE * len(own))
        second = min(d for k, d in enumerate(distances) if k != best)
        return self.names[best], (second - distances[best]) / second if second else 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_language: dict[str, list] = {}
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            by_language.setdefault(language, []).append(ngrams(text.as_py()))
        for language, parts in by_language.items():
            keys, counts = _runs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys)), pa.array(keys), pa.array(counts.astype(np.int64))], names=["lang", "key", "n"])


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Profiles:
    """Profiles from the text and non-null lang of training documents: crc32(doc_id as text) mod FOLDS is not 0.

    A language with more than ``fit_rows`` of them is learnt from about so many, chosen by a hash of the identifier
    and the text. Only PROFILE n-grams a language come to the driver; more than MOST_LANGUAGES languages are an error.
    """
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").where(id_crc() % FOLDS != 0)
    sizes = known.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("size"))
    found = sizes.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: profiles are held by every worker")
    if not found:
        return Profiles({})
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, fit_rows / r.size)) for r in found], "lang string, share double")
    chosen = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.octet_length("text"), F.lit(8)).alias("draw"))
    chosen = chosen.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")
    counted = chosen.mapInArrow(_count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "key")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda r: (r.lang, r.rank)):
        profiles.setdefault(row.lang, []).append(row.key)
    return Profiles(profiles)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``, from profiles learnt on its training rows.

    Null texts and texts without a letter are `und` with score 0, and so is everything if no row can be learnt
    from. A null doc_id counts as the empty text for the fold. Rows that repeat get the same answer; a very long text
    is counted whole, block by block; an empty table gives an empty result; columns beyond doc_id, text and lang are
    not read, and lang only of training rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(learn(docs, fit_rows))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = sent.value
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (id_crc() % FOLDS == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns; no shuffle of the rows.

    Null, empty and letterless texts go, rows that repeat stay, null identifiers too. If no row can be learnt from,
    those with a letter stay. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, fit_rows))

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        if not sent.value.names:
            return pa.array([len(ngrams(t.as_py())[0]) > 0 for t in texts], pa.bool_())
        return pa.array([sent.value.predict(t.as_py())[0] != UNDETERMINED for t in texts], pa.bool_())

    return docs.where(known(F.col("text").cast("string")))
