"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed once and written; a bounded sample of labelled rows trains the trees on the
driver; the trees are flattened into arrays that numpy walks through for a batch of rows, one level at a time.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import id_crc, materialise, slices, small_batches

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "upper", "lower", "digit", "space", "beyond_ascii",
    "marks", "stops", "symbols", "bars", "braces", "quotes", "byte_entropy", "log_lines", "line_length", "distinct_lines", "capitalised", "longest_word", "marked_words",
)
FOLDS = 3
#: Labelled rows that the trees are fitted on, in expectation: a hash of the identifier chooses them.
FIT_ROWS = 30_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 80, 4, 64, 0.15, 20, 1.0


def _share(counts: np.ndarray, characters: bytes, n: int) -> float:
    return float(counts[list(characters)].sum()) / n


def statistics(text: str | None) -> list[float]:
    """The features of a whole text; all zero if it is null or empty."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lines = raw.split(b"\n")
    often, n_all, letters, same, titled, plain, longest, before = Counter(), 0, 0, 0, 0, 0, 0, []
    for part in slices(raw):
        words = part.split()
        often.update(words)
        n_all += len(words)
        letters += sum(map(len, words))
        same += sum(map(operator.eq, before + words, words if before else words[1:]))
        titled += sum(map(bytes.istitle, words))
        plain += sum(map(bytes.isalnum, words))
        longest = max(longest, max(map(len, words), default=0))
        before = words[-1:] or before
    n_words = max(1, n_all)
    shares = counts[counts > 0] / n
    return [
        float(np.log1p(n)), float(np.log1p(n_all)), letters / n_words, len(often) / n_words, max(often.values(), default=0) / n_words,
        same / n_words, float(counts[65:91].sum()) / n, float(counts[97:123].sum()) / n, float(counts[48:58].sum()) / n,
        float(counts[[32, 9, 10, 13]].sum()) / n, float(counts[128:].sum()) / n, _share(counts, b"!?", n), _share(counts, b".,;:", n), _share(counts, b"#$%&*+=~^@", n),
        _share(counts, b"|\\/_<>", n), _share(counts, b"()[]{}", n), _share(counts, b"\"'`", n), float(-(shares * np.log2(shares)).sum()), float(np.log1p(len(lines))),
        n / len(lines), len(set(lines)) / len(lines), titled / n_words, float(np.log1p(longest)),
        1 - plain / n_words,
    ]


class BoostedTrees:
    """Logistic boosting with histogram splits; after :meth:`fit` the trees are arrays of nodes."""

    def __init__(self, start: float = 0.0) -> None:
        self.start = start
        self.feature = np.zeros((0, 1), dtype=np.int32)  # of a node; -1 in leaves
        self.cut = np.zeros((0, 1))  # values up to the cut go left
        self.value = np.zeros((0, 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Trees for ``y`` (0 or 1). With no row, or one kind of label, every score is the share of ones (0.5 if none)."""
        ones = float(y.mean()) if len(y) else 0.5
        ones = min(max(ones, 1e-3), 1 - 1e-3)
        self.start = float(np.log(ones / (1 - ones)))
        if len(np.unique(y)) < 2:
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        nodes = 2 ** (DEPTH + 1) - 1
        features, cuts, values = [], [], []
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            feature, cut, value = np.full(nodes, -1, dtype=np.int32), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(DEPTH + 1):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    if not len(rows):
                        continue
                    value[node] = RATE * gradient[rows].sum() / (weight[rows].sum() + RIDGE)
                    if level < DEPTH and (found := self._split(binned[rows], gradient[rows], weight[rows], edges)):
                        feature[node], bin_at = found
                        cut[node] = edges[feature[node]][bin_at]
                        at[rows] = 2 * node + 1 + (binned[rows, feature[node]] > bin_at)
            features.append(feature)
            cuts.append(cut)
            values.append(value)
            score += value[at]
        self.feature, self.cut, self.value = np.stack(features), np.stack(cuts), np.stack(values)
        return self

    @staticmethod
    def _split(binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
        best, found = 1e-6, None
        if len(gradient) < 2 * LEAST_ROWS:
            return None
        g, h = gradient.sum(), weight.sum()
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            gl = np.cumsum(np.bincount(binned[:, f], gradient, len(edge) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[:, f], weight, len(edge) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[:, f], minlength=len(edge) + 1))[:-1]
            gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
            gain[(nl < LEAST_ROWS) | (len(gradient) - nl < LEAST_ROWS)] = -1
            if gain.max() > best:
                best, found = float(gain.max()), (f, int(gain.argmax()))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                own = feature[at]
                at = np.where(own >= 0, 2 * at + 1 + (x[rows, own] > cut[at]), at)
            total += value[at]
        return 1 / (1 + np.exp(-total))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = np.array([statistics(t.as_py()) for t in batch.column("text")], dtype=np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *[pa.array(table[:, k]) for k in range(len(FEATURES))]], names=["doc_id", "held_out", *FEATURES])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32(doc_id as text) mod FOLDS is 1) and the statistics of each row, written once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (id_crc() % FOLDS == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(_measure, ", ".join(["doc_id bigint", "held_out boolean", *[f"{f} double" for f in FEATURES]])), "statistics")


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> BoostedTrees:
    """Trees from the labelled rows that are not held out, about ``fit_rows`` of them at most.

    A doc_id with several labels counts by their mean (1 from 0.5 on); null labels are left out.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    known = known.where(id_crc() % FOLDS != 1)
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))
    rows = measured.where("not held_out").join(known, "doc_id").select("doc_id", "label", *FEATURES).distinct().toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES])
    return BoostedTrees().fit(rows[list(FEATURES)].to_numpy(np.float64), rows["label"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    score is the probability of label 1, predicted is 1 from 0.5 on. Null and empty texts are scored by their
    statistics, which are all zero. Without labelled rows every score is 0.5. A null doc_id is never held out and
    never labelled. Rows that repeat get the same score; a very long text is measured whole, its words a stretch at a
    time; an empty table gives an empty result; columns beyond doc_id and text are not read, whatever their names.
    """
    measured = measure(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit(measured, labels, label, fit_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.score(np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return measured.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
