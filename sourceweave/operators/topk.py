"""The documents nearest to each query by the cosine of their term counts: an inverted index of the queries, which documents stream past."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave import shared

#: Bytes of queries that one index holds, and that travel to the workers at once; more queries take more passes over the documents.
INDEX_BYTES = 32 << 20
#: Bytes of an Arrow batch of documents: a block, whose largest weights bound what its documents can reach.
BLOCK_BYTES = 4 << 20
PLACES = 6
#: More than rounding to PLACES can lift a similarity by.
_SLACK = 1e-6


class Index:
    """Terms of the queries of one pass, and of each query the numbers of its terms with their weights (unit length)."""

    def __init__(self, rows: list[tuple[int, list[str]]]) -> None:
        words = pa.array([w for _, ws in rows for w in ws], pa.string()).dictionary_encode()
        self.keys = np.array([k for k, _ in rows], dtype=np.int64)
        self.words = words.dictionary
        owner = np.repeat(np.arange(len(rows)), [len(ws) for _, ws in rows])
        pairs, counts = np.unique(owner * max(1, len(self.words)) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        owner, term = np.divmod(pairs, max(1, len(self.words)))
        weight = counts / np.sqrt(np.bincount(owner, counts.astype(float) ** 2, len(rows)))[owner]
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        self.queries = [(term[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:])]


class Block:
    """The documents of a batch by term: which of them have an index term, with what weight, and the largest of them."""

    def __init__(self, index: Index, lists: pa.ListArray) -> None:
        n, k = len(lists), len(index.words)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words = pc.dictionary_encode(lists.flatten())
        known = pc.fill_null(pc.index_in(words.dictionary, index.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        width = max(1, len(known))
        pairs, counts = np.unique(np.repeat(np.arange(n), sizes) * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, own = np.divmod(pairs, width)
        norm = np.sqrt(np.bincount(row, counts.astype(float) ** 2, n))
        term = known[own] if len(own) else own
        found = np.flatnonzero(term >= 0)
        found = found[np.argsort(term[found], kind="stable")]  # by term, and by document within it
        self.size, self.row, self.weight = n, row[found], counts[found] / norm[row[found]]
        self.cuts = np.searchsorted(term[found], np.arange(k + 1))
        self.most = np.zeros(k)
        np.maximum.at(self.most, term[found], self.weight)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[term], self.cuts[term + 1]
        return self.row[a:b], self.weight[a:b]

    def score(self, terms: np.ndarray, weights: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, similarities) of all that may reach ``least``, and how many documents were looked at for it.

        Terms are taken by what they can add at most. Those that together can't reach ``least`` open no candidate; they are
        added to the candidates of the others, largest first, and a candidate that can't reach it any more is given up.
        """
        most = weights * self.most[terms]
        order = np.argsort(most, kind="stable")
        order = order[most[order] > 0]
        # both vectors have unit length, so terms add no more than the length of the query's part that they are
        ahead = np.minimum(np.cumsum(most[order]), np.sqrt(np.cumsum(weights[order] ** 2)))
        opening = int(np.searchsorted(ahead, least - _SLACK)) if least > 0 else 0
        if opening == len(order):
            return np.zeros(0, dtype=np.int64), np.zeros(0), 0
        total, seen = np.zeros(self.size), np.zeros(self.size, dtype=bool)
        for at in order[opening:]:
            rows, own = self.postings(terms[at])
            total[rows] += weights[at] * own
            seen[rows] = True
        left = np.flatnonzero(seen)
        looked = len(left)
        for place in range(opening - 1, -1, -1):
            left = left[total[left] + ahead[place] >= least - _SLACK]
            if not len(left):
                break
            rows, own = self.postings(terms[order[place]])
            at = np.searchsorted(rows, left)
            hit = at < len(rows)
            hit[hit] = rows[at[hit]] == left[hit]
            total[left[hit]] += weights[order[place]] * own[at[hit]]
        return left, total[left], looked


def _portions(queries: DataFrame, key: str, terms: str, limit: int) -> list[DataFrame]:
    """The queries in portions of ``limit`` bytes at most; a longer query is a portion by itself."""
    sized = shared.stored(queries.select(F.col(key).cast("bigint").alias("key"), F.col(terms).alias("terms")).where(F.size("terms") > 0), "queries")
    bytes_ = 16 + F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, w: a + F.octet_length(w) + 4)
    n, total, largest = sized.agg(F.count(F.lit(1)), F.sum(bytes_), F.max(bytes_)).first()
    if not n:
        return []
    if total <= limit:
        return [sized]
    each = max(1, limit // largest)
    placed = shared.stored(shared.numbered(sized, ["key"], "_at").withColumn("_portion", F.floor(F.col("_at") / each)), "portions")
    return [placed.where(F.col("_portion") == p).select("key", "terms") for p in range(-(-n // each))]


def nearest(docs: DataFrame, doc: str, doc_terms: Column, queries: DataFrame, query: str, query_terms: Column, k: int = 3, limit: int = INDEX_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """(query, rank, doc, similarity, n_scored): the ``k`` documents that share a term with a query and are nearest to it, exactly.

    ``query`` and ``doc`` are integers; of equal similarities, rounded to PLACES, the smaller document goes first. ``n_scored`` is the
    number of documents that were scored for the query, over all tasks; it hangs on how documents are dealt, the rest doesn't.
    A query without terms has no rows, nor has one that no document shares a term with; documents without terms are near nothing.

    Queries travel to the documents, in portions of ``limit`` bytes, so documents are never shuffled and no term, however
    common, meets in one task. A task keeps ``k`` documents a query, and only these are shuffled. What a query's terms can add at most
    in a block, against the query's ``k``-th best so far, leaves out blocks and documents before they are scored.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(block))
    rows = docs.select(F.col(doc).cast("bigint").alias("doc"), doc_terms.alias("terms"))
    asked = queries.select(query, query_terms.alias("_terms"))
    schema = "key bigint, doc bigint, similarity double, place int, scored bigint"
    parts = []
    for portion in _portions(asked, query, "_terms", limit):
        index = spark.sparkContext.broadcast(Index([(r.key, r.terms) for r in portion.collect()]))  # ``limit`` bytes, or one query

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index.value
            best = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(held.keys)
            looked = np.zeros(len(held.keys), dtype=np.int64)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                own = Block(held, batch.column(1))
                for q, (terms, weights) in enumerate(held.queries):
                    scores, docs_ = best[q]
                    found, sims, n = own.score(terms, weights, scores[-1] if len(scores) == k else 0.0)
                    looked[q] += n
                    if len(found):
                        scores, docs_ = np.concatenate([scores, np.round(sims, PLACES)]), np.concatenate([docs_, ids[found]])
                        first = np.lexsort((docs_, -scores))[:k]
                        best[q] = scores[first], docs_[first]
            sizes = [len(s) for s, _ in best]
            if sum(sizes):
                out = [np.repeat(held.keys, sizes), np.concatenate([d for _, d in best]), np.concatenate([s for s, _ in best]), np.concatenate([np.arange(n) for n in sizes]).astype(np.int32), np.repeat(looked, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "doc", "similarity", "place", "scored"])

        parts.append(rows.mapInArrow(search, schema))
    if not parts:
        return spark.createDataFrame([], f"{query} bigint, rank int, {doc} bigint, similarity double, n_scored bigint")
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.union(part)
    # k rows a query and task
    scored = F.sum(F.when(F.col("place") == 0, F.col("scored"))).over(Window.partitionBy("key"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("similarity").desc(), "doc"))
    ranked = kept.withColumn("n_scored", scored).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("key").alias(query), "rank", F.col("doc").alias(doc), "similarity", "n_scored")
