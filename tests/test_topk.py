from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourceweave.operators import topk


def plain(docs, queries, k):
    """All cosines, one by one."""
    out = {}
    for q, words in queries:
        own = Counter(words)
        sims = []
        for d, ws in docs:
            c = Counter(ws or [])
            dot = sum(own[w] * c[w] for w in own)
            if dot:
                sims.append((-round(dot / math.sqrt(sum(v * v for v in own.values()) * sum(v * v for v in c.values())), 6), d))
        for rank, (s, d) in enumerate(sorted(sims)[:k], 1):
            out[q, rank] = (d, -s)
    return out


def some(seed, n_docs, n_queries, words=60):
    """Words as uneven as in a language, repeated documents, and some that are empty, null, or share nothing."""
    rng = random.Random(seed)
    draw = lambda n: [f"w{int(words * rng.random() ** 3)}" for _ in range(n)]
    docs = [(i, draw(rng.randrange(1, 40))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[i % 7][1]) for i in range(20)] + [(n_docs + 20, []), (n_docs + 21, None), (n_docs + 22, ["nowhere"])]
    queries = [(i, draw(rng.randrange(1, 9))) for i in range(n_queries)] + [(n_queries, ["unheard"]), (n_queries + 1, [])]
    return docs, queries


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc bigint, words array<string>"), spark.createDataFrame(queries, "q bigint, words array<string>")


@pytest.mark.parametrize("seed, limit, block", [(1, topk.INDEX_BYTES, topk.BLOCK_BYTES), (2, topk.INDEX_BYTES, 2000), (3, 600, 4000)])
def test_agrees_with_all_pairs(spark, seed, limit, block):
    docs, queries = some(seed, 400, 25)
    own, asked = frames(spark, docs, queries)
    found = topk.nearest(own.repartition(3), "doc", F.col("words"), asked, "q", F.col("words"), 3, limit, block).collect()
    assert {(r.q, r["rank"]): (r.doc, r.similarity) for r in found} == plain(docs, queries, 3)


@pytest.mark.parametrize("rare", [False, True])
def test_bounds_leave_documents_out(rare):
    """Nothing within the best is lost; where a rare word makes the best documents, those with common words alone aren't scored."""
    docs, queries = some(5, 4000, 10, words=400)
    if rare:
        docs = [(d, (ws or []) + [f"rare{d % 500}"] * 6) for d, ws in docs]
        queries = [(q, ws + [f"rare{q}"] * 4) for q, ws in queries]
    index = topk.Index(queries[:-1])
    scored = met = 0
    for terms, weights in index.queries:
        best = np.zeros(0)
        for at in range(0, len(docs), 200):
            block = topk.Block(index, pa.array([ws for _, ws in docs[at : at + 200]], pa.list_(pa.string())))
            every = block.score(terms, weights, 0.0)
            least = best[-1] if len(best) == 3 else 0.0
            rows, sims, looked = block.score(terms, weights, least)
            kept = dict(zip(rows.tolist(), sims.tolist()))
            assert all(abs(kept[r] - s) < 1e-9 for r, s in zip(every[0].tolist(), every[1].tolist()) if s >= least)
            best = np.sort(np.concatenate([best, sims]))[::-1][:3]
            scored, met = scored + looked, met + every[2]
    assert scored < met / 2 if rare else scored <= met


def test_no_shuffle_of_documents(spark):
    docs, queries = some(7, 50, 5)
    own, asked = frames(spark, docs, queries)
    found = topk.nearest(own, "doc", F.col("words"), asked, "q", F.col("words"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("MapInArrow") and "Join" not in plan
    assert all(0 < r.n_scored <= len(docs) for r in found.collect())


def test_nothing_to_search(spark):
    own, asked = frames(spark, [(1, ["a"])], [(1, ["a"])])
    assert topk.nearest(own.limit(0), "doc", F.col("words"), asked, "q", F.col("words")).collect() == []
    empty = topk.nearest(own, "doc", F.col("words"), asked.limit(0), "q", F.col("words"))
    assert empty.collect() == [] and empty.columns == ["q", "rank", "doc", "similarity", "n_scored"]
