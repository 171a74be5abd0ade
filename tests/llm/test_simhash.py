from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from sourceweave.llm import common, simhash
from tests.llm.conftest import documents, words


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and group[j] < group[i]:
                    group[i], changed = group[j], True
    best = {}
    for g, (doc, *_) in zip(group, rows):
        best[g] = min(best.get(g, float("inf")), float("inf") if doc is None else doc)
    return fps, [None if best[g] == float("inf") else best[g] for g in group]


def check(spark, rows):
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    fps, want = plain_components(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=key) == sorted(((d[0], f, c) for d, f, c in zip(rows, fps, want)), key=key)


def test_golay_code_is_perfect():
    counts = (simhash.golay_errors() >= 0).sum(axis=1)
    assert sorted(set(counts.tolist())) == [1, 6] and (counts == 6).sum() == 1771


def test_words_two_bits_apart_share_a_codeword():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000)
    for i in range(0, 23, 3):
        for j in range(i, 23, 2):
            y = x ^ (1 << i) ^ (0 if i == j else 1 << j)
            a, b = simhash.near_codewords(x), simhash.near_codewords(y)
            assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_fingerprints():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "one two", "One Two Three", "a b c d", "É été ÀB \x1f x\x0by", words(rng, 500), "same " * 9]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_stretches_of_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = [words(rng, n) + rng.choice(["", " \n"]) for n in (0, 1, 2, 3, 4, 5, 50, 300)]
    for size in (1, 7, 40):
        monkeypatch.setattr(simhash, "slices", lambda raw, size=size: common.slices(raw, size))
        assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_edges(spark, edge_rows):
    check(spark, edge_rows)
    check(spark, [(1, "a b c")])
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1, 64])
def test_links_are_all_found(spark, most):
    """Chains and clumps of near fingerprints, with buckets verified pair by pair and word by word."""
    rng = random.Random(7)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    fps |= {0, 1, 3, 7, 2**63, 2**64 - 1}
    values = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    table = spark.createDataFrame([(v,) for v in values], "fp bigint")
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = {(r.a, r.b) for r in simhash.links(table, most).collect()}
    assert got <= want
    if most == 64:
        assert got == want

    def roots(pairs):
        top = {v: v for v in values}
        for _ in values:
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert roots(got) == roots(want)


def test_keep_one(spark, edge_rows):
    rows = [*edge_rows, (20, edge_rows[5][1] + " extra more")]
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    _, want = plain_components(rows)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(set(want), key=str)


def test_a_hub_of_half_of_all_fingerprints(spark):
    """A bucket and a hub that half of all fingerprints share: the components are right, and a look-up deals a hot key over many cells."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    hub = rng.getrandbits(62)
    near = {hub ^ (1 << a) ^ (1 << b) for a in range(62) for b in range(a)}
    far = {rng.getrandbits(62) for _ in range(len(near))}
    values = sorted(near | far | {hub})
    table = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = {r.node: r.root for r in common.components(simhash.links(table)).collect()}
    least = min(near | {hub})
    assert all(found.get(v, v) == least for v in near | {hub}) and all(found.get(v, v) == v for v in far)
    rows = spark.range(4000).select((F.col("id") % 2 * F.col("id")).alias("k"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = common.lookup(rows, ["k"], rows.groupBy("k").count(), F.col("id")).groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert held < 0.45 * 4000
