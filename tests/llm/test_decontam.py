from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sourceweave.llm import common, decontam
from tests.llm.conftest import documents, words


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    """Every window at every place."""
    own, hit, names = plain_words(text), set(), set()
    for item, body in items:
        pattern = plain_words(body)
        size = min(10, len(pattern))
        for at in range(len(pattern) - size + 1 if pattern else 0):
            for start in range(len(own) - size + 1):
                if own[start : start + size] == pattern[at : at + size]:
                    hit.update(range(start, start + size))
                    names.add(str(item))
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.fixture
def items():
    rng = random.Random(5)
    return [(i, words(rng, rng.choice([1, 2, 3, 9, 10, 11, 25]), 6 if i % 2 else 400)) for i in range(14)] + [(100, None), (101, ""), (102, "... !"), (103, "Été naïve")]


def texts(items, edge_rows):
    rng = random.Random(9)
    out = [t for _, t in edge_rows]
    for _ in range(40):
        parts = [words(rng, rng.randint(0, 20), 6)]
        for _ in range(rng.randint(0, 3)):
            body = rng.choice(items)[1] or ""
            w = body.split()
            parts += [" ".join(w[rng.randint(0, 2) :]).upper().replace(" ", ", "), words(rng, rng.randint(0, 9), 400)]
        out.append(" -- ".join(parts))
    return out


@pytest.mark.parametrize("pass_bytes", [decontam.PASS_BYTES, 300])
def test_overlap(spark, items, edge_rows, pass_bytes):
    rows = [(i, t) for i, t in enumerate(texts(items, edge_rows))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, spans string")
    found = decontam.find_overlap(documents(spark, rows), benchmark, pass_bytes).select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), decontam.items_digest().alias("h"))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == {i: plain(t, items) for i, t in rows}


def test_clean_documents(spark, items, edge_rows):
    rows = [(i, t) for i, t in enumerate(texts(items, edge_rows))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = [i for i, t in rows if not plain(t, items)[1]]
    for pass_bytes in (decontam.PASS_BYTES, 300):
        kept = decontam.clean_documents(documents(spark, rows), benchmark, pass_bytes)
        assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == documents(spark, []).columns


def test_stretches_of_long_texts(monkeypatch, items, edge_rows):
    tables = decontam.WuManber(items)
    whole = [tables.search_text(t) for t in texts(items, edge_rows)]
    for size in (1, 9, 60):
        monkeypatch.setattr(decontam, "slices", lambda raw, size=size: common.slices(raw, size))
        assert [tables.search_text(t) for t in texts(items, edge_rows)] == whole


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontam.find_overlap(documents(spark, [(1, "a b")]), benchmark).collect()] == [(2, 0, [])]
    assert decontam.find_overlap(documents(spark, []), benchmark).count() == 0
