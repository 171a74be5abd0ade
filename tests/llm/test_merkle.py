from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from sourceweave.llm import merkle
from tests.llm.conftest import words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, at string, key string, _row string, block string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["c"] * 6) for r in rows], SCHEMA)


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, text, lang, source, n):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text))


def plain(rows):
    """Every row's result by lists of nodes, level by level."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    tops, out = [], []

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    built = []
    for lang in sorted(trees, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(trees[lang], key=lambda x: x[:3])
        built.append((own, climb([x[2] for x in own])))
        tops.append(built[-1][1][-1][0])
    above = climb(tops)
    for rank, (own, levels) in enumerate(built):
        for at, (_, _, leaf, r) in enumerate(own):
            changed = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0 and r[1] is not None
            node = leaf_of(r[0], r[1].translate(lower), *r[2:]) if changed else leaf
            proof = []
            for which, place in ((levels, at), (above, rank)):
                for level in which[:-1]:
                    run = list(level[place // 8 * 8 : place // 8 * 8 + 8])
                    proof += run[: place % 8] + run[place % 8 + 1 :]
                    run[place % 8] = node
                    node, place = h(run), place // 8
            root = above[-1][0]
            out.append((r[0], leaf, levels[-1][0], root, h(proof), node, node == root))
    return out


def check(spark, rows):
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted((tuple(r) for r in merkle.manifest(table(spark, rows)).collect()), key=key) == sorted(plain(rows), key=key)


def docs(rng, n, langs):
    ids = rng.sample(range(-50, 100 * n), n)
    return [(i, words(rng, 4).title() if rng.random() < 0.5 else words(rng, 3), rng.choice(langs), rng.choice(["s", None]), rng.choice([None, 7])) for i in ids]


@pytest.mark.parametrize("n, langs", [(1, ["a"]), (8, ["a"]), (9, [None]), (70, ["a", "b", None]), (600, ["a", "ä", "", None, "z"])])
def test_against_lists(spark, n, langs):
    check(spark, docs(random.Random(n), n, langs))


def test_many_trees(spark):
    rng = random.Random(2)
    check(spark, docs(rng, 400, [f"l{i}" for i in range(90)]))


def test_tall_trees(spark, monkeypatch):
    """Blocks of one level, so that most levels rise as frontiers; many small ranges."""
    rng = random.Random(3)
    monkeypatch.setattr(merkle, "LOW", 1)
    monkeypatch.setattr(merkle, "RISE", 1)
    # workers import the module anew, so what they do follows the module's own levels there: rise and settle here
    rows = docs(rng, 700, ["a"])
    leaves = sorted((r[0], leaf_of(*r)) for r in rows)
    events = [(merkle.node_above(0, len(rows), 1, 0, at)[0], {at % 8: leaf}) for at, (_, leaf) in enumerate(leaves)]
    parts = [list(merkle.rise(events[i : i + 37])) for i in range(0, len(events), 37)]
    done = {k: own for p in parts for k, _, own in p if own}
    opened = [(k, held) for p in parts for k, held, own in p if not own]
    while opened:
        merged = {}
        for k, held in opened:
            merged.setdefault(k, {}).update(held)
        found = list(merkle.rise(merged.items()))
        done |= {k: own for k, _, own in found if own}
        opened = [(k, held) for k, held, own in found if not own]
    assert done[0, 700, 1, merkle.height(700), 0] == plain(rows)[0][3]


def test_edges(spark, edge_rows):
    rows = [(i, t, lang, "s", n) for i, t in edge_rows for lang, n in (("en", 1), (None, None))]
    check(spark, [*rows, *rows[:3], (None, None, None, None, None)])
    assert merkle.manifest(table(spark, [])).count() == 0
    check(spark, [(5, "ABC", "en", None, None)])


def test_blocks_of_tall_trees(spark):
    """Two languages over several blocks, one of them with a row that repeats a thousand times."""
    rng = random.Random(4)
    rows = docs(rng, 9000, ["a", "a", "b"]) + [(7, "Same", "a", "s", 1)] * 1000
    check(spark, rows)


def test_leaf_format():
    assert leaf_of(1, None, "é", None, 3) == hashlib.sha256("1:1-2:é1:3-".encode()).hexdigest()
