from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sourceweave.llm import common, packing, tokens
from tests.llm.conftest import documents

POOL = [*" \n\t\x0b\x1c\x1f\x85\xa0 　aAbB'stremdlvEÉéÀàßΣσςİıé́̂ñçü中文日本кир١٢3 4!?.,;:<|>#~_-", "  ", "\r\n", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "the", "ing", " the", "Å", "\U0001f642"]


def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", "a" * 5000, "ab" * 3000, " " * 300, "\n" * 50, "é" * 999, "the cat " * 4000]


@pytest.mark.parametrize("entries", [300_000, 50])
def test_counts_are_the_library_s(monkeypatch, entries):
    monkeypatch.setattr(tokens, "CACHE_CHARS", entries)
    path = public_tokenizers.path(tokens.TOKENIZER)
    library = Tokenizer.from_file(path)
    given = texts()
    assert tokens.TokenCounter(path).count(given) == [len(e.ids) for e in library.encode_batch(given, add_special_tokens=False)]


@pytest.mark.parametrize("entries", [300_000, 50])
def test_ids_are_the_library_s(monkeypatch, entries):
    monkeypatch.setattr(packing, "CACHE_CHARS", entries)
    path = public_tokenizers.path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    given = texts()
    assert list(packing.Encoder(path).encode(given)) == [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(given, add_special_tokens=False)]


def test_stretches_of_long_texts(monkeypatch):
    """Texts cut into short stretches have the library's tokens still."""
    monkeypatch.setattr(packing, "SLICE", 10)
    monkeypatch.setattr(tokens, "slices", lambda text: common.slices(text, 10))
    monkeypatch.setattr(tokens, "GROUP_CHARS", 100)
    test_counts_are_the_library_s(monkeypatch, 300_000)
    test_ids_are_the_library_s(monkeypatch, 300_000)


def test_count_tokens(spark, edge_rows):
    library = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    found = tokens.count_tokens(documents(spark, edge_rows)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in edge_rows]
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert tokens.count_tokens(documents(spark, [])).count() == 0


def best_fit(lengths, capacity):
    """Piece after piece, the longest first, into the fullest bin with room."""
    bins = []
    for length in sorted(lengths, reverse=True):
        at = min((k for k, room in enumerate(bins) if room >= length), key=lambda k: bins[k], default=None)
        if at is None:
            bins.append(capacity)
            at = len(bins) - 1
        bins[at] -= length
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 250))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan, bins = packing.best_fit_plan(histogram, capacity)
    filled = {}
    for length, rank, each, first, offset in plan.tolist():
        later = [r for n, r, *_ in plan.tolist() if n == length and r > rank]
        for nth in range(min(later, default=histogram[length]) - rank):
            filled.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
    assert len(filled) == bins
    for own in filled.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= capacity
    assert sorted(capacity - sum(n for _, n in own) for own in filled.values()) == best_fit(lengths, capacity)


def test_segment_tree():
    tree, counts, rng = packing.SegmentTree(50), {}, random.Random(1)
    for _ in range(500):
        c = rng.randint(1, 50)
        if counts.get(c) and rng.random() < 0.5:
            tree.add(c, -counts.pop(c))
        else:
            tree.add(c, 1)
            counts[c] = counts.get(c, 0) + 1
        least = rng.randint(1, 50)
        assert tree.tightest(least) == min((c for c in counts if c >= least), default=None)


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_pack(spark, edge_rows):
    rows = [*edge_rows, *[(100 + i, "word " * (37 * i % 900)) for i in range(60)]]
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    found = packing.pack(documents(spark, rows)).collect()
    want = []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(doc, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids)))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(want, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= 2048
    assert sorted(2048 - sum(n for _, n in s) for s in sequences.values()) == best_fit([n for *_, n, _ in want], 2048)
    assert packing.pack(documents(spark, [])).count() == 0


def test_caches_are_bounded_by_characters():
    """Chunks without white space, as Chinese has them, are not kept, and short ones only as many as there is room for."""
    rng = random.Random(6)
    chinese = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(1000)) for _ in range(40)]
    many = [" ".join(f"word{rng.randrange(10**9)}" for _ in range(2000)) for _ in range(60)]
    for made, run in ((tokens.token_counter(tokens.TOKENIZER), lambda c, t: c.count(t)), (packing.encoder(packing.TOKENIZER), lambda c, t: list(c.encode(t)))):
        run(made, chinese)
        assert all(len(c) <= 64 for c in made.cache)
        run(made, many)
        assert sum(map(len, made.cache)) <= 2 * max(tokens.CACHE_CHARS, packing.CACHE_CHARS)


def test_a_text_is_merged_in_one_call(monkeypatch):
    """Each text costs one call, however many words no text before it had."""
    path = public_tokenizers.path(packing.TOKENIZER)
    library, encoder, calls = Tokenizer.from_file(path), packing.Encoder(path), []
    merge = encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda text: calls.append(text) or merge(text))
    given = [" ".join(f"word{1000 * k + n}," for n in range(1000)) for k in range(3)] + ["  twice  blank\n \n" * 10]
    assert list(encoder.encode(given)) == [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(given, add_special_tokens=False)]
    assert calls == given


@pytest.mark.parametrize("space", ["\n", " "])
def test_long_runs_of_white_space(space):
    """Runs that the pattern gives up on have the library's ids."""
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    text = "one two" + space * 1_200_000 + "three four"
    assert list(encoder.encode([text])) == [np.array(encoder.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]


def test_short_texts_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHARS", 500)
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    given = [f"text {n % 90} of ninety" for n in range(400)] + ["", "<|endoftext|> x", "a " * 40]
    assert list(encoder.encode(given)) == [np.array(encoder.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in given]
    assert encoder.cache and all(len(t) <= packing.KEPT_CHARS for t in encoder.cache) and sum(map(len, encoder.cache)) <= 500 + packing.KEPT_CHARS
