from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sourceweave.llm import chat, common, langid, quality
from tests.llm.conftest import documents


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def plain_ngrams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(letters.split()) + " "
    if not line.strip():
        return Counter()
    out = Counter(c for c in line if c != " ")
    out.update(a + b for a, b in zip(line, line[1:]))
    out.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return out


def test_ngrams(monkeypatch):
    text = "Été à la Plage, 123 l'été!  東京 x"
    for block in (1 << 20, 7):
        monkeypatch.setattr(langid, "BLOCK_CHARS", block)
        keys, counts = langid.ngrams(text)
        decode = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s & 0x1FFFFF)
        found = {decode(int(k)): int(c) for k, c in zip(keys, counts)}
        if block > 100:
            assert found == dict(plain_ngrams(text))
    assert all(len(x) == 0 for x in langid.ngrams(None)) and all(len(x) == 0 for x in langid.ngrams("12 !!"))


def speech(rng, lang, n):
    pools = {"en": "the of and to in that with have this from they which".split(), "de": "der die und nicht ein ist mit auf für werden über".split(), "fr": "le la les des une est dans pour qui être où".split()}
    return " ".join(rng.choice(pools[lang]) for _ in range(n))


def test_languages(spark):
    rng = random.Random(3)
    rows = [(i, speech(rng, lang := ("en", "de", "fr")[i % 3], rng.randint(4, 40)), lang) for i in range(240)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !!", "en"), (1003, rows[0][1], None), (None, rows[1][1], "de"), (0, rows[0][1], "en")]
    found = langid.identify(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].held_out == (fold(i, 5) == 0) for i in range(240))
    out = [by[i].lang_pred == lang for i, _, lang in rows[:240] if fold(i, 5) == 0]
    assert np.mean(out) > 0.95
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and [by[i].score for i in (1000, 1001, 1002)] == [0.0] * 3
    assert all(0 <= r.score <= 1 for r in found)
    kept = langid.identified(documents(spark, rows))
    assert kept.count() == len(rows) - 3 and kept.columns == documents(spark, []).columns
    # held-out languages and the other columns change nothing
    other = documents(spark, [(i, t, "xx" if i is not None and fold(i, 5) == 0 else lang) for i, t, lang in rows])
    assert sorted((str(r.doc_id), r.lang_pred, r.score) for r in langid.identify(other).collect()) == sorted((str(r.doc_id), r.lang_pred, r.score) for r in found)


def test_languages_without_training_rows(spark):
    assert [r.lang_pred for r in langid.identify(documents(spark, [(1, "some words", None)])).collect()] == ["und"]
    assert langid.identify(documents(spark, [])).count() == 0


def test_distance_is_out_of_place():
    profiles = langid.Profiles({"a": [1, 2, 3], "b": [3, 2, 1]})
    own = langid.top_ngrams(*langid.ngrams("ab"))
    keys = own.tolist()
    profiles = langid.Profiles({"near": keys, "far": keys[::-1]})
    n = len(keys)
    want = sum(abs(2 * k - n + 1) for k in range(n))
    assert profiles.predict("ab") == ("near", pytest.approx(1.0)) and want > 0


def test_statistics_of_edges():
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.FEATURES)
    for text in (" ", "\n", "x", "été", "!" * 10_000):
        values = quality.statistics(text)
        assert len(values) == len(quality.FEATURES) and np.isfinite(values).all()


def test_statistics_of_stretches(monkeypatch):
    text = "The the cat Sat sat sat\non on ON the mat!! x1 " * 9
    whole = quality.statistics(text)
    for size in (1, 5, 30):
        monkeypatch.setattr(quality, "slices", lambda raw, size=size: common.slices(raw, size))
        assert quality.statistics(text) == pytest.approx(whole)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.BoostedTrees().fit(x[:2000], y[:2000])
    p = trees.score(x[2000:])
    assert ((p >= 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = trees.start
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 + (row[feature[at]] > cut[at])
            total += value[at]
        return 1 / (1 + np.exp(-total))

    assert p[:50] == pytest.approx([walk(r) for r in x[2000:2050]])
    assert quality.BoostedTrees().fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.BoostedTrees().fit(x[:9], np.ones(9)).score(x[:1])[0] > 0.99


def test_quality(spark):
    rng = random.Random(8)
    rows = [(i, speech(rng, "en", 30) if i % 3 else " ".join(speech(rng, "en", 9).upper().split()) + "!! ### $$$" * 3) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, None, 0), (10**6, 1, 0)], "doc_id bigint, quality int, toxic int")
    table = documents(spark, [*rows, (None, "some words"), (700, None), (701, ""), (0, rows[0][1])])
    found = quality.classify(table, labels).collect()
    assert len(found) == 604
    by = {r.doc_id: r for r in found}
    out = [by[i].predicted == int(i % 3 > 0) for i in range(600) if fold(i, 3) == 1]
    assert np.mean(out) > 0.97 and all(by[i].held_out == (fold(i, 3) == 1) for i in range(600))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    flipped = labels.rdd.map(lambda r: (r.doc_id, None if r.quality is None else 1 - r.quality if fold(r.doc_id, 3) == 1 else r.quality, 0)).toDF(labels.schema)
    again = {r.doc_id: r.score for r in quality.classify(table, flipped).collect()}
    assert again == {r.doc_id: r.score for r in found}
    assert {r.score for r in quality.classify(table, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(documents(spark, []), labels).count() == 0


CHATS = "conv_id bigint, turn bigint, role string, text string, part string, seen int"


def conversations(rng, n):
    rows = []
    for c in range(n):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(1, 4)
        for t, role in enumerate(roles):
            size = {"system": 90, "user": 30, "assistant": 400}[role]
            rows.append((c, t, role, "words and " * rng.randint(size // 20, size // 8) + ("?" if role == "user" else "."), "x", 1))
    return rows


def test_units():
    text = "Hello there\nUser: Hi\nmore\n### Assistant: Yes?\n<|im_start|>system\nRules<|im_end|>\n**Human:** bye"
    assert chat.split_units(text) == [("", "Hello there"), ("user", "Hi\nmore"), ("assistant", "Yes?"), ("system", "Rules"), ("user", "bye")]
    assert chat.split_units(None) == chat.split_units("") == [("", "")] and chat.split_units("no: marker here") == [("", "no: marker here")]


def all_paths(model, emissions):
    import itertools

    change, start = model.change.tolist(), model.start.tolist()
    best = max(itertools.product(range(3), repeat=len(emissions)), key=lambda p: start[p[0]] + sum(e[k] for e, k in zip(emissions, p)) + sum(change[a][b] for a, b in zip(p, p[1:])))
    return list(best)


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_finds_the_best_path_and_stretches_join(seed):
    rng = np.random.default_rng(seed)
    model = chat.Model(rng.integers(0, 9, 3), rng.integers(0, 9, (3, 3)), rng.integers(0, 9, (3, chat.N_OBSERVATIONS)))
    emissions = [model.emissions(1, t, 0, rng.choice(["", "user"]), int(rng.integers(0, 9))) for t in range(7)]
    whole = chat.viterbi(model, emissions)
    assert whole == all_paths(model, emissions)
    for cuts in ([3], [1, 2], [2, 5], [1, 6]):
        stretches = [emissions[a:b] for a, b in zip([0, *cuts], [*cuts, 7])]
        told = []
        for part, own in enumerate(stretches):
            rest = chat.transfer(model, own[1:]) if len(own) > 1 else np.where(np.eye(3, dtype=bool), 0, -(1 << 60))
            told.append((part, 1, chat.transfer(model, own).ravel().tolist(), own[0], rest.ravel().tolist()))
        plans = chat._chain(model, told)
        joined = [k for part, own in enumerate(stretches) for k in chat.viterbi(model, own, *plans[part, 1])]
        assert joined == whole


def test_chat(spark):
    rng = random.Random(6)
    rows = conversations(rng, 150)
    found = chat.parse(spark.createDataFrame(rows, CHATS)).collect()
    assert len(found) == len(rows)
    role = {(r[0], r[1]): r[2] for r in rows}
    out = [r.role_pred == role[r.conv_id, r.turn] for r in found if fold(r.conv_id, 5) == 0]
    assert np.mean(out) > 0.95
    assert all(r.rendered == f"<|im_start|>{r.role_pred}\n{r.content}<|im_end|>\n" for r in found)
    # one long transcript over all parts is read as in one piece
    long = [(7, i, *r[2:]) for i, r in enumerate(rows)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = sorted((r.turn, r.role_pred) for r in chat.parse(spark.createDataFrame(long, CHATS)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    four = sorted((r.turn, r.role_pred) for r in chat.parse(spark.createDataFrame(long, CHATS)).collect())
    assert one == four and len(four) == len(rows)


def test_chat_edges(spark):
    rows = [(None, None, None, None), (1, 0, "user", "User: a\nAssistant: b"), (1, 0, "user", "User: a\nAssistant: b"), (1, None, "odd", ""), (2, 5, "SYSTEM ", "x")]
    found = chat.parse(spark.createDataFrame([(*r, "p", 1) for r in rows], CHATS)).collect()
    assert len(found) == 7
    assert [r.role_pred for r in found if r.content in ("a", "b")].count("user") == 2
    assert chat.parse(spark.createDataFrame([], CHATS)).count() == 0


def test_ngrams_of_blocks(monkeypatch):
    """Counts don't depend on the blocks that a text is counted in, in the middle of words as well."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcÉß 12!\nΣ東") for _ in range(n)) for n in (1, 2, 6, 7, 8, 40, 300)] + ["x" * 50, " " * 20, "ab", "ΑΣ" * 10 + " ΑΣ"]
    decode = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s & 0x1FFFFF)
    for block in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(langid, "BLOCK_CHARS", block)
        for text in texts:
            keys, counts = langid.ngrams(text)
            assert {decode(int(k)): int(c) for k, c in zip(keys, counts)} == dict(plain_ngrams(text)), (block, text)


def plain_predict(profiles, text):
    """Out-of-place distances, n-gram by n-gram."""
    encode = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    counts = {encode(g): n for g, n in plain_ngrams(text).items()}
    own = sorted(counts, key=lambda k: (-counts[k], k))[: langid.PROFILE]
    if not own:
        return "und", 0.0
    far = []
    for name in sorted(profiles):
        place = {k: r for r, k in enumerate(profiles[name])}
        far.append((sum(abs(place[k] - r) if k in place else langid.PROFILE for r, k in enumerate(own)), name))
    best = min(far)
    second = min(d for d, name in far if name != best[1])
    return best[1], (second - best[0]) / second if second else 0.0


def test_predictions_are_the_plain_distances():
    rng = random.Random(2)
    learnt = {lang: langid.top_ngrams(*langid.ngrams(speech(rng, lang, 300))).tolist() for lang in ("en", "de", "fr")}
    profiles = langid.Profiles(learnt)
    for text in [speech(rng, rng.choice(("en", "de", "fr")), n) for n in (1, 2, 5, 30, 400)] + ["", "12", "zzz", "the der les"]:
        name, score = plain_predict(learnt, text)
        assert profiles.predict(text) == (name, pytest.approx(score))


def plain_split(x, gradient, weight):
    """The best cut over all values of all features, row by row."""
    best = None
    rows, g, h = len(x), sum(gradient), sum(weight)
    for f in range(x.shape[1]):
        for cut in sorted(set(x[:, f]))[:-1]:
            left = [i for i in range(rows) if x[i, f] <= cut]
            if min(len(left), rows - len(left)) < quality.LEAST_ROWS:
                continue
            gl, hl = sum(gradient[i] for i in left), sum(weight[i] for i in left)
            gain = gl**2 / (hl + quality.RIDGE) + (g - gl) ** 2 / (h - hl + quality.RIDGE) - g**2 / (h + quality.RIDGE)
            if gain > (best[0] if best else 1e-6):
                best = (gain, f, cut)
    return best


def test_splits_are_the_best_ones():
    rng = np.random.default_rng(4)
    for _ in range(5):
        x = rng.integers(0, 9, size=(90, 3)).astype(float)
        gradient, weight = rng.normal(size=90), rng.uniform(0.1, 0.25, size=90)
        edges = [np.unique(x[:, f]) for f in range(3)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        feature, at = quality.BoostedTrees._split(binned, gradient, weight, edges)
        gain, want, cut = plain_split(x, gradient, weight)
        assert (feature, edges[feature][at]) == (want, cut)


def test_statistics_are_the_plain_ones():
    text = "The THE cat, 12 été!\nthe cat\n\nthe cat"
    found = dict(zip(quality.FEATURES, quality.statistics(text)))
    raw, parts, lines = text.encode(), text.encode().split(), text.encode().split(b"\n")
    share = lambda test: sum(map(test, raw)) / len(raw)
    counts = Counter(raw)
    want = {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(parts)), "word_length": sum(map(len, parts)) / len(parts), "distinct_words": len(set(parts)) / len(parts),
        "top_word": max(Counter(parts).values()) / len(parts), "repeated_next": sum(a == b for a, b in zip(parts, parts[1:])) / len(parts), "upper": share(lambda b: 65 <= b <= 90),
        "lower": share(lambda b: 97 <= b <= 122), "digit": share(lambda b: 48 <= b <= 57), "space": share(lambda b: b in b" \t\n\r"), "beyond_ascii": share(lambda b: b > 127), "marks": share(lambda b: b in b"!?"),
        "stops": share(lambda b: b in b".,;:"), "byte_entropy": -sum(n / len(raw) * np.log2(n / len(raw)) for n in counts.values()), "log_lines": np.log1p(len(lines)), "line_length": len(raw) / len(lines),
        "distinct_lines": len(set(lines)) / len(lines), "longest_word": np.log1p(max(map(len, parts))), "capitalised": sum(p.istitle() for p in parts) / len(parts),
    }
    assert {k: found[k] for k in want} == pytest.approx(want)


def test_edges_of_models(spark, edge_rows):
    """Null, empty, blank, tied and repeated rows and a text beyond a stretch, through the classifier and the language profiles."""
    long = "The committee of the town. " * 90_000
    assert len(long) > common.SLICE
    table = documents(spark, [*edge_rows, (40, long), (41, "a" * 3000 + " " + "b" * 3000)])
    labels = spark.createDataFrame([(d, d % 2, 0) for d in (1, 2, 3, 4, 5, 40)], "doc_id bigint, quality int, toxic int")
    scored = quality.classify(table, labels).collect()
    assert len(scored) == len(edge_rows) + 2 and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (1, 2)}) == 1  # null and empty texts
    told = langid.identify(table).collect()
    assert len(told) == len(scored) and {r.lang_pred for r in told if r.doc_id in (1, 2, 3, 10)} == {"und"}
    assert {r.lang_pred for r in told if r.doc_id == 40} == {"en"}


def test_long_transcripts(spark):
    """A turn of more than a stretch, and a transcript of many turns with null texts and repeats."""
    rows = [(1, 0, "user", "User: " + "word " * 500_000, "p", 1), (1, 1, "assistant", "Yes.", "p", 1)] + [(2, t, "user" if t % 2 == 0 else "assistant", None if t == 5 else f"line {t}", "p", 1) for t in range(300)] * 2
    found = chat.parse(spark.createDataFrame(rows, CHATS)).collect()
    assert len(found) == len(rows) and max(len(r.content or "") for r in found) == len("word " * 500_000) - 1
