from __future__ import annotations

import json
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sourceweave.functions.scores import DEFAULT
from sourceweave.operators import claims, clusters, dedup, export, metrics, pivots, quality, resampling, rivals, sweep, timebins, topics
from sourceweave.sources import tables


def truth(spark, scores, labels):
    return spark.createDataFrame([("m", i, None if s is None else float(s), y) for i, (s, y) in enumerate(zip(scores, labels))], "method string, i int, score double, label int")


def test_auc_extremes_and_ties(spark):
    at = lambda s, y: metrics.roc_auc(truth(spark, s, y), ["method"]).first().roc_auc
    assert at([90, 85, 80, 40, 30, 20], [1, 1, 1, 0, 0, 0]) == 1.0
    assert at([20, 30, 40, 80, 85, 90], [1, 1, 1, 0, 0, 0]) == 0.0
    assert at([5, 5, 5, 5], [1, 0, 1, 0]) == 0.5
    assert at([1, 2], [1, 1]) is None
    assert at([1, None, 3, float("nan")], [0, 1, 1, 0]) == 1.0


def test_correlations_of_constants_are_null(spark):
    rows = truth(spark, [5, 5, 5], [1, 0, 1])
    assert metrics.pearson(rows, ["method"]).first().pearson_r is None
    assert metrics.spearman(rows, ["method"]).first().spearman_rho is None


@pytest.mark.parametrize(("r", "n", "p", "tolerance"), [(0.7951, 20, 2.8e-5, 5e-6), (0.2542, 20, 0.2795, 5e-4)])
def test_p_values(r, n, p, tolerance):
    assert metrics.pearson_p(r, n) == pytest.approx(p, abs=tolerance)
    assert metrics.pearson_p(1.0, n) is None and metrics.pearson_p(r, 2) is None


def test_decisions(spark):
    row = metrics.classification(truth(spark, [90, 80, 70, 60], [1, 1, 0, 0]), ["method"], 75).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.f1, row.accuracy) == (2, 0, 0, 2, 1.0, 1.0)


def test_best_threshold_is_the_lowest_of_equals(spark):
    best = metrics.best_threshold(truth(spark, [90, 80.5, 70, 60], [1, 1, 0, 0]), ["method"]).first()
    assert (best.threshold, best.f1) == (71, 1.0)

    rng = random.Random(3)
    scores, labels = [rng.uniform(0, 120) for _ in range(60)], [rng.randint(0, 1) for _ in range(60)]

    def rate(t):
        tp = sum(s >= t and y for s, y in zip(scores, labels))
        fp, fn = sum(s >= t and not y for s, y in zip(scores, labels)), sum(s < t and y for s, y in zip(scores, labels))
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        return round(f1, 4), round((60 - fp - fn) / 60, 4)

    want = max(range(5, 100), key=lambda t: (*rate(t), -t))
    assert metrics.best_threshold(truth(spark, scores, labels), ["method"]).first().threshold == want


def test_evaluate(spark):
    row = metrics.evaluate(truth(spark, [90, 80, 70, 60, None], [1, 1, 0, 0, 1]), ["method"], 75.0).first()
    assert (row.n, row.mean_true, row.mean_false, row.separation, row.roc_auc) == (4, 85.0, 65.0, 20.0, 1.0)
    small = metrics.evaluate(truth(spark, [90, 80], [1, 0]), ["method"]).first()
    assert small.n == 2 and small.roc_auc is None


def test_resampling_follows_the_generator(spark):
    rng = random.Random(5)
    scores, labels = [rng.random() for _ in range(14)], [i % 2 for i in range(14)]
    rows = truth(spark, scores, labels)
    s, y = np.array(scores), np.array(labels)
    draws = sorted(resampling.auc(s[d], y[d]) for d in map(np.array, resampling.bootstrap_draws(14, 100, 7)) if 0 < y[d].sum() < 14)
    low = resampling.bootstrap_interval(rows, "i", 100, draws="rows").first()
    assert (low.auc_lo, low.auc_hi) == (round(draws[int(0.025 * len(draws))], 4), round(draws[int(0.975 * len(draws))], 4))
    seen = abs(resampling.auc(s, y) - 0.5)
    hits = sum(abs(resampling.auc(s, np.array(d)) - 0.5) >= seen for d in resampling.permutation_draws(labels, 100, 7))
    assert resampling.permutation_test(rows, "i", 100, draws="rows").first().auc_p == hits / 100
    assert resampling.bootstrap_interval(truth(spark, [1, 2, 3], [1, 0, 1]), "i").first().auc_lo is None
    assert resampling.bootstrap_interval(truth(spark, [1, 2, 3], [1, 0, 1]), "i", draws="rows").first().auc_lo is None


def test_resampling_by_counts_has_the_same_law(spark, monkeypatch):
    rng = random.Random(8)
    labels = [int(rng.random() < 0.4) for _ in range(300)]
    rows = truth(spark, [round(rng.gauss(0.12 * y, 1), 1 + i % 2) for i, y in enumerate(labels)], labels)
    low, p = resampling.bootstrap_interval(rows, "i", 1000, draws="rows").first(), resampling.permutation_test(rows, "i", 1000, draws="rows").first().auc_p
    for levels in (resampling.LEVELS, 64):  # one block and several
        monkeypatch.setattr(resampling, "LEVELS", levels)
        counted = resampling.bootstrap_interval(rows, "i", 1000).first()
        assert (counted.auc_lo, counted.auc_hi) == pytest.approx((low.auc_lo, low.auc_hi), abs=0.015)
        assert resampling.permutation_test(rows, "i", 1000).first().auc_p == pytest.approx(p, abs=0.06)
        assert resampling.bootstrap_interval(rows, "i", 1000).first() == counted
    assert resampling._blocks(rows).select("block").distinct().count() > 1
    assert resampling.permutation_test(rows.withColumn("label", F.lit(1)), "i", 10).first().auc_p is None


def test_choice_without_replacement():
    counts = np.array([5, 0, 40, 3, 52])
    picked = np.stack([resampling._choose(counts, 30, np.random.default_rng(i)) for i in range(3000)])
    assert (picked.sum(axis=1) == 30).all() and (picked >= 0).all() and (picked <= counts).all()
    assert picked.mean(axis=0) == pytest.approx(0.3 * counts, abs=0.2)
    assert picked.var(axis=0) == pytest.approx(30 * counts / 100 * (1 - counts / 100) * 70 / 99, rel=0.12)


def test_resampling_of_more_than_a_million_rows(spark):
    rows = spark.range(1_200_000).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(400_000)).cast("double").alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("label"))
    low = resampling.bootstrap_interval(rows, "i", 40).first()
    assert 0.496 < low.auc_lo < low.auc_hi < 0.504 and low.auc_hi - low.auc_lo < 0.004
    assert 0 <= resampling.permutation_test(rows, "i", 40).first().auc_p <= 1


@pytest.mark.parametrize("levels", [0, 10**6])
def test_all_statistics_against_numpy(spark, monkeypatch, levels):
    """Correlations, areas and means of groups with ties, a null group, a constant group and a group of one class."""
    monkeypatch.setattr(metrics, "LEVELS", levels)
    rng = np.random.default_rng(2)
    rows = [(g, i, float(rng.choice([round(rng.normal(), 1), rng.normal()])), int(rng.integers(0, 2))) for i in range(300) for g in ("a", None)]
    rows += [("flat", i, 7.1, i % 2) for i in range(9)] + [("ones", i, float(i), 1) for i in range(9)]
    found = {r.g: r for r in metrics.rank_statistics(metrics.levels(spark.createDataFrame(rows, "g string, i int, score double, label int"), ["g"]), ["g"]).collect()}
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for g in ("a", None):
        s, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (2, 3))
        assert found[g].pearson_r == pytest.approx(np.corrcoef(s, y)[0, 1]) and found[g].spearman_rho == pytest.approx(np.corrcoef(rank(s), rank(y))[0, 1])
        assert (found[g].mean_true, found[g].mean_false) == pytest.approx((s[y == 1].mean(), s[y == 0].mean())) and found[g].roc_auc == pytest.approx(resampling.auc(s, y))
    assert (found["flat"].pearson_r, found["flat"].spearman_rho, found["flat"].roc_auc) == (None, None, 0.5)
    assert (found["ones"].pearson_r, found["ones"].roc_auc, found["ones"].mean_false) == (None, None, None)


def test_a_score_that_half_of_all_rows_have(spark):
    """Mid-ranks are looked up by cells, so no task of the join gets the half."""
    rows = spark.range(4000).selectExpr("id as i", "cast(case when id % 2 = 0 then 5 else id end as double) as score", "cast(id % 3 = 0 as int) as label", "'m' as method")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = metrics.midranks(rows, ["method"])
        assert found.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0] < 0.45 * 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.midrank for r in found.where("score = 5").collect()} == {3 + (2001 + 1) / 2 - 1}


def bundles(spark):
    article = lambda t, d, body=True, stance="neutral", x="": {"title": t, "domain": d, "text": x, "body_available": body, "url_resolved": True, "stance": stance}
    rows = [
        {"claim_id": "A", "summary": "s", "articles": [article("t", "a"), article("SHOCKING truth exposed", "b", False, "debunk"), article("t", "a")], "similarities": [0.9, 0.5, 0.6], "pairwise": [[1.0, 0.5, 0.4], [0.5, 1.0, 0.3], [0.4, 0.3, 1.0]], "claims": ["x", "y"], "claim_similarities": [[0.6, 0.55, 0.1], [0.6, 0.54, 0.9]]},
        {"claim_id": "B", "summary": "s", "articles": [], "similarities": [], "pairwise": None, "claims": [], "claim_similarities": None},
    ]
    return spark.createDataFrame(rows, tables.BUNDLE)


def test_rival_scores(spark):
    found = {(r.claim_id, r.method): r.score for r in rivals.score_bundles(bundles(spark)).collect()}
    assert found["A", "source_count"] == 65 and found["B", "source_count"] == 45
    assert found["A", "semantic_only"] == round(30 + 70 * (0.9 + 0.5 + 0.6) / 3, 2) and found["B", "semantic_only"] == 0
    assert found["A", "claim_substantiation"] == round(100 * (0.75 * 0.5 + 0.25 * 2 / 3), 2) and found["B", "claim_substantiation"] == 0
    assert found["A", "evidence_verdict"] == pytest.approx(100 * (0.5 + 0 + 0.5) / 2.5 * (0.6 + 0.4 * 0.4)) and found["B", "evidence_verdict"] == 0


def test_reputation(spark):
    profiles = spark.createDataFrame([("a", True, True, False, False, True, False, True, False)], "domain string, reachable boolean, about boolean, corrections boolean, staff boolean, contact boolean, has_bylines boolean, labels_ads boolean, labels_opinion boolean")
    found = {r.claim_id: r.score for r in rivals.reputation(bundles(spark), profiles).collect()}
    assert found == {"A": (22 + 18 + 10 + 7.5 + 7.5 + 5 + 0) / 2, "B": 0.0}


def test_bundle_counts(spark):
    found = {r.claim_id: (r.n_articles, r.n_domains, r.n_debunk) for r in tables.count_articles(bundles(spark)).collect()}
    assert found == {"A": (3, 2, 1), "B": (0, 0, 0)}


def test_coherence_agrees_with_the_pairs(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 6))
    v[3] = 0
    rows = spark.createDataFrame([(i, i % 3 if i else 9, x.tolist(), f"s{i % 4}") for i, x in enumerate(v)], "id int, label int, v array<double>, source string")
    found = {r.label: r.coherence for r in clusters.pairwise_coherence(rows, "label", "v").collect()}
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    for label in range(3):
        own = u[[i for i in range(1, 40) if i % 3 == label]]
        pairs = (own @ own.T)[np.triu_indices(len(own), 1)]
        assert found[label] == pytest.approx(pairs.mean(), abs=1e-12)
    assert found[9] is None
    lone = {r.label: r for r in clusters.score_clusters(rows, "label", "v", "source", "id").collect()}[9]
    assert lone.source_coherence == 0.5 and lone.n_sources == 1
    assert clusters.score_clusters(rows.limit(0), "label", "v", "source", "id").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_semantic_dedup_is_the_sequential_rule(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(60, 3))
    rows = spark.createDataFrame([(i, x.tolist(), "x" * int(rng.integers(0, 6))) for i, x in enumerate(v)], "id bigint, v array<double>, text string")
    edges = dedup.cosine_edges(rows, "id", "v", 0.9, block=13)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.9]
    assert sorted((r.i, r.j) for r in edges.collect()) == want
    length, gone = {r.id: len(r.text) for r in rows.collect()}, set()
    for i, j in want:
        if i not in gone and j not in gone:
            gone.add(i if length[i] < length[j] else j)
    assert sorted(r.id for r in dedup.semantic_dedup(rows, "id", "text", edges).collect()) == [i for i in range(60) if i not in gone]


@pytest.mark.parametrize("seed", range(3))
def test_unseen_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    key = lambda p: rng.choice([None, "", *[f"{p}{k}" for k in range(12)]])
    old = [(i, key("u"), key("t")) for i in range(6)]
    new = [(i, key("u"), key("t")) for i in range(10, 40)]
    urls, names = {u for _, u, _ in old if u}, {t for _, _, t in old if t}
    want = []
    for i, u, t in new:
        if (u and u in urls) or (t and t in names):
            continue
        want.append(i)
        urls.add(u)
        names.add(t)
        urls -= {None, ""}
        names -= {None, ""}
    schema = "ord bigint, url string, title string"
    # a key of the history that is null or empty matches nothing
    found = dedup.unseen(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), ("url", "title"), "ord")
    assert sorted(r.ord for r in found.collect()) == want


def test_keep_first(spark):
    rows = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "id int, k string")
    assert sorted(r.id for r in dedup.keep_first(rows, ["k"], "id").collect()) == [1, 3]


def test_label_terms():
    assert topics.label_terms(["trump", "trump administration", "administration", "source"], stop=frozenset({"source"})) == ["trump administration"]
    assert topics.label_terms(["rate", "rates", "x y", "the", "election day"], stop=frozenset({"the"})) == ["rate", "election day"]
    assert topics.label_terms(["a1 b1", "c1", "d1", "e1", "f1"], n=3) == ["a1 b1", "c1", "d1"]
    assert topics.label_terms([]) == []


def test_class_tfidf(spark):
    docs = spark.createDataFrame([(0, "apple apple pear"), (1, "pear plum")], "c int, t string")
    weighed = {(r.c, r.term): r.weight for r in topics.class_tfidf(topics.term_counts(docs, "c", "t", bigrams=False), "c", 3).collect()}
    mean = 5 / 3
    assert weighed[0, "apple"] == pytest.approx(2 * math.log(1 + mean / (1 + 1e-5)))
    assert weighed[1, "pear"] == pytest.approx(math.log(1 + mean / (2 + 1e-5)))
    named = {r.c: r.label for r in topics.labels(topics.top_terms(topics.class_tfidf(topics.term_counts(docs, "c", "t"), "c", 2), "c"), "c").collect()}
    assert named[0].startswith("0_")


def test_summaries(spark):
    s = [f"The {w} committee agreed on Tuesday to lower the {w} rate by {w} points again." for w in ("alpha", "beta", "gamma", "delta")]
    docs = spark.createDataFrame([(0, " ".join(s)), (1, s[0] + " Hm. " + s[1]), (2, ""), (3, None)], "id int, t string")
    found = {r.id: r.summary for r in topics.extractive_summaries(docs, "id", "t").collect()}
    assert found[0] == " ".join(s[1:]) and found[1] == f"{s[0]} {s[1]}" and found[2] == found[3] == "..."


def test_stratified_split_is_the_running_count(spark):
    for n in (1, 2, 3, 4, 7, 8, 9, 15, 23):
        rows = spark.createDataFrame([("T", i) for i in range(n)], "verdict string, i int")
        found = {r.i: r.split for r in claims.stratified_split(rows, "verdict", ["i"]).collect()}
        used, want = 0, {}
        for i in range(n):
            fit = i % 5 < 3 and used < round(0.6 * n)
            used += fit
            want[i] = "calibration" if fit else "evaluation"
        assert found == want


def test_collect_claims(spark):
    rows = [(i, f"Claim {i // 2}", r, "2024", "https://a//b") for i, r in enumerate(["True", "True", "Fake", "Mixture", "False", "Mostly True"])]
    found = claims.collect_claims(spark.createDataFrame(rows, "i int, claim string, rating string, date string, url string"), 2, "i")
    assert sorted((r.i, r.verdict, r.url) for r in found.collect()) == [(0, "TRUE", "https://a/b"), (2, "FALSE", "https://a/b"), (4, "FALSE", "https://a/b")]


def test_quality_report(spark):
    rows = [("https://www.reuters.com/a", "", "x" * 400, True), ("https://news.google.com/a", None, "x" * 350, True), ("https://news.google.com/b", "https://cnn.com", "x" * 10, None)]
    report = quality.quality_report(spark.createDataFrame(rows, "url string, publisher_url string, text string, body_available boolean")).first()
    assert tuple(report) == (3, 0.6667, 0.6667, 0.6667, 350, 2, 1)
    legacy = quality.quality_report(spark.createDataFrame([("u", "x" * 300), ("u", "x" * 299)], "url string, text string")).first()
    assert legacy.body_share == 0.5
    empty = quality.quality_warnings(quality.quality_report(spark.createDataFrame([], "url string, text string"))).first()
    assert (empty.documents, empty.median_body_chars, empty.warnings) == (0, 0, [])


def test_assemble_row(spark):
    body = "word " * 80
    rows = spark.createDataFrame([(0, "T - Reuters", "https://x.com", body, "s"), (1, "Title here", "https://news.google.com/a", "short", "a longer snippet that says what the article is about"), (2, "Title", "u", None, None)], "n int, title string, url string, body string, snippet string")
    none = F.lit(None).cast("string")
    found = rows.select("n", *quality.assemble_row(F.lit("topic"), F.col("title"), F.col("url"), F.lit("2024"), F.col("snippet"), none, none, F.col("body"))).orderBy("n").collect()
    assert [(r.title, r.text[:7], r.url_resolved, r.body_available) for r in found] == [("T", "word wo", True, True), ("Title here", "a longe", False, False), ("Title", "Title", False, False)]


def test_time_bins(spark):
    days = spark.createDataFrame([(f"2024-01-{d:02d}", "a" if d < 20 else "b") for d in range(1, 31)] + [(None, "a")], "d string, t string").withColumn("ts", F.to_timestamp("d"))
    found = timebins.topics_over_time(days, "ts", "t").collect()
    assert len(found) == 12 and sum(r.frequency for r in found) == 30
    assert {r.bin: r.frequency for r in found if r.topic == "a"}[0] == 5  # the first four days and five sixths, closed on the right
    assert [timebins.bin_count(d) for d in (0, 7, 8, 70, 400)] == [6, 6, 6, 10, 20]
    one = timebins.topics_over_time(days.limit(1), "ts", "t").collect()
    assert sum(r.frequency for r in one) == 1 and len(one) == 6


def test_dates(spark):
    rows = spark.createDataFrame([("2024-03-01",), ("Fri, 01 Mar 2024 08:15:00 GMT",), ("March 1, 2024",), ("nonsense",), (None,)], "d string")
    assert [r.y for r in rows.select(F.year(timebins.parse_date(F.col("d"))).alias("y")).collect()] == [2024, 2024, 2024, None, None]


def test_sweep_and_transfer(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, "calibration" if i % 3 else "evaluation", [rng.random() for _ in range(5)], [str(k % (2 + i % 5)) for k in range(5)], [rng.random() for _ in range(10)]) for i in range(40)]
    evidence = spark.createDataFrame(rows, "id int, label int, split string, similarities array<double>, sources array<string>, upper array<double>")
    scored = sweep.score_variants(evidence, sweep.params_table(spark), "id", "label")
    assert scored.count() == 40 * 20
    best = sweep.best_variants(sweep.rate_variants(scored))
    assert best.count() == 5
    params = sweep.tuned(best)
    table = {r.split: r for r in sweep.transfer(evidence, params).collect()}
    assert set(table) == {"calibration", "evaluation"} and table["calibration"].n == 26
    same = sweep.transfer(evidence, DEFAULT).first()
    assert same.production_auc == same.tuned_auc
    assert sweep.calibrate_stance(evidence.withColumn("support", F.col("label").cast("double"))) in sweep.STANCE_BASES


def test_find_topic(spark):
    names = spark.createDataFrame([(0, "Rate Cut Summit"), (1, "Rate Cut"), (2, "Climate")], "ord int, topic string")
    at = lambda n: [r.topic for r in export.find_topic(names, n).collect()]
    assert at(" rate cut ") == ["Rate Cut"] and at("rate") == ["Rate Cut Summit"] and at("the climate deal") == ["Climate"] and at("x") == [] and at("  ") == []


def test_dossier(spark):
    rows = spark.createDataFrame([(0, "T", 3, 0.3, 80, ["a", "b"], "sum", "k", "p"), (1, "U", 1, 0.0, 50, ["a"], "s", "k", "p")], "id int, topic string, n int, mean_sentiment double, final_score int, sources array<string>, summary string, keywords string, places string")
    entries = export.dossier(rows, "id").collect()
    assert len(entries) == 1 and "CONSENSUS: WEAK (2 sources: a, b)" in entries[0].entry and "80/100 ok" in entries[0].entry


def test_projection_is_the_truncated_svd(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(30, 5)) * np.array([5, 3, 1, 1, 1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, v array<double>").repartition(3)
    found = np.array([r.xy for r in clusters.projection(rows, "v").orderBy("id").collect()])
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    assert np.abs(found) == pytest.approx(np.abs(u[:, :2] * s[:2]))
    assert clusters.projection(rows.limit(0), "v").count() == 0


def test_kmeans_puts_each_row_at_its_nearest_centre(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, (np.eye(3)[i % 3] * 5 + rng.normal(size=3)).tolist()) for i in range(60)], "id int, v array<double>")
    found, centres = clusters.kmeans(rows, "v", 3)
    again = clusters.nearest_centroid(found, "v", centres, "topic")
    assert again.where("nearest <> topic").count() == 0 and centres.count() == 3


def test_keyphrases(spark):
    from sourceweave.hooks import hash_words

    docs = spark.createDataFrame([(0, "apple apple pear plum")], "id int, t string").withColumn("v", hash_words(256)(F.col("t")))
    found = topics.keyphrases(docs, "id", "t", "v", hash_words(256), 2).first()
    assert "apple pear" in found.phrases or "apple" in found.phrases and len(found.phrases) == 2


def test_tfidf_overlap_of_edges(spark):
    own = spark.createDataFrame([("a", "rates rise again"), ("b", ""), ("c", "alone here")], "k string, summary string")
    docs = spark.createDataFrame([("a", 1, "rates rise again"), ("a", 2, "cats sleep"), ("b", 3, "x y")], "k string, id int, text string")
    found = {r.k: r.score for r in topics.tfidf_overlap(own, docs, "k", "id").collect()}
    assert found["b"] == found["c"] == 0 and 49 < found["a"] < 51


def test_reports(spark):
    rows = spark.createDataFrame([(json.dumps([{"topic": "<b>", "articles": [{"title": "t&", "url": "javascript:x", "snippet": "s" * 300, "source": "a"}]}]),)], "json string")
    page = export.report_html(tables.read_export(rows)).first()
    assert "&lt;b&gt;" in page.html and 'href="#"' in page.html and "s" * 197 + "..." in page.html and "s" * 198 not in page.html and "not scored" in page.html


def test_ranks_by_ranges(spark, monkeypatch):
    """Mid-ranks and the AUC don't depend on the ranges; a null group is a group; ties and repeats count."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([round(rng.random(), 1), rng.random()]), rng.randint(0, 1)) for i in range(400)]
    table = spark.createDataFrame(rows, "g string, i int, score double, label int")
    want = {}
    for g, _, s, y in rows:
        own = [(t, z) for h, _, t, z in rows if h == g]
        won = [(t < s) + (t == s) / 2 for t, z in own if z == 0] if y else []
        want.setdefault(g, []).extend(won)
    for ranges, levels in ((1, 0), (3, 0), (64, 0), (64, 10**6)):
        monkeypatch.setattr(metrics, "RANGES", ranges)
        monkeypatch.setattr(metrics, "LEVELS", levels)
        found = {r.g: r.roc_auc for r in metrics.roc_auc(table, ["g"]).collect()}
        assert found == {g: pytest.approx(sum(w) / len(w)) for g, w in want.items()}
        ranks = {r.score: r.midrank for r in metrics.score_ranks(table.where("g = 'a'"), ["g"]).collect()}
        own = sorted(s for g, _, s, _ in rows if g == "a")
        assert ranks == {s: own.index(s) + (own.count(s) + 1) / 2 for s in own}


def test_numbers_over_all_rows(spark):
    from sourceweave.shared import numbered

    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit("x").alias("v")).repartition(7)
    assert all(r.k == r.at for r in numbered(rows, ["k"], "at").collect())
    assert numbered(rows.limit(0), ["k"], "at").count() == 0
    claims_ = claims.number_claims(spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "verdict string, i int"), ["verdict", "i"])
    assert sorted((r.claim_id, r.verdict, r.i) for r in claims_.collect()) == [("C001", "a", 1), ("C002", "a", 2), ("C003", "b", 1)]


def test_empty_clusters_are_neutral(spark):
    rows = spark.createDataFrame([(i, 0, [1.0, float(i)], f"s{i}") for i in range(4)], "id int, label int, v array<double>, source string")
    scored = clusters.score_clusters(rows, "label", "v", "source", "id")
    found = {r.label: r for r in clusters.with_empty_clusters(scored, spark.createDataFrame([(0,), (7,)], "label int"), "label").collect()}
    assert (found[7].n, found[7].final_score, found[7].semantic_score, found[7].coherence_factor, found[7].source_factor, found[7].flagged) == (0, 50, 50.0, 0.85, 1.0, True)
    assert found[0].n == 4 and found[0].n_sources == 4


def test_unseen_with_a_key_of_half_of_all_rows(spark):
    rows = [(i, "same" if i % 2 else f"u{i}", f"t{i}") for i in range(3000)]
    schema = "ord bigint, url string, title string"
    found = dedup.unseen(spark.createDataFrame(rows, schema), spark.createDataFrame([(0, "u4", "x")], schema), ("url", "title"), "ord")
    assert sorted(r.ord for r in found.collect()) == [i for i in range(3000) if i % 2 == 0 and i != 4 or i == 1]


@pytest.mark.parametrize("draws", ["counts", "rows"])
def test_groups_are_resampled_at_once(spark, draws):
    rng = random.Random(6)
    rows = [(m, i, rng.random(), i % 2) for m in ("a", "b") for i in range(20)] + [("one", i, 1.0, 1) for i in range(6)]
    table = spark.createDataFrame(rows, "method string, i int, score double, label int")
    found = {r.method: r for r in resampling.resampled(table, "method", "i", 60, draws=draws).collect()}
    for m in ("a", "b"):
        alone = table.where(F.col("method") == m)
        low, p = resampling.bootstrap_interval(alone, "i", 60, draws=draws).first(), resampling.permutation_test(alone, "i", 60, draws=draws).first()
        assert (found[m].auc_lo, found[m].auc_hi, found[m].auc_p) == (low.auc_lo, low.auc_hi, p.auc_p)
    assert (found["one"].auc_lo, found["one"].auc_p) == (None, None)
    plain = random.Random(3)
    assert resampling.bootstrap_draws(23, 40, 3).tolist() == [[plain.randrange(23) for _ in range(23)] for _ in range(40)]


def test_all_rivals(spark):
    profiles = spark.createDataFrame([("a", True, True, False, False, True, False, True, False)], "domain string, reachable boolean, about boolean, corrections boolean, staff boolean, contact boolean, has_bylines boolean, labels_ads boolean, labels_opinion boolean")
    found = {(r.claim_id, r.method): r.score for r in rivals.all_methods(bundles(spark), profiles).collect()}
    methods = {"corroboration", "source_count", "semantic_only", "claim_substantiation", "evidence_verdict", "reputation", "sensational_lexicon", "tfidf_overlap"}
    assert set(found) == {(c, m) for c in "AB" for m in methods}
    assert found["A", "reputation"] == (22 + 18 + 10 + 7.5 + 7.5 + 5) / 2 and found["B", "sensational_lexicon"] == 0 == found["B", "tfidf_overlap"]


@pytest.mark.parametrize("seed", range(4))
def test_rows_are_settled_as_pairs_are(seed, monkeypatch):
    """Clumps of copies among near rows of all lengths, in chunks of all sizes: the rows that are left are those of the sequential rule."""
    rng = np.random.default_rng(seed)
    for turn in range(60):
        monkeypatch.setattr(dedup, "CHUNK", turn % 7 + 1)
        base = rng.normal(size=(6, 3))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        kinds = [(int(rng.integers(0, 6)), int(rng.integers(0, 4))) for _ in range(7)]
        of = rng.integers(0, 7, rng.integers(2, 40))
        length = np.array([n for _, n in kinds])
        unit = base[[v for v, _ in kinds]]
        pairs = [(i, j) for i in range(len(of)) for j in range(i + 1, len(of)) if unit[of[i]] @ unit[of[j]] > 0.3]
        want = set(range(len(of))) - dedup.greedy_drops(pairs, {i: int(length[c]) for i, c in enumerate(of)})
        assert set(dedup.online_survivors(np.arange(len(of)) * 3, of, unit, length, 0.3)) == {3 * i for i in want}


def test_semantic_first_is_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 3))
    picks = [(int(rng.integers(0, 25)), int(rng.integers(0, 3))) for _ in range(80)] + [(0, 1)] * 40
    rows = spark.createDataFrame([(i, base[b].tolist() if b else [1.0, 2.0, 2.0], "x" * n) for i, (b, n) in enumerate(picks)] + [(500, [0.0] * 3, "x"), (501, [0.0] * 3, "x"), (502, None, "y")], "id bigint, v array<double>, text string")
    plain = rows.where("id < 500")
    want = {r.id for r in dedup.semantic_dedup(plain, "id", "text", dedup.cosine_edges(plain, "id", "v", 0.8)).collect()} | {500, 501, 502}
    for share, block in ((2048, 4096), (10, 7), (3, 2)):
        assert {r.id for r in dedup.semantic_first(rows, "id", "text", "v", 0.8, share, block).collect()} == want
    assert dedup.semantic_first(rows.limit(0), "id", "text", "v", 0.8).count() == 0


def test_copies_are_compared_once(spark):
    """A third of all rows alike: as many pairs as between different vectors, none between copies."""
    rows = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.col("id").cast("double"))).alias("v"), F.lit("same").alias("text"))
    assert sorted(r.id for r in dedup.semantic_first(rows, "id", "text", "v", 0.99).collect()) == [0, 1]


def test_the_greedy_rule_needs_no_join_of_all_vectors(spark, monkeypatch):
    """Rounds hold rows against those left: rows of earlier rounds go for later ones, and a round with too many near pairs is halved."""
    monkeypatch.setattr(pivots, "linked", None)
    rng = np.random.default_rng(8)
    kinds = rng.normal(size=(40, 3))
    rows = spark.createDataFrame([(int(3 * i), (kinds[rng.integers(0, 40)] + rng.normal(size=3) * 0.05).tolist(), "x" * int(rng.integers(0, 9))) for i in rng.permutation(150)], "id bigint, v array<double>, text string")
    want = {r.id for r in dedup.semantic_dedup(rows, "id", "text", dedup.cosine_edges(rows, "id", "v", 0.9)).collect()}
    assert {r.id for r in dedup.semantic_first(rows, "id", "text", "v", 0.9, 8, 3).collect()} == want
    sized = rows.select("id", "v", F.length("text").alias("n"))
    assert {r.id for r in dedup.greedy_left(sized, 0.9, 8, 4, most_hits=40).collect()} == want
    assert spark.conf.get(pivots.CLEAN_UP) == "false"


@pytest.mark.parametrize("seed", range(3))
def test_rounds_settle_as_one_does(seed):
    """Rows in rounds of random sizes, in memory: what is left is what the rule leaves of all at once."""
    rng = np.random.default_rng(seed)
    for _ in range(40):
        n, left = int(rng.integers(5, 60)), pd.DataFrame({"id": [], "n": [], "v": []})
        v = rng.normal(size=(n, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows = pd.DataFrame({"id": np.arange(n) * 2, "n": rng.integers(0, 4, n).astype(np.int32), "v": [x.tobytes() for x in v]})
        pairs = [(2 * i, 2 * j) for i in range(n) for j in range(i + 1, n) if v[i] @ v[j] > 0.5]
        want = set(rows["id"]) - dedup.greedy_drops(pairs, dict(zip(rows["id"], rows["n"])))
        cuts = [0, *np.sort(rng.integers(0, n, 3)), n]
        for part in (rows.iloc[a:b] for a, b in zip(cuts, cuts[1:])):
            told = dedup._settle(part, dedup._near(part, left, 0.5, 10**6), 0.5)
            stay, go = set(told["id"][told["stays"]]), set(told["id"][~told["stays"]])
            assert stay <= set(part["id"]) and go <= set(left["id"])
            left = pd.concat([left[~left["id"].isin(go)], part[part["id"].isin(stay)]]) if len(left) else part[part["id"].isin(stay)]
        assert set(left["id"]) == want


def test_single_precision_decides_nothing():
    """Cosines a hair above and below the threshold, which single precision can't tell apart."""
    edge = 0.85 + np.array([-1e-9, -1e-12, 1e-12, 1e-9])
    frame = lambda m: pd.DataFrame({"id": range(len(m)), "n": np.ones(len(m), np.int32), "v": [np.array(x).tobytes() for x in m]})
    found = dedup._near(frame(np.stack([edge, np.sqrt(1 - edge**2)], axis=1)), frame([[1.0, 0.0]]), 0.85, 10)
    assert found["id"].tolist() == [2, 3]


def test_vectors_that_are_not_finite_are_near_nothing(spark):
    """Copies with NaN or infinity were taken for copies of one class before, and all but the first went."""
    rows = spark.createDataFrame([(0, [float("nan"), 1.0], "a"), (1, [float("nan"), 1.0], "a"), (2, [float("inf"), 1.0], "a"), (3, [float("inf"), 1.0], "a"), (4, [1.0, 1.0], "a"), (5, [1.0, 1.0], "a")], "id bigint, v array<double>, text string")
    assert sorted(r.id for r in dedup.semantic_first(rows, "id", "text", "v", 0.9).collect()) == [0, 1, 2, 3, 4]


def test_draws_by_rows_are_held_one_at_a_time():
    """2,000 draws of 20,000 rows: all at once they were 0.3 GB and more; values are those of all draws at once."""
    rng = np.random.default_rng(1)
    scores, labels = rng.integers(5, 99, 20_000).astype(float), rng.integers(0, 2, 20_000)
    tracemalloc.start()
    booted = resampling._rated(scores, labels, 2000, 7, "bootstrap")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and len(booted) == 2000
    every = resampling.bootstrap_draws(20_000, 50, 7)
    assert booted["value"].tolist()[:50] == [resampling.auc(scores[d], labels[d]) for d in every]
    few = resampling._rated(scores[:50], labels[:50], 20, 7, "permutation")
    seen = abs(resampling.auc(scores[:50], labels[:50]) - 0.5)
    assert few["value"].tolist() == [float(abs(resampling.auc(scores[:50], np.array(d)) - 0.5) >= seen) for d in resampling.permutation_draws(labels[:50].tolist(), 20, 7)]
