from __future__ import annotations

import json
import random

from sourceweave.plans import evaluation, study
from sourceweave.sources import tables


def bundles(spark, n=24):
    rng, rows = random.Random(2), []
    for i in range(n):
        m = rng.randint(2, 6)
        articles = [{"title": "t", "domain": f"d{rng.randrange(5)}.com", "text": "calm words " * 9, "body_available": rng.random() < 0.7, "url_resolved": True, "stance": rng.choice(["neutral", "debunk"])} for _ in range(m)]
        rows.append({
            "claim_id": f"C{i:03d}", "verdict": "TRUE" if i % 2 else "FALSE", "split": "calibration" if i % 5 < 3 else "evaluation", "summary": "s", "articles": articles, "similarities": [rng.random() for _ in range(m)],
            "pairwise": [[1.0 if a == b else 0.5 for a in range(m)] for b in range(m)], "claims": ["x"], "claim_similarities": [[rng.random() for _ in range(m)]],
        })
    return spark.createDataFrame(rows, tables.BUNDLE)


def test_study(spark):
    found = study.run_study(bundles(spark), samples=50, sensational=True)
    pooled = {r.method: r for r in found.pooled.collect()}
    assert {"corroboration", "source_count", "semantic_only", "claim_substantiation", "evidence_verdict", "sensational_lexicon"} <= set(pooled)
    assert all(r.n == 24 for r in pooled.values()) and pooled["corroboration"].threshold == 75
    assert pooled["source_count"].auc_lo <= pooled["source_count"].roc_auc <= pooled["source_count"].auc_hi
    assert found.held_out.first().n == 9 and found.variants.count() == 20 and found.best.count() == 5
    assert sum(r.n for r in found.balance.collect()) == 24
    told = json.loads(study.summary(found).first().json)
    assert len(told["transfer"]) == 2 and len(told["pooled"]) == len(pooled)


def test_queries_take_2000_draws(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(evaluation, "scored", lambda *_: None)
    monkeypatch.setattr(evaluation.resampling, "bootstrap_interval", lambda df, order, samples=2000, seed=7: asked.append(samples))
    monkeypatch.setattr(evaluation.resampling, "permutation_test", lambda df, order, samples=2000, seed=7: asked.append(samples))
    evaluation.bootstrap_auc(spark, "")
    evaluation.permutation_p(spark, "")
    monkeypatch.setattr(study, "vector_bundles", lambda *_: None)
    monkeypatch.setattr(study, "run_study", lambda rows, samples=2000: asked.append(samples) or type("Study", (), {"pooled": None}))
    study.study_metrics(spark, "")
    assert asked == [2000, 2000, 2000]
