from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sourceweave.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, whitened string, x string, z0 string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "w", "x", "z") for i, v in rows], SCHEMA)


def plain(rows):
    """x-vectors, exact deviations, covariance, eigenvalues falling and eigenvectors by rows."""
    v = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e] for _, e in rows]
    n, d = len(v), len(v[0])
    sums = [sum(r[i] for r in v) for i in range(d)]
    away = [[n * r[i] - sums[i] for i in range(d)] for r in v]
    cov = np.array([[sum(a[i] * a[j] for a in away) / n**3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    return np.array(away, dtype=float) / n, [sum(x * x for x in a) for a in away], cov, values[::-1], vectors[:, ::-1]


def check(spark, rows, fit=None):
    out = whitening.whiten(table(spark, rows)).collect()
    fit = rows if fit is None else fit
    y, deviation, cov, values, vectors = plain(fit)
    most = min(32, len(values))
    assert len(out) == len(fit) * most and {r.n for r in out} == {len(fit)}
    got = {(r.vec_id, r.component): r for r in out}
    signs = {}
    for at, (i, _) in enumerate(fit):
        for k in range(most):
            r = got[i, k + 1]
            assert r.deviation == deviation[at]
            assert r.explained == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
            want = y[at] @ vectors[:, k] / math.sqrt(values[k])
            if abs(want) > 1e-6:
                sign = signs.setdefault(k, math.copysign(1, want * r.whitened))
                assert r.whitened * sign == pytest.approx(want, rel=1e-6, abs=1e-8)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    return out


def vectors(rng, n, d):
    return [(i, [rng.gauss(0, 1 + k) for k in range(d)]) for i in range(n)]


def test_against_plain(spark):
    check(spark, vectors(random.Random(1), 90, 5))
    check(spark, vectors(random.Random(2), 120, 40))


def test_rows_that_go(spark):
    rows = vectors(random.Random(3), 30, 3)
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    check(spark, rows + bad, rows)
    assert whitening.whiten(table(spark, bad[:5])).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0


def test_repeats_and_null_identifiers(spark):
    rows = vectors(random.Random(4), 20, 2)
    out = whitening.whiten(table(spark, rows + rows[:5] + [(None, rows[0][1])])).collect()
    assert len(out) == 26 * 2 and {r.n for r in out} == {26} and sum(r.vec_id is None for r in out) == 2


def test_rank(spark):
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]
    out = whitening.whiten(table(spark, flat)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in out) and out[0].identity_error < 1e-9
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    one = whitening.whiten(table(spark, [(1, [0.5])])).collect()
    assert [(r.component, r.n, r.deviation) for r in one] == [(1, 1, 0)]


def test_large_entries_and_several_aggregations(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(whitening, "PAIRS", 4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0**e for e in (8, 7, 9)]) for i in range(50)]
    out = whitening.whiten(table(spark, rows)).collect()
    y, deviation, _, values, _ = plain(rows)
    want = {i: (d if d < 2**63 else None) for (i, _), d in zip(rows, deviation)}
    assert all(r.deviation == want[r.vec_id] for r in out) and out[0].identity_error < 1e-6


def test_query(spark):
    from sourceweave.llm import queries

    out = queries.op11_whitening(spark, "/root/testdata/sf0.001")
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    y, deviation, cov, values, components = plain(rows)
    got = out.toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = y @ components[:, :32] / np.sqrt(values[:32])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
