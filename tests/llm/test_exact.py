from __future__ import annotations

import hashlib
import re

from sourceweave.llm import exact
from tests.llm.conftest import documents


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_decisions(spark, edge_rows):
    found = exact.decisions(documents(spark, edge_rows)).collect()
    assert len(found) == len(edge_rows)
    groups = {}
    for doc, text in edge_rows:
        groups.setdefault(hashlib.sha256(plain(text).encode()).digest(), []).append(doc)
    kept = {}
    for r in found:
        own = groups[bytes(r.digest)]
        known = [d for d in own if d is not None]
        assert r.group_size == len(own) and r.keep_id == (min(known) if known else None)
        kept.setdefault(bytes(r.digest), []).extend([r.doc_id] if r.kept else [])
    assert {k: v for k, v in kept.items()} == {k: [min((d for d in own if d is not None), default=None)] for k, own in groups.items()}


def test_a_group_of_half_of_all_rows(spark):
    rows = [(i, "same  text" if i % 2 else f"text {i}") for i in range(2000)]
    found = exact.decisions(documents(spark, rows).repartition(7))
    hot = found.where("group_size > 1").agg({"keep_id": "max", "group_size": "min", "kept": "count"}).first()
    assert sorted(hot) == [1, 1000, 1000]
    assert found.where("kept").count() == 1001


def test_keep_first(spark, edge_rows):
    kept = exact.keep_first(documents(spark, edge_rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 1, 3, 4, -5, 8, 9, 10, 12], key=str)
    assert exact.keep_first(documents(spark, [])).count() == 0 and exact.decisions(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark, edge_rows):
    plan = exact.decisions(documents(spark, edge_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rounds_keep_runs_in_order(spark):
    """Every round's cells ascend without a repeat, in ranges that do not overlap, and hold each digest's count and least identifier."""
    rows = [((7 * i) % 900 or None, f"text {i % 250}" if i % 3 else "hot") for i in range(900)]
    made = exact.digests(documents(spark, rows).repartition(5))
    runs, left = exact.sorted_runs(made, 3), exact.RUNS
    want = {}
    for doc, text in rows:
        want.setdefault(hashlib.sha256(text.encode()).digest(), []).append(doc)
    while True:
        ends = {}
        cells = runs.orderBy("run", "slot").collect()
        for r in cells:
            keys = [bytes(e.digest) for e in r.cell]
            assert keys == sorted(set(keys)) and r.run < left
            assert ends.get(r.run, b"") < keys[0]
            ends[r.run] = keys[-1]
        assert sum(e.n for r in cells for e in r.cell) == len(rows)
        if left == 1:
            break
        runs, left = exact.merge_runs(runs), left // exact.FAN_IN
    assert {bytes(e.digest): (e.n, e.least.doc_id) for r in cells for e in r.cell} == {k: (len(v), min((d for d in v if d is not None), default=None)) for k, v in want.items()}


def test_a_round_sorts_no_rows(spark, edge_rows):
    """Runs are arrays that stay in order: a round is an exchange of cells and a merge of arrays, without a sort of rows or a regrouping by digest."""
    runs = exact.materialise(exact.sorted_runs(exact.digests(documents(spark, edge_rows)), 2), "test-runs")
    plan = exact.merge_runs(exact.merge_runs(runs))._jdf.queryExecution()
    assert "Sort [" not in plan.optimizedPlan().toString() and "Sort [" not in plan.executedPlan().toString() and "SortAggregate" not in plan.executedPlan().toString()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning(run") == 2


def test_the_merge_relies_on_the_order(spark):
    """Neighbours are compared, not grouped: equal digests of different runs meet because the runs ascend."""
    entry = lambda d, doc, n: (bytes([d]), 0, 1, (False, doc, doc), n)
    kind = "run int, slot int, cell array<struct<digest: binary, check: bigint, n_bytes: bigint, least: struct<absent: boolean, doc_id: bigint, row: bigint>, n: bigint>>"
    runs = spark.createDataFrame([(0, 0, [entry(1, 9, 1), entry(3, 2, 2)]), (1, 0, [entry(1, 4, 3), entry(2, 5, 1)]), (2, 0, [entry(1, 7, 1)]), (3, 0, [entry(3, 1, 1)])], kind)
    cell = exact.merge_runs(runs).first().cell
    assert [(e.digest[0], e.least.doc_id, e.n) for e in cell] == [(1, 4, 5), (2, 5, 1), (3, 1, 3)]


def test_ties_of_other_columns(spark):
    """Rows equal in doc_id and text: the one whose other columns are least as JSON stays, however the rows lie."""
    rows = [(1, "same", lang) for lang in ("fr", "de", "en", None)] * 3 + [(2, "same", "aa")]
    for parts in (1, 5):
        kept = exact.keep_first(documents(spark, rows).repartition(parts)).collect()
        assert [(r.doc_id, r.lang) for r in kept] == [(1, "de")]
