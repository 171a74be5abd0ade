from __future__ import annotations

import numpy as np
import pytest

from sourceweave.operators import dedup, pivots


def table(spark, v, weight=1):
    return spark.createDataFrame([(i, x.tolist(), weight) for i, x in enumerate(v)], "id bigint, v array<double>, weight bigint")


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clustered(rng, n, d, centres, spread):
    return rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["clustered", "uniform", "few dimensions"])
@pytest.mark.parametrize("share, block", [(2048, 4096), (40, 4096), (25, 30)])
def test_links_against_all_pairs(spark, kind, share, block):
    rng = np.random.default_rng(1)
    v = {"clustered": clustered(rng, 300, 16, 8, 0.25), "uniform": rng.normal(size=(250, 12)), "few dimensions": rng.normal(size=(250, 3))}[kind]
    threshold = 0.85 if kind != "uniform" else 0.5
    near = unit(v) @ unit(v).T > threshold
    np.fill_diagonal(near, False)
    links, edges = pivots.linked(table(spark, v, 3), threshold, share, block)
    assert {r.id: r.links for r in links.collect()} == {i: 3 * int(n) for i, n in enumerate(near.sum(axis=1)) if n}
    found = [(r.a, r.b) for r in edges.collect()]

    def components(pairs):
        top = list(range(len(v)))
        for _ in v:
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert components(found) == components(np.argwhere(near).tolist())


def test_clusters_are_not_compared_with_each_other(spark):
    """Products of pairs against the dense plan, on vectors in clusters."""
    rng = np.random.default_rng(2)
    v = clustered(rng, 2000, 32, 40, 0.05)
    rows = table(spark, v)
    _, plan = pivots.products(rows, 0.85, share=40)
    planned = sum(r.homes * (r.homes - 1) // 2 + r.homes * r.visitors for r in plan.collect())
    assert planned < 0.2 * len(v) * (len(v) - 1) / 2


def test_parts_of_a_full_cell(spark):
    """All vectors near one pivot: the cell is dealt into parts of the size a task may hold."""
    rng = np.random.default_rng(3)
    v = np.ones((600, 4)) + 0.1 * rng.normal(size=(600, 4))
    dealt, _ = pivots.products(table(spark, v), 0.9, share=10_000, block=50)
    assert max(r["count"] for r in dealt.groupBy("cell", "p", "q", "own").count().collect()) < 2 * 50 * 1.6
    links, edges = pivots.linked(table(spark, v), 0.9, 10_000, 50)
    near = unit(v) @ unit(v).T > 0.9
    assert {r.id: r.links for r in links.collect()} == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1)) if n > 1}
    assert edges.count() < 600 * 13  # a forest a product, and not the pairs


def test_semantic_links(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.1]), (5, [0.0, 1.0]), (6, [0.0, 0.0]), (7, None), (8, [1.0, 0.0])], "id bigint, v array<double>")
    found = {r.id: tuple(r)[1:] for r in dedup.semantic_links(rows, "id", "v", 0.9).collect()}
    assert found == {1: (1, 4, 1), 2: (2, 4, 1), 3: (1, 4, 1), 8: (1, 4, 1), 4: (4, 4, 1), 5: (5, 0, 5), 6: (6, 0, 6), 7: (7, 0, 7)}
    assert dedup.semantic_links(rows.limit(0), "id", "v", 0.9).count() == 0


def test_a_third_of_all_rows_alike(spark):
    """Copies are counted, not compared: one class, and one edge for it."""
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then array(1D, 0D) else array(cast(id as double), 1D + id * id) end as v")
    found = dedup.semantic_links(rows, "id", "v", 0.99999999)
    assert found.where("class_id = 0").agg({"n_links": "min"}).first()[0] == 999 and found.count() == 3000


def test_products_take_turns(spark):
    """Vectors without structure: all turns together deal the rows that one deals, none deals more than its share, and its shuffle goes."""
    rng = np.random.default_rng(4)
    rows = table(spark, rng.normal(size=(1500, 12)))
    deal, _, copies = pivots._dealer(rows, 0.5, 60, 60)
    assert copies > 12
    turns = -(-copies // pivots.COPIES)
    key = ["cell", "p", "q", "own", "side", "id"]
    dealt = [sorted(map(tuple, deal(t, turns).select(*key).collect())) for t in range(turns)]
    assert max(map(len, dealt)) < 2 * pivots.COPIES * 1500
    assert sorted(sum(dealt, [])) == sorted(map(tuple, pivots.products(rows, 0.5, 60, 60)[0].select(*key).collect()))
    assert spark.conf.get(pivots.CLEAN_UP) == "false"
