from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceweave.plans import events
from sourceweave.streaming import model, update, windows


def rows(spark, low, high, spread=0.05, far=0.0):
    rng = np.random.default_rng(low)
    out = []
    for i in range(low, high):
        centre = np.eye(4)[i % 4] + far * np.array([1, -1, 1, -1])
        out.append((i, f"u{i}", f"t{i}", f"word{i % 4} common", (centre + spread * rng.normal(size=4)).tolist()))
    return spark.createDataFrame(out, "ord bigint, url string, title string, text string, embedding array<double>")


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_optimal(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 5), rng.randint(1, 5)
    s = [[rng.random() for _ in range(m)] for _ in range(n)]
    best = max(sum(s[i][j] for i, j in zip(ii, jj)) for ii in itertools.combinations(range(n), min(n, m)) for jj in itertools.permutations(range(m), min(n, m)))
    found = model.best_assignment(s)
    assert sum(s[i][j] for i, j in found) == pytest.approx(best) and len(found) == min(n, m)


def test_adaptive_k():
    assert [model.adaptive_k(n) for n in (0, 1, 9, 10, 30, 60, 600)] == [1, 1, 9, 4, 5, 10, 10]


def test_partial_update_and_state(spark, tmp_path):
    start = model.cold_start(rows(spark, 0, 40), "embedding", "text", k=4)
    assert start.k == 4 and start.version == 1 and 0 < start.baseline < 0.2
    labelled = model.assign(start, rows(spark, 0, 40), "embedding")
    assert labelled.groupBy((F.col("ord") % 4).alias("g")).agg(F.count_distinct("topic").alias("n")).where("n <> 1").count() == 0
    updated, out = model.partial_update(start, rows(spark, 40, 60), "embedding", "text", "ord")
    assert out.count() == 20 and updated.version == 2 and len(updated.recent) == 20
    assert updated.counts.agg(F.sum("tf")).first()[0] == start.counts.agg(F.sum("tf")).first()[0] * 60 / 40
    assert sum(updated.weights) == 60
    model.save(updated, f"file://{tmp_path}/m")
    again = model.load(spark, f"file://{tmp_path}/m")
    assert (again.version, again.alias, again.recent, again.k) == (2, updated.alias, updated.recent, 4)
    assert model.load(spark, f"file://{tmp_path}/none") is None
    same, nothing = model.partial_update(updated, rows(spark, 0, 1).limit(0), "embedding", "text", "ord")
    assert same is updated and nothing.count() == 0
    assert model.topic_names(updated).count() == 4


def test_drift_and_alignment(spark):
    start = model.cold_start(rows(spark, 0, 40), "embedding", "text", k=4)
    assert not model.drift(start)[2]
    calm, _ = model.partial_update(start, rows(spark, 40, 80), "embedding", "text", "ord")
    assert not model.drift(calm)[2]
    moved, _ = model.partial_update(start, rows(spark, 80, 120, spread=0.9), "embedding", "text", "ord")
    assert model.drift(moved)[2]
    again = model.aligned(model.cold_start(rows(spark, 0, 80), "embedding", "text", k=4, seed=9), start)
    before = {r.ord: r.topic for r in model.assign(start, rows(spark, 0, 40), "embedding").collect()}
    after = {r.ord: r.topic for r in model.assign(again, rows(spark, 0, 40), "embedding").collect()}
    assert before == after


def test_batches_give_what_one_gives(spark, tmp_path):
    whole = rows(spark, 0, 90).withColumn("url", F.concat(F.lit("u"), F.col("ord") % 80))
    folder = f"file://{tmp_path}/in"
    whole.repartitionByRange(3, "ord").write.parquet(folder)
    updater = update.Updater(f"file://{tmp_path}/state")
    updater.run(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(folder), f"{tmp_path}/checkpoint")
    corpus = updater.corpus(spark)
    assert corpus.count() == 80 and corpus.select("url").distinct().count() == 80
    counted = updater.model(spark).counts.agg(F.sum("tf")).first()[0]
    assert counted == 80 * 3  # two words and a pair each
    version = updater.model(spark).version
    updater.fold(whole, 0)  # a batch that is run again changes nothing
    updater.fold(whole.limit(5), 99)  # nor does one without anything new
    assert updater.corpus(spark).count() == 80 and updater.model(spark).version == version


def test_windows(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 05:00:00", 2.0), (1, "2024-01-02 00:00:00", 3.0)], "u int, t string, value double").withColumn("ts", F.to_timestamp_ntz("t"))
    assert sorted((r.n, r.total) for r in windows.tumbling_counts(events, "ts", "u").collect()) == [(1, 3.0), (2, 3.0)]
    assert sorted(r.n for r in windows.session_counts(events, "ts", "u").collect()) == [1, 2]


def test_query_folds_the_whole_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = [(i, i % 4, (np.eye(4)[i % 4] + 0.05 * rng.normal(size=4)).tolist()) for i in range(2400)]
    spark.createDataFrame(vectors, "vec_id bigint, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    urls, titles, kept = set(), set(), 0
    for r in sorted(events.vector_rows(spark, str(tmp_path)).collect(), key=lambda r: r.ord):
        if r.url not in urls and r.title not in titles:
            urls.add(r.url)
            titles.add(r.title)
            kept += 1
    assert kept == 2160
    assert events.stream_update(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == kept


def test_a_damaged_state_is_none(spark, tmp_path):
    start = model.cold_start(rows(spark, 0, 40), "embedding", "text", k=4)
    path = f"file://{tmp_path}/state"
    model.save(start, path)
    assert model.load(spark, path).k == 4
    for part in (tmp_path / "state" / "meta").glob("*.parquet"):
        part.write_bytes(b"no table")
    for crc in (tmp_path / "state" / "meta").glob(".*.crc"):
        crc.unlink()
    assert model.load(spark, path) is None and model.load(spark, f"file://{tmp_path}/nowhere") is None


def test_assignment_of_many_topics():
    rng = random.Random(1)
    order = list(range(60))
    rng.shuffle(order)
    s = [[rng.random() / 2 + (order[i] == j) for j in range(60)] for i in range(60)]
    assert model.best_assignment(s) == list(enumerate(order))
