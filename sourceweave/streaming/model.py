"""An online topic model: centroids, frozen vocabulary, term counts, drift, and ids that outlive a refit.

The state is a handful of small tables (k centroids, k times vocabulary counts), written as Parquet by version. A batch is
worked on where it lies: only sums by centroid reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.functions import vectors
from sourceweave.operators import clusters, topics

# The window and the ratio of the drift rule, and the least number of distances.
DRIFT_WINDOW, DRIFT_RATIO, DRIFT_LEAST = 200, 1.5, 20


@dataclass(frozen=True)
class TopicModel:
    """State of the model. counts: (topic, term, tf), topics by raw number; alias: raw to public number."""

    centroids: list[list[float]]
    weights: list[float]
    counts: DataFrame
    stop: tuple[str, ...] = ()
    alias: dict[int, int] = field(default_factory=dict)
    baseline: float = 0.0
    recent: list[float] = field(default_factory=list)
    version: int = 1

    @property
    def k(self) -> int:
        return len(self.centroids)


def adaptive_k(n: int) -> int:
    """Topics for ``n`` documents: one in six of them, from 4 to 10; below ten documents, as many."""
    return max(4, min(10, n // 6)) if n >= 10 else max(1, n)


def _located(docs: DataFrame, centroids: list[list[float]], vector: str) -> DataFrame:
    """``docs`` with unit vector, raw topic and distance."""
    spark = docs.sparkSession
    centres = spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "topic int, centroid array<double>")
    found = clusters.nearest_centroid(docs.withColumn("_unit", vectors.unit(F.col(vector))), "_unit", centres, "topic")
    return found.withColumnRenamed("nearest", "raw")


def _moved(docs: DataFrame, centroids: list[list[float]], weights: list[float], vector: str) -> tuple[list[list[float]], list[float]]:
    """Centroids and weights after a batch: each is the mean of all rows it has taken. k rows reach the driver."""
    located = _located(docs, centroids, vector)
    sums = clusters.vector_sums(located, ["raw"], {"vsum": F.col("_unit")}, F.count(F.lit(1)).alias("n")).collect()
    centroids, weights = [list(c) for c in centroids], list(weights)
    for r in sums:
        total = weights[r.raw] + r.n
        centroids[r.raw] = [(c * weights[r.raw] + s) / total for c, s in zip(centroids[r.raw], r.vsum)]
        weights[r.raw] = total
    return centroids, weights


def cold_start(docs: DataFrame, vector: str, text: str, k: int | None = None, stop: tuple[str, ...] = (), seed: int = 42) -> TopicModel:
    """A model of ``docs``: full k-means on unit vectors, one online step, vocabulary and baseline distance."""
    k = k or adaptive_k(docs.count())
    ready = docs.select(array_to_vector(vectors.unit(F.col(vector))).alias("features"))
    fitted = KMeans(k=k, seed=seed, maxIter=50).fit(ready)
    centroids = [c.tolist() for c in fitted.clusterCenters()]
    centroids, weights = _moved(docs, centroids, [0.0] * len(centroids), vector)
    located = _located(docs, centroids, vector)
    counts = topics.term_counts(located.select(F.col("raw").alias("topic"), text), "topic", text, stop)
    baseline = located.agg(F.avg("distance")).first()[0]
    return TopicModel(centroids, weights, counts, stop, {i: i for i in range(len(centroids))}, float(baseline or 0.0), [], 1)


def partial_update(model: TopicModel, batch: DataFrame, vector: str, text: str, order: str) -> tuple[TopicModel, DataFrame]:
    """The model after a batch, and the batch with its public topic. Terms beyond the vocabulary are left out.

    The batch is labelled against the moved centroids; the distances of the last DRIFT_WINDOW rows by ``order`` stay.
    """
    if batch.isEmpty():
        return model, batch.withColumn("topic", F.lit(None).cast("int"))
    centroids, weights = _moved(batch, model.centroids, model.weights, vector)
    located = _located(batch, centroids, vector)
    fresh = topics.term_counts(located.select(F.col("raw").alias("topic"), text), "topic", text, model.stop)
    fresh = fresh.join(model.counts.select("term").distinct(), "term", "left_semi")
    counts = model.counts.unionByName(fresh).groupBy("topic", "term").agg(F.sum("tf").alias("tf"))
    last = [r.distance for r in located.orderBy(F.col(order).desc()).limit(DRIFT_WINDOW).select("distance").collect()][::-1]
    updated = replace(model, centroids=centroids, weights=weights, counts=counts, recent=[*model.recent, *last][-DRIFT_WINDOW:], version=model.version + 1)
    return updated, with_public_topic(located, model.alias).drop("_unit", "distance", "raw")


def with_public_topic(located: DataFrame, alias: dict[int, int]) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    return located.withColumn("topic", F.coalesce(F.try_element_at(pairs, F.col("raw")), F.col("raw")).cast("int"))


def assign(model: TopicModel, docs: DataFrame, vector: str) -> DataFrame:
    """``docs`` with their public topic."""
    return with_public_topic(_located(docs, model.centroids, vector), model.alias).drop("_unit", "distance", "raw")


def drift(model: TopicModel) -> tuple[float | None, float, bool]:
    """Mean recent distance, baseline, and whether the former is half as large again on enough rows."""
    if not model.recent:
        return None, model.baseline, False
    mean = sum(model.recent) / len(model.recent)
    return mean, model.baseline, len(model.recent) >= DRIFT_LEAST and mean > DRIFT_RATIO * model.baseline


def best_assignment(similarity: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total similarity, each row and column once: exact, in cubic time.

    Row after row is taken in along the cheapest augmenting path; prices of rows and columns keep all costs at zero or more.
    """
    rows, columns = len(similarity), len(similarity[0]) if similarity else 0
    if rows > columns:
        turned = best_assignment([[similarity[i][j] for i in range(rows)] for j in range(columns)])
        return sorted((i, j) for j, i in turned)
    cost = -np.array(similarity, dtype=float).reshape(rows, columns)
    of_row, of_column, owner = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for start in range(rows):
        reach, came, closed = cost[start] - of_row[start] - of_column, np.full(columns, -1), np.zeros(columns, dtype=bool)
        while True:
            last = int(np.argmin(np.where(closed, np.inf, reach)))
            closed[last] = True
            if owner[last] < 0:
                break
            onward = reach[last] + cost[owner[last]] - of_row[owner[last]] - of_column
            nearer = ~closed & (onward < reach)
            reach[nearer], came[nearer] = onward[nearer], last
        seen = np.flatnonzero(closed)
        slack = reach[last] - reach[seen]
        of_column[seen] -= slack
        of_row[start] += reach[last]
        held = owner[seen] >= 0
        of_row[owner[seen][held]] += slack[held]
        while came[last] >= 0:
            owner[last], last = owner[came[last]], int(came[last])
        owner[last] = start
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0)


def _cosine(a: list[float], b: list[float]) -> float:
    length = math.hypot(*a) * math.hypot(*b)
    return sum(x * y for x, y in zip(a, b)) / length if length else 0.0


def aligned(fresh: TopicModel, before: TopicModel) -> TopicModel:
    """``fresh`` with the public numbers of the topics of ``before`` that its own are nearest to; the rest fill the gaps."""
    matched = best_assignment([[_cosine(a, b) for b in before.centroids] for a in fresh.centroids])
    wanted = {i: before.alias.get(j, j) for i, j in matched}
    taken = {i: p for i, p in wanted.items() if p < fresh.k}
    free = iter(p for p in range(fresh.k) if p not in set(taken.values()))
    return replace(fresh, alias={i: taken[i] if i in taken else next(free) for i in range(fresh.k)})


def topic_names(model: TopicModel, n: int = 4) -> DataFrame:
    """(topic, label) by public number, from the counts gathered so far."""
    weighed = topics.class_tfidf(model.counts, "topic", model.k)
    named = with_public_topic(topics.top_terms(weighed, "topic", max(3 * n, topics.CANDIDATES)).withColumnRenamed("topic", "raw"), model.alias).drop("raw")
    return topics.labels(named, "topic", n, (*topics.stop_words(), *model.stop))


def save(model: TopicModel, path: str) -> None:
    """Write the state to ``path``; its meta comes last, so a state is whole once that has its success mark."""
    spark = model.counts.sparkSession
    model.counts.write.mode("overwrite").parquet(f"{path}/counts")
    meta = [(model.centroids, model.weights, list(model.stop), {int(a): int(b) for a, b in model.alias.items()}, float(model.baseline), [float(x) for x in model.recent], model.version)]
    schema = "centroids array<array<double>>, weights array<double>, stop array<string>, alias map<int,int>, baseline double, recent array<double>, version int"
    spark.createDataFrame(meta, schema).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> TopicModel | None:
    """The state at ``path``, None if there is no whole one or it can't be read: the caller then starts anew."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return None
    try:
        m, counts = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/counts")
    except (PySparkException, Py4JJavaError):
        return None
    if m is None or set(counts.columns) != {"topic", "term", "tf"}:
        return None
    return TopicModel([list(c) for c in m.centroids], list(m.weights), counts, tuple(m.stop), dict(m.alias), m.baseline, list(m.recent), m.version)


def drift_of(distances: DataFrame, order: str, baseline: float) -> DataFrame:
    """One row (n, mean_recent, drifting) for a table of distances: the last DRIFT_WINDOW by ``order``."""
    last = distances.orderBy(F.col(order).desc()).limit(DRIFT_WINDOW)
    mean = F.avg("distance")
    return last.agg(F.count(F.lit(1)).alias("n"), mean.alias("mean_recent"), F.coalesce((F.count(F.lit(1)) >= DRIFT_LEAST) & (mean > DRIFT_RATIO * baseline), F.lit(False)).alias("drifting"))
