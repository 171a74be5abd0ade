"""Evidence and scores of clusters of vectors, without a pair join.

The mean cosine over all pairs of a cluster follows from the length of the sum of its unit vectors:
(|sum u|^2 - sum |u|^2) / (n (n - 1)). Sums are aggregates, combined before the shuffle, so a cluster of any size costs one
row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.functions import scores, vectors
from sourceweave.functions.scores import DEFAULT, ScoreParams
from sourceweave.shared import stored


#: Centres that a row is held against by an expression.
MOST_CENTRES = 1000
# The score of a cluster without rows, and its parts.
NEUTRAL = {"n": 0, "final_score": 50, "semantic_score": 50.0, "avg_similarity": 0.0, "source_factor": 1.0, "n_sources": 0, "coherence_factor": 0.85, "source_coherence": 0.5}


def dimension(df: DataFrame, vector: str) -> int:
    """Length of the vectors; 0 for an empty table."""
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).take(1)
    return first[0].n if first else 0


def vector_sums(df: DataFrame, keys: list[str], vectors_: dict[str, Column], *others: Column) -> DataFrame:
    """A sum of vectors under each name, next to ``others``, for each key; rows without a vector are left out.

    One buffer a vector and task, whatever the vectors' width, combined before the shuffle.
    """
    ready = df.withColumns({f"_{n}": vectors.doubles(v) for n, v in vectors_.items()}).where(" and ".join(f"_{n} is not null" for n in vectors_))
    ready = ready.withColumns({f"_{n}": array_to_vector(F.col(f"_{n}")) for n in vectors_})
    summed = ready.groupBy(*keys).agg(*others, *[Summarizer.sum(F.col(f"_{n}")).alias(n) for n in vectors_])
    return summed.withColumns({n: vector_to_array(F.col(n)) for n in vectors_})


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid, n): the mean vector of each cluster."""
    summed = vector_sums(df, [key], {"vsum": F.col(vector)}, F.count(F.lit(1)).alias("n"))
    return summed.select(key, F.transform("vsum", lambda x: x / F.col("n")).alias("centroid"), "n")


def similarities(df: DataFrame, key: str, vector: str, summaries: DataFrame | None = None) -> DataFrame:
    """``df`` with ``similarity``: the cosine of each row and its cluster's summary vector.

    summaries: (key, centroid), the cluster means by default, a row a cluster.
    """
    sums = summaries if summaries is not None else centroids(df, key, vector).drop("n")
    return df.join(sums, key).withColumn("similarity", vectors.cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def _coherence(vector: str) -> tuple[Column, Column, Column]:
    """What the mean cosine over pairs takes: the unit vectors, an aggregate of how many aren't zero, and the mean from both."""
    squares = F.sum(F.when(vectors.norm(F.col(vector)) > 0, 1.0).otherwise(0.0)).alias("squares")
    pairs = F.col("n") * (F.col("n") - 1)
    return vectors.unit(F.col(vector)), squares, F.when(pairs > 0, (vectors.dot(F.col("usum"), F.col("usum")) - F.col("squares")) / pairs)


def pairwise_coherence(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, coherence): mean cosine over the pairs of each cluster, null for a single row."""
    unit, squares, mean = _coherence(vector)
    return vector_sums(df, [key], {"usum": unit}, F.count(F.lit(1)).alias("n"), squares).select(key, "n", mean.alias("coherence"))


def top_similar(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The ``k`` rows of each cluster with the largest similarity, ranked; ties go by ``order``."""
    rank = Window.partitionBy(key).orderBy(F.col("similarity").desc(), order)
    return df.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def score_clusters(df: DataFrame, key: str, vector: str, source: str, order: str, params: ScoreParams = DEFAULT, summaries: DataFrame | None = None) -> DataFrame:
    """The corroboration score of each cluster of rows (key, vector, source, order).

    One aggregate gives a cluster's mean vector and its coherence; it is written, a row a cluster, so that the rows meet it as its
    size allows. The top similarities are cut before the shuffle (window group limit); sources are counted from two columns.
    Rows without a vector are left out; '' and null are no source.
    """
    rows = df.where(F.col(vector).isNotNull())
    unit, squares, mean = _coherence(vector)
    sums = vector_sums(rows, [key], {"vsum": F.col(vector), "usum": unit}, F.count(F.lit(1)).alias("n"), squares)
    facts = stored(sums.select(key, "n", mean.alias("coherence"), F.transform("vsum", lambda x: x / F.col("n")).alias("centroid")), "clusters")
    centres = facts.select(key, "centroid") if summaries is None else summaries
    scored = similarities(rows.select(key, order, vector), key, vector, centres)
    kept = top_similar(scored, key, order, params.top_k) if params.top_k else scored
    top = kept.groupBy(key).agg(F.avg("similarity").alias("avg_similarity"))
    named = rows.select(key, F.when(F.col(source) != "", F.col(source)).alias("_source"))
    sources = named.groupBy(key).agg(F.count_distinct("_source").cast("int").alias("n_sources"))
    joined = facts.select(key, "n", "coherence").join(top, key).join(sources, key)
    parts = scores.score_columns(F.col("avg_similarity"), F.col("n_sources"), F.col("coherence"), params.columns())
    return joined.select(key, "n", *[c.alias(name) for name, c in parts.items()])


def with_empty_clusters(scored: DataFrame, expected: DataFrame, key: str, params: ScoreParams = DEFAULT) -> DataFrame:
    """:func:`score_clusters` with a neutral row for each of ``expected`` (key) that has no rows.

    A neutral row has n = 0, so it is told from evidence that came out at 50.
    """
    missing = expected.select(key).distinct().join(scored.select(key), key, "left_anti")
    neutral = NEUTRAL | {"flagged": NEUTRAL["final_score"] < params.flag_threshold}
    empty = missing.select(key, *[F.lit(neutral.get(c)).cast(t).alias(c) for c, t in scored.dtypes if c != key])
    return scored.unionByName(empty)


def nearest_centroid(df: DataFrame, vector: str, centres: DataFrame, key: str) -> DataFrame:
    """``df`` with (nearest, distance): the closest of a few centres (key, centroid), ties to the smallest key.

    The centres travel as one array literal, so rows are not shuffled; their number is that of topics, ten or so, MOST_CENTRES at most.
    """
    found = centres.select(key, "centroid").limit(MOST_CENTRES + 1).collect()
    if len(found) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres: they are sent as a literal")
    rows = sorted(found, key=lambda r: r[0])
    at = F.array(*[F.struct(vectors.distance(F.col(vector), F.array(*map(F.lit, r[1]))).alias("distance"), F.lit(r[0]).alias("nearest")) for r in rows])
    best = F.array_min(at)
    return df.withColumn("_best", best).withColumns({"nearest": F.col("_best.nearest"), "distance": F.col("_best.distance")}).drop("_best")


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(``df`` with topic, (topic, centroid)): k-means on the vectors as they are, distributed over the rows. One topic has all rows."""
    if k == 1:
        whole = df.withColumn("topic", F.lit(0))
        return whole, centroids(whole, "topic", vector).drop("n")
    ready = df.withColumn("_features", array_to_vector(vectors.doubles(F.col(vector))))
    fitted = KMeans(featuresCol="_features", predictionCol="topic", k=k, seed=seed, maxIter=50).fit(ready)
    centres = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted.clusterCenters())], "topic int, centroid array<double>")
    return fitted.transform(ready).drop("_features"), centres


def projection(df: DataFrame, vector: str, dims: int = 2) -> DataFrame:
    """``df`` with ``xy``: the vectors along the first right singular directions of all of them, not centred.

    Each task sums the products of its rows; the sums, one row an entry, are added up over the cluster, and the driver
    decomposes a matrix of the vectors' width. A direction's largest entry is positive.
    """
    size = dimension(df, vector)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            rows = np.array([v for v in batch.column(0).to_pylist() if v is not None], dtype=float).reshape(-1, size)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["g"])

    if not size:
        return df.withColumn("xy", F.array().cast("array<double>"))
    summed = df.select(vector).mapInArrow(products, "g array<double>").select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    gram = np.zeros(size * size)
    for r in summed.collect():  # the square of the width
        gram[r["at"]] = r.x
    _, directions = np.linalg.eigh(gram.reshape(size, size))
    axes = []
    for k in range(1, min(dims, size) + 1):
        axis = directions[:, -k]
        axes.append((axis * np.sign(axis[np.abs(axis).argmax()])).tolist())
    return df.withColumn("xy", F.array(*[vectors.dot(F.col(vector), F.array(*map(F.lit, a))) for a in axes]))


def topic_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """Documents of each of the topics 0 to k - 1, zero where there are none."""
    spark = df.sparkSession
    return spark.range(k).select(F.col("id").cast("int").alias(key)).join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
