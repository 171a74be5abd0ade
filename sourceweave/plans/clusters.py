"""Queries over ``embeddings``: a cluster is a label, a source is `src` and vec_id modulo 7, a summary is the mean vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave import shared
from sourceweave.functions import scores, vectors
from sourceweave.functions.scores import DEFAULT
from sourceweave.operators import clusters, dedup, metrics, rivals, sweep
from sourceweave.sources.tables import scan

EDGE_THRESHOLD = 0.3


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").select("vec_id", "label", "embedding", F.concat(F.lit("src"), (F.col("vec_id") % 7).cast("string")).alias("source"))


def corroboration_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: score of every cluster with its parts."""
    found = clusters.score_clusters(_rows(spark, sf_dir), "label", "embedding", "source", "vec_id")
    six = [F.round(c, 6).alias(c) for c in ("semantic_score", "avg_similarity", "source_factor", "coherence_factor", "source_coherence")]
    return found.select("label", "n", "n_sources", "final_score", "flagged", *six, scores.consensus(F.col("n_sources")).alias("consensus"), scores.confidence(F.col("final_score")).alias("confidence"))


_CENTROIDS = """
rows AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, 'src' || (vec_id % 7) AS source FROM embeddings),
centres AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM rows, range(1, 65) t(i) GROUP BY label, i) GROUP BY label),
sims AS (SELECT r.*, list_cosine_similarity(v, c) AS similarity FROM rows r JOIN centres USING (label)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM sims)"""

_COHERENCE = """
coherence AS (SELECT a.label, avg(list_cosine_similarity(a.v, b.v)) AS coherence FROM rows a JOIN rows b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label)"""

SQL_CORROBORATION = f"""
WITH {_CENTROIDS}, {_COHERENCE},
facts AS (SELECT r.label, count(*) AS n, CAST(count(DISTINCT source) AS INTEGER) AS n_sources, avg(similarity) FILTER (rank <= 3) AS top FROM ranked r GROUP BY r.label),
parts AS (
  SELECT label, n, n_sources, top, 30 + 70 * top AS semantic, coalesce(coherence, 0.5) AS coh, 0.7 + 0.3 * coalesce(coherence, 0.5) AS factor,
    CASE WHEN n_sources >= 5 THEN 1.0::DOUBLE WHEN n_sources = 4 THEN 0.95 WHEN n_sources = 3 THEN 0.85 WHEN n_sources = 2 THEN 0.72 ELSE 0.6 END AS ladder
  FROM facts LEFT JOIN coherence USING (label)),
raw AS (SELECT *, CAST(trunc(semantic * ladder * factor) AS INTEGER) AS raw FROM parts)
SELECT label, n, n_sources, least(99, greatest(5, raw)) AS final_score, raw < 75 AS flagged, round(semantic, 6) AS semantic_score, round(top, 6) AS avg_similarity,
  round(ladder, 6) AS source_factor, round(factor, 6) AS coherence_factor, round(coh, 6) AS source_coherence,
  CASE WHEN n_sources >= 5 THEN 'STRONG' WHEN n_sources = 4 THEN 'GOOD' WHEN n_sources = 3 THEN 'MODERATE' WHEN n_sources = 2 THEN 'WEAK' ELSE 'SINGLE-SOURCE' END AS consensus,
  CASE WHEN least(99, greatest(5, raw)) >= 80 THEN 'high' WHEN least(99, greatest(5, raw)) >= 75 THEN 'moderate' WHEN least(99, greatest(5, raw)) > 50 THEN 'low' ELSE 'flagged' END AS confidence
FROM raw
"""


def scores_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every even cluster of twelve that are expected, neutral where there are no rows."""
    rows = _rows(spark, sf_dir).where("label % 2 = 0")
    scored = clusters.score_clusters(rows, "label", "embedding", "source", "vec_id")
    found = clusters.with_empty_clusters(scored, spark.range(12).select(F.col("id").cast("int").alias("label")), "label")
    return found.select("label", "n", "n_sources", "final_score", "flagged", *[F.round(c, 6).alias(c) for c in ("semantic_score", "avg_similarity", "source_factor", "coherence_factor", "source_coherence")])


SQL_EMPTY = f"""
WITH s AS ({SQL_CORROBORATION})
SELECT label, n, n_sources, final_score, flagged, semantic_score, avg_similarity, source_factor, coherence_factor, source_coherence FROM s WHERE label % 2 = 0
UNION ALL SELECT CAST(k AS INTEGER), 0, 0, 50, true, 50.0, 0.0, 1.0, 0.85, 0.5 FROM range(12) r(k) WHERE k % 2 = 1 OR k NOT IN (SELECT label FROM embeddings)
"""


def topk_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three members nearest to each cluster's summary."""
    top = clusters.top_similar(clusters.similarities(_rows(spark, sf_dir), "label", "embedding"), "label", "vec_id", 3)
    return top.select("label", "rank", "vec_id", "source", F.round("similarity", 6).alias("similarity"))


SQL_TOPK = f"WITH {_CENTROIDS} SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, source, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 3"


def pairwise_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean agreement of each cluster's members, with its class."""
    found = clusters.pairwise_coherence(_rows(spark, sf_dir), "label", "embedding")
    return found.select("label", "n", F.round("coherence", 6).alias("coherence"), scores.agreement(F.round("coherence", 6)).alias("agreement"))


SQL_COHERENCE = f"""
WITH {_CENTROIDS}, {_COHERENCE}
SELECT r.label, count(*) AS n, round(any_value(coherence), 6) AS coherence, CASE WHEN any_value(coherence) > 0.85 THEN 'strong' WHEN any_value(coherence) < 0.4 THEN 'weak' ELSE 'neutral' END AS agreement
FROM rows r LEFT JOIN coherence USING (label) GROUP BY r.label
"""


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest cluster mean."""
    rows = _rows(spark, sf_dir)
    found = clusters.nearest_centroid(rows, "embedding", clusters.centroids(rows, "label", "embedding"), "label")
    return found.select("vec_id", "label", "nearest", F.round("distance", 6).alias("distance"))


SQL_NEAREST = f"""
WITH {_CENTROIDS},
far AS (SELECT r.vec_id, r.label, c.label AS nearest, list_distance(v, c) AS distance, row_number() OVER (PARTITION BY r.vec_id ORDER BY list_distance(v, c), c.label) AS k FROM rows r, centres c)
SELECT vec_id, label, nearest, round(distance, 6) AS distance FROM far WHERE k = 1
"""


def rival_cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source count and semantic fidelity of each cluster, from its sources and its largest similarities."""
    scored = clusters.similarities(_rows(spark, sf_dir), "label", "embedding")
    top = clusters.top_similar(scored, "label", "vec_id", DEFAULT.top_k).groupBy("label").agg(F.collect_list("similarity").alias("similarities"))
    sources = scored.select("label", "source").distinct().groupBy("label").agg(F.collect_list(F.struct(F.col("source").alias("domain"))).alias("articles"))
    return sources.join(top, "label").select("label", rivals.source_count(F.col("articles")).alias("source_count"), F.round(rivals.semantic_only(F.col("similarities")), 6).alias("semantic_only"))


SQL_RIVALS = f"WITH {_CENTROIDS} SELECT label, CAST(least(99, 45 + 10 * count(DISTINCT source)) AS DOUBLE) AS source_count, round(30 + 70 * avg(similarity) FILTER (rank <= 3), 6) AS semantic_only FROM ranked GROUP BY label"


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each of twelve topics, empty ones included."""
    return clusters.topic_counts(_rows(spark, sf_dir), "label", 12)


SQL_TOPIC_COUNTS = "SELECT CAST(k AS INTEGER) AS label, count(e.label) AS n FROM range(12) t(k) LEFT JOIN embeddings e ON e.label = t.k GROUP BY k"


def semantic_dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors that are closer than the threshold."""
    found = dedup.cosine_edges(_rows(spark, sf_dir), "vec_id", "embedding", EDGE_THRESHOLD)
    return found.select("i", "j", F.round("similarity", 6).alias("similarity"))


SQL_EDGES = f"""
SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > {EDGE_THRESHOLD}
"""


def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that the greedy rule keeps; a vector's text is its number in words of its length."""
    rows = _rows(spark, sf_dir).withColumn("text", F.repeat(F.lit("x"), (F.col("vec_id") * 7919 % 101).cast("int")))
    return dedup.semantic_first(rows, "vec_id", "text", "embedding", EDGE_THRESHOLD).select("vec_id", "label")


# pair after pair in order: what is gone is gone
SQL_DEDUP = f"""
WITH RECURSIVE e AS MATERIALIZED ({SQL_EDGES}), p AS MATERIALIZED (SELECT i, j, row_number() OVER (ORDER BY i, j) AS nth, i * 7919 % 101 < j * 7919 % 101 AS shorter FROM e),
fold AS (
  SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT p.nth, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone WHEN shorter THEN list_append(gone, i) ELSE list_append(gone, j) END FROM fold f JOIN p ON p.nth = f.nth + 1)
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT unnest(arg_max(gone, nth)) FROM fold)
"""


def semantic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's class of equal vectors, its number of near ones, and its component."""
    found = dedup.semantic_links(_rows(spark, sf_dir), "vec_id", "embedding", EDGE_THRESHOLD)
    return found.select(F.col("id").alias("vec_id"), "class_id", "n_links", "component_id")


SQL_LINKS = f"""
WITH RECURSIVE e AS MATERIALIZED ({SQL_EDGES}), both_ AS (SELECT i AS a, j AS b FROM e UNION ALL SELECT j, i FROM e),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, x.b FROM reach r JOIN both_ x ON x.a = r.b)
SELECT v.vec_id, min(v.vec_id) OVER (PARTITION BY v.embedding) AS class_id, (SELECT count(*) FROM both_ x WHERE x.a = v.vec_id) AS n_links, (SELECT min(b) FROM reach r WHERE r.a = v.vec_id) AS component_id FROM embeddings v
"""


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector in the plane of the two strongest directions."""
    found = clusters.projection(_rows(spark, sf_dir), "embedding")
    return found.select("vec_id", "label", F.round(F.col("xy")[0], 6).alias("x"), F.round(F.col("xy")[1], 6).alias("y"))


def evidence(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """Bundles for the studies: the vectors of a label in groups of ``size``, with similarities, sources and agreement.

    A bundle is true if its number is even; three of five bundles are for calibration.
    """
    rows = _rows(spark, sf_dir).withColumn("bundle", F.expr(f"vec_id div {size}"))
    scored = clusters.similarities(rows, "label", "embedding")
    left, right = rows.select("bundle", "vec_id", "embedding").alias("l"), rows.select("bundle", "vec_id", "embedding").alias("r")
    pairs = left.join(right, (F.col("l.bundle") == F.col("r.bundle")) & (F.col("l.vec_id") < F.col("r.vec_id"))).select(F.col("l.bundle").alias("bundle"), F.col("l.vec_id").alias("i"), F.col("r.vec_id").alias("j"), vectors.cosine(F.col("l.embedding"), F.col("r.embedding")).alias("c"))
    upper = pairs.groupBy("bundle").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "c"))), lambda x: x["c"]).alias("upper"))
    own = scored.groupBy("bundle").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "similarity"))), lambda x: x["similarity"]).alias("similarities"),
        F.collect_set(F.concat(F.lit("src"), (F.col("vec_id") * F.col("vec_id") % 7).cast("string"))).alias("sources"),
    )
    return own.join(upper, "bundle", "left").select("bundle", "similarities", "sources", "upper", (1 - F.col("bundle") % 2).cast("int").alias("label"), F.when(F.col("bundle") % 5 < 3, "calibration").otherwise("evaluation").alias("split"))


_FORMULA = """least(99, greatest(5, CAST(trunc(
    (sb::DOUBLE + CASE k WHEN 1 THEN t1 WHEN 3 THEN t3 WHEN 5 THEN t5 ELSE t0 END * sr::DOUBLE)
    * CASE ladder WHEN 'flat' THEN 1.0::DOUBLE
        WHEN 'mild' THEN CASE WHEN ns >= 5 THEN 1.0 WHEN ns = 4 THEN 0.98 WHEN ns = 3 THEN 0.95 WHEN ns = 2 THEN 0.9 ELSE 0.85 END::DOUBLE
        WHEN 'steep' THEN CASE WHEN ns >= 5 THEN 1.0 WHEN ns = 4 THEN 0.9 WHEN ns = 3 THEN 0.75 WHEN ns = 2 THEN 0.55 ELSE 0.35 END::DOUBLE
        ELSE CASE WHEN ns >= 5 THEN 1.0 WHEN ns = 4 THEN 0.95 WHEN ns = 3 THEN 0.85 WHEN ns = 2 THEN 0.72 ELSE 0.6 END::DOUBLE END
    * (cb::DOUBLE + coh * cr::DOUBLE)) AS INTEGER)))"""
_EVIDENCE = f"""
cent AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label),
rows AS (SELECT vec_id, vec_id // 8 AS bundle, CAST(embedding AS DOUBLE[]) AS v, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s FROM embeddings JOIN cent USING (label)),
up AS (SELECT a.bundle, avg(list_cosine_similarity(a.v, b.v)) AS coh FROM rows a JOIN rows b ON a.bundle = b.bundle AND a.vec_id < b.vec_id GROUP BY a.bundle),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY s DESC) AS k FROM rows),
ev AS (
  SELECT r.bundle, 1 - r.bundle % 2 AS label, avg(s) FILTER (k <= 1) AS t1, avg(s) FILTER (k <= 3) AS t3, avg(s) FILTER (k <= 5) AS t5, avg(s) AS t0,
    count(DISTINCT vec_id * vec_id % 7) AS ns, coalesce(any_value(coh), 0.5) AS coh, CASE WHEN r.bundle % 5 < 3 THEN 'calibration' ELSE 'evaluation' END AS split
  FROM ranked r LEFT JOIN up USING (bundle) GROUP BY r.bundle),
variants(family, nth, variant, sb, sr, k, ladder, cb, cr, thr) AS (VALUES
  ('semantic scale', 0, '0/100', 0, 100, 3, 'current', 0.7, 0.3, 75), ('semantic scale', 1, '20/80', 20, 80, 3, 'current', 0.7, 0.3, 75), ('semantic scale', 2, '30/70', 30, 70, 3, 'current', 0.7, 0.3, 75), ('semantic scale', 3, '50/50', 50, 50, 3, 'current', 0.7, 0.3, 75),
  ('top-k sources', 0, 'top-1', 30, 70, 1, 'current', 0.7, 0.3, 75), ('top-k sources', 1, 'top-3', 30, 70, 3, 'current', 0.7, 0.3, 75), ('top-k sources', 2, 'top-5', 30, 70, 5, 'current', 0.7, 0.3, 75), ('top-k sources', 3, 'top-all', 30, 70, 0, 'current', 0.7, 0.3, 75),
  ('source ladder', 0, 'flat', 30, 70, 3, 'flat', 0.7, 0.3, 75), ('source ladder', 1, 'mild', 30, 70, 3, 'mild', 0.7, 0.3, 75), ('source ladder', 2, 'current', 30, 70, 3, 'current', 0.7, 0.3, 75), ('source ladder', 3, 'steep', 30, 70, 3, 'steep', 0.7, 0.3, 75),
  ('coherence mapping', 0, '0.50/0.50', 30, 70, 3, 'current', 0.5, 0.5, 75), ('coherence mapping', 1, '0.70/0.30', 30, 70, 3, 'current', 0.7, 0.3, 75), ('coherence mapping', 2, '0.90/0.10', 30, 70, 3, 'current', 0.9, 0.1, 75), ('coherence mapping', 3, '1.00/0.00', 30, 70, 3, 'current', 1.0, 0.0, 75),
  ('flag threshold', 0, '60', 30, 70, 3, 'current', 0.7, 0.3, 60), ('flag threshold', 1, '70', 30, 70, 3, 'current', 0.7, 0.3, 70), ('flag threshold', 2, '75', 30, 70, 3, 'current', 0.7, 0.3, 75), ('flag threshold', 3, '85', 30, 70, 3, 'current', 0.7, 0.3, 85)),
scored AS (
  SELECT family, nth, variant, thr, bundle, label, split, {_FORMULA} AS final_score
  FROM ev, variants),
mid AS (SELECT *, rank() OVER (PARTITION BY family, nth ORDER BY final_score) + (count(*) OVER (PARTITION BY family, nth, final_score) - 1) / 2.0 AS mr FROM scored),
rated AS (
  SELECT family, CAST(nth AS INTEGER) AS nth, variant, (sum(mr) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) AS auc,
    CASE WHEN stddev_pop(final_score) > 0 THEN corr(final_score, label) END AS r,
    count(*) FILTER (final_score >= thr AND label = 1) AS tp, count(*) FILTER (final_score >= thr AND label = 0) AS fp, count(*) FILTER (final_score < thr AND label = 1) AS fn, count(*) FILTER (final_score < thr AND label = 0) AS tn
  FROM mid GROUP BY family, nth, variant),
decided AS (SELECT *, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS accuracy FROM rated)"""


def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant of the score's parameters, rated."""
    scored = sweep.score_variants(evidence(spark, sf_dir), sweep.params_table(spark), "bundle", "label")
    rated = sweep.rate_variants(scored)
    return rated.select("family", "nth", "variant", F.round("roc_auc", 6).alias("roc_auc"), F.round("pearson_r", 6).alias("pearson_r"), "tp", "fp", "fn", "tn", "f1", "accuracy")


SQL_SWEEP = f"WITH {_EVIDENCE} SELECT family, nth, variant, round(auc, 6) AS roc_auc, round(r, 6) AS pearson_r, tp, fp, fn, tn, f1, accuracy FROM decided"


def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best variant of each family of parameters."""
    scored = sweep.score_variants(evidence(spark, sf_dir), sweep.params_table(spark), "bundle", "label")
    return sweep.best_variants(sweep.rate_variants(scored)).select("family", "variant", F.round("roc_auc", 6).alias("roc_auc"), "f1")


SQL_BEST = f"""
WITH {_EVIDENCE},
best AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN family = 'flag threshold' THEN f1 ELSE round(coalesce(auc, 0), 4) END DESC, CASE WHEN family = 'flag threshold' THEN accuracy ELSE round(coalesce(r, 0), 4) END DESC, nth) AS k FROM decided)
SELECT family, variant, round(auc, 6) AS roc_auc, f1 FROM best WHERE k = 1
"""


def parameter_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the production and of the calibrated parameters on either split."""
    own = shared.stored(evidence(spark, sf_dir), "evidence")
    calibration = own.where("split = 'calibration'")
    best = sweep.best_variants(sweep.rate_variants(sweep.score_variants(calibration, sweep.params_table(spark), "bundle", "label")))
    return sweep.transfer(own, sweep.tuned(best))


SQL_TRANSFER = f"""
WITH {_EVIDENCE},
cmid AS (SELECT *, rank() OVER (PARTITION BY family, nth ORDER BY final_score) + (count(*) OVER (PARTITION BY family, nth, final_score) - 1) / 2.0 AS mr FROM scored WHERE split = 'calibration'),
crated AS (SELECT family, nth, (sum(mr) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) AS auc, CASE WHEN stddev_pop(final_score) > 0 THEN corr(final_score, label) END AS r FROM cmid GROUP BY family, nth),
chosen AS (SELECT family, nth, row_number() OVER (PARTITION BY family ORDER BY round(coalesce(auc, 0), 4) DESC, round(coalesce(r, 0), 4) DESC, nth) AS rank FROM crated),
tuned AS (
  SELECT max(sb) FILTER (family = 'semantic scale') AS sb, max(sr) FILTER (family = 'semantic scale') AS sr, max(k) FILTER (family = 'top-k sources') AS k, max(ladder) FILTER (family = 'source ladder') AS ladder,
    max(cb) FILTER (family = 'coherence mapping') AS cb, max(cr) FILTER (family = 'coherence mapping') AS cr FROM chosen JOIN variants USING (family, nth) WHERE rank = 1),
both_ AS (SELECT 'production' AS which, 30 AS sb, 70 AS sr, 3 AS k, 'current' AS ladder, 0.7 AS cb, 0.3 AS cr UNION ALL SELECT 'tuned', * FROM tuned),
again AS (SELECT which, split, label, {_FORMULA} AS final_score FROM ev, both_),
amid AS (SELECT *, rank() OVER (PARTITION BY which, split ORDER BY final_score) + (count(*) OVER (PARTITION BY which, split, final_score) - 1) / 2.0 AS mr FROM again),
aucs AS (SELECT which, split, count(*) AS n, round((sum(mr) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 4) AS auc FROM amid GROUP BY which, split)
SELECT split, max(n) AS n, max(auc) FILTER (which = 'production') AS production_auc, max(auc) FILTER (which = 'tuned') AS tuned_auc FROM aucs GROUP BY split
"""


def split_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the default score on either split."""
    scored = sweep.score_variants(evidence(spark, sf_dir), sweep.params_table(spark), "bundle", "label", "split").where("variant = '30/70'")
    return metrics.roc_auc(scored.withColumn("score", F.col("final_score").cast("double")), ["split"]).select("split", F.round("roc_auc", 6).alias("roc_auc"))


SQL_SPLIT_AUC = f"""
WITH {_EVIDENCE},
s AS (SELECT split, label, rank() OVER (PARTITION BY split ORDER BY final_score) + (count(*) OVER (PARTITION BY split, final_score) - 1) / 2.0 AS mr FROM scored WHERE variant = '30/70')
SELECT split, round((sum(mr) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS roc_auc FROM s GROUP BY split
"""

QUERIES = {
    f.__name__: f
    for f in (corroboration_by_label, scores_with_empty, topk_similarity, pairwise_coherence, nearest_centroid, rival_cluster_scores, topic_counts, semantic_dedup_edges, semantic_dedup, semantic_links, projection, param_sweep, best_variant, parameter_transfer, split_auc)
}
SQL = {
    "corroboration_by_label": SQL_CORROBORATION, "scores_with_empty": SQL_EMPTY, "topk_similarity": SQL_TOPK, "pairwise_coherence": SQL_COHERENCE, "nearest_centroid": SQL_NEAREST, "rival_cluster_scores": SQL_RIVALS,
    "topic_counts": SQL_TOPIC_COUNTS, "semantic_dedup_edges": SQL_EDGES, "semantic_dedup": SQL_DEDUP, "semantic_links": SQL_LINKS, "param_sweep": SQL_SWEEP, "best_variant": SQL_BEST, "split_auc": SQL_SPLIT_AUC, "parameter_transfer": SQL_TRANSFER,
}
