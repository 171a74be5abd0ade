"""Queries of the evaluation algebra: scores of ``documents`` against ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.functions import text
from sourceweave.operators import metrics, resampling
from sourceweave.plans.texts import SENSATIONAL
from sourceweave.sources.tables import scan


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, score, label): freedom from sensational language against the quality label."""
    docs = scan(spark, sf_dir, "documents", "doc_id", "lang", "text").select("doc_id", "lang", F.round(100 * (1 - text.sensational_share(None, F.col("text"))), 6).alias("score"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


_SCORED = f"{SENSATIONAL}, scored AS (SELECT doc_id, lang, score, quality AS label FROM sensational JOIN documents USING (doc_id) JOIN labels USING (doc_id))"
_RANKED = f"{_SCORED}, ranked AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS midrank, rank() OVER (PARTITION BY lang ORDER BY label) + (count(*) OVER (PARTITION BY lang, label) - 1) / 2.0::DOUBLE AS label_rank FROM scored)"
_AUC = "CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(midrank) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) END"


def midranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-rank of each score within its language."""
    return metrics.midranks(scored(spark, sf_dir), ["lang"]).select("doc_id", "lang", "score", "midrank")


SQL_MIDRANKS = f"WITH {_RANKED} SELECT doc_id, lang, score, midrank FROM ranked"


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by language."""
    return metrics.roc_auc(scored(spark, sf_dir), ["lang"]).select("lang", F.round("roc_auc", 6).alias("roc_auc"))


SQL_AUC = f"WITH {_RANKED} SELECT lang, round({_AUC}, 6) AS roc_auc FROM ranked GROUP BY lang"


def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both correlations by language."""
    found = metrics.correlations(scored(spark, sf_dir), ["lang"])
    return found.select("lang", F.round("pearson_r", 6).alias("pearson_r"), F.round("spearman_rho", 6).alias("spearman_rho"))


_CORR = "CASE WHEN count(*) > 1 AND stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN corr({0}, {1}) END"
SQL_CORR = f"WITH {_RANKED} SELECT lang, round({_CORR.format('score', 'label')}, 6) AS pearson_r, round({_CORR.format('midrank', 'label_rank')}, 6) AS spearman_rho FROM ranked GROUP BY lang"

_DECIDED = """round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall,
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS accuracy"""
_COUNTED = "count(*) FILTER (score >= {0} AND label = 1) AS tp, count(*) FILTER (score >= {0} AND label = 0) AS fp, count(*) FILTER (score < {0} AND label = 1) AS fn, count(*) FILTER (score < {0} AND label = 0) AS tn"


def classification_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision at 75 by language."""
    return metrics.classification(scored(spark, sf_dir), ["lang"], 75.0)


SQL_DECISION = f"WITH {_SCORED}, c AS (SELECT lang, {_COUNTED.format(75)} FROM scored GROUP BY lang) SELECT lang, tp, fp, fn, tn, {_DECIDED} FROM c"


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best whole threshold by language."""
    return metrics.best_threshold(scored(spark, sf_dir), ["lang"])


SQL_BEST = f"""
WITH {_SCORED}, c AS (SELECT lang, CAST(t AS INTEGER) AS threshold, {_COUNTED.format('t')} FROM scored, range(5, 100) r(t) GROUP BY lang, t), d AS (SELECT *, {_DECIDED} FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, accuracy DESC, threshold) AS k FROM d)
SELECT lang, threshold, tp, fp, fn, tn, precision, recall, f1, accuracy FROM b WHERE k = 1
"""


def method_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of two methods, length and language, best first."""
    rows = scored(spark, sf_dir)
    length = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.least(F.lit(100.0), F.col("n_chars") / 50).alias("by_length"))
    long = rows.join(length, "doc_id").select(F.explode(F.array(F.struct(F.lit("lexicon").alias("method"), F.col("score")), F.struct(F.lit("length").alias("method"), F.col("by_length").alias("score")))).alias("m"), "label").select("m.method", "m.score", "label")
    return metrics.evaluate(long, ["method"])


# the tail of t as a finite sum of powers of the cosine, odd or even by the degrees of freedom
SQL_METHODS = f"""
WITH {_SCORED},
long AS (SELECT 'lexicon' AS method, score, label FROM scored UNION ALL SELECT 'length', least(100.0::DOUBLE, n_chars / 50.0::DOUBLE), label FROM scored JOIN documents USING (doc_id)),
ranked AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0::DOUBLE AS midrank, rank() OVER (PARTITION BY method ORDER BY label) + (count(*) OVER (PARTITION BY method, label) - 1) / 2.0::DOUBLE AS label_rank FROM long),
m AS (SELECT method, count(*) AS n, round(avg(score) FILTER (label = 1), 2) AS mean_true, round(avg(score) FILTER (label = 0), 2) AS mean_false, {_CORR.format('score', 'label')} AS r, {_CORR.format('midrank', 'label_rank')} AS rho, {_AUC} AS auc FROM ranked GROUP BY method),
a AS (SELECT method, n - 2 AS df, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) AS angle FROM m),
k AS (SELECT method, df, angle, unnest(range(1, CASE WHEN df > 1 THEN (df - df % 2) // 2 ELSE 1 END)) AS k FROM a),
s AS (SELECT method, sum(power) AS powers FROM (SELECT method, exp(sum(ln(CASE WHEN df % 2 = 1 THEN 2.0::DOUBLE * k / (2 * k + 1) ELSE (2.0::DOUBLE * k - 1) / (2 * k) END * cos(angle) * cos(angle))) OVER (PARTITION BY method ORDER BY k)) AS power FROM k) GROUP BY method),
t AS (SELECT method, 1 - CASE WHEN df % 2 = 0 THEN sin(angle) * (1 + coalesce(powers, 0)) ELSE 2 / pi() * (angle + sin(angle) * cos(angle) * (1 + coalesce(powers, 0))) END AS p FROM a LEFT JOIN s USING (method)),
c AS (SELECT method, CAST(t AS INTEGER) AS threshold, {_COUNTED.format('t')} FROM long, range(5, 100) g(t) GROUP BY method, t), d AS (SELECT *, {_DECIDED} FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, accuracy DESC, threshold) AS k FROM d)
SELECT method, n, mean_true, mean_false, round(r, 4) AS pearson_r, round(rho, 4) AS spearman_rho, round(auc, 4) AS roc_auc, threshold, tp, fp, fn, tn, precision, recall, f1, accuracy, abs(round(p, 6)) AS pearson_p, round(mean_true - mean_false, 2) AS separation
FROM m JOIN t USING (method) JOIN b USING (method) WHERE k = 1
"""


def bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the AUC over all labelled documents."""
    return resampling.bootstrap_interval(scored(spark, sf_dir), "doc_id")


def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often shuffled labels do as well."""
    return resampling.permutation_test(scored(spark, sf_dir), "doc_id")


QUERIES = {f.__name__: f for f in (midranks, roc_auc, pearson_spearman, classification_at_threshold, best_threshold, method_metrics, bootstrap_auc, permutation_p)}
SQL = {"midranks": SQL_MIDRANKS, "roc_auc": SQL_AUC, "pearson_spearman": SQL_CORR, "classification_at_threshold": SQL_DECISION, "best_threshold": SQL_BEST, "method_metrics": SQL_METHODS}
