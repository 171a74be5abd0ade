"""The study of scoring methods over evidence bundles: scores, metrics, uncertainty, splits, sweep and transfer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave import shared
from sourceweave.functions import scores, vectors
from sourceweave.functions.scores import DEFAULT
from sourceweave.operators import clusters, metrics, resampling, rivals, sweep
from sourceweave.sources.tables import scan


@dataclass
class Study:
    """Tables of a study, each worked out when it is first asked for.

    scores: (claim_id, method, score, label, split); pooled and held_out: metrics by method, the former with the uncertainty of
    ``samples`` draws; split_auc by method and split; balance by split and label; variants, best and transfer of the sweep.
    """

    scores: DataFrame
    evidence: DataFrame
    stance_base: float | None
    calibration: str
    evaluation: str
    samples: int

    @cached_property
    def pooled(self) -> DataFrame:
        return rate_methods(self.scores, self.samples)

    @cached_property
    def held_out(self) -> DataFrame:
        return rate_methods(self.scores.where(F.col("split") == self.evaluation))

    @cached_property
    def split_auc(self) -> DataFrame:
        return metrics.roc_auc(self.scores, ["method", "split"])

    @cached_property
    def balance(self) -> DataFrame:
        return self.evidence.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def variants(self) -> DataFrame:
        own = self.evidence.where(F.col("split") == self.calibration)
        return shared.stored(sweep.rate_variants(sweep.score_variants(own, sweep.params_table(own.sparkSession), "claim_id", "label")), "variants")

    @cached_property
    def best(self) -> DataFrame:
        return sweep.best_variants(self.variants)

    @cached_property
    def transfer(self) -> DataFrame:
        return sweep.transfer(self.evidence, sweep.tuned(self.best))


def score_methods(bundles: DataFrame, calibration: str = "calibration", sensational: bool = False) -> tuple[DataFrame, DataFrame, float | None]:
    """(claim_id, method, score, label, split) of all methods, the evidence, and the stance factor that is reported as one more method."""
    kept = shared.stored(bundles, "bundles")
    label = (F.col("verdict") == "TRUE").cast("int").alias("label")
    evidence = shared.stored(
        kept.select(
            "claim_id", "split", label, "similarities", F.transform("articles", lambda a: a["domain"]).alias("sources"), vectors.upper_triangle(F.col("pairwise")).alias("upper"),
            rivals.stance_support(F.col("articles")).alias("support"),
        ),
        "evidence",
    )
    long = rivals.score_bundles(kept)
    if sensational:
        long = long.union(kept.select("claim_id", F.lit("sensational_lexicon"), F.round(rivals.sensational_lexicon(F.col("articles")), 2)))
    stance = sweep.calibrate_stance(evidence, calibration)
    if stance is not None:
        one = sweep.params_table(kept.sparkSession, {"stance": [DEFAULT.with_values(stance_base=stance)]})
        long = long.union(sweep.score_variants(evidence, one, "claim_id").select("claim_id", F.lit("with_stance"), F.col("final_score").cast("double")))
    return shared.stored(long.join(evidence.select("claim_id", "split", "label"), "claim_id"), "scores"), evidence, stance


def rate_methods(scored: DataFrame, samples: int | None = None) -> DataFrame:
    """The metrics of each method, best first: the score at its flag threshold, rivals at their best one; with the uncertainty of ``samples`` draws."""
    own = F.col("method").isin("corroboration", "with_stance")
    found = metrics.evaluate(scored.where(own), ["method"], float(DEFAULT.flag_threshold)).withColumn("threshold", F.lit(DEFAULT.flag_threshold))
    found = found.unionByName(metrics.evaluate(scored.where(~own), ["method"]))
    if samples:
        bounds = resampling.resampled(scored, "method", "claim_id", samples, draws="rows")
        found = found.join(bounds, "method").withColumn("near_chance", scores.straddles_chance(F.col("auc_lo"), F.col("auc_hi")))
    return found.orderBy(F.col("roc_auc").desc(), F.col("f1").desc())


def run_study(bundles: DataFrame, calibration: str = "calibration", held_out: str = "evaluation", samples: int = 2000, sensational: bool = False) -> Study:
    """All methods over ``bundles`` (columns as in tables.BUNDLE), the score at its flag threshold and the rivals at their best ones.

    sensational: include the lexicon, for bundles that have their articles' text. A stance factor that does better on the
    calibration split than none is reported as one more method, never applied.
    """
    table, evidence, stance = score_methods(bundles, calibration, sensational)
    return Study(table, evidence, stance, calibration, held_out, samples)


def summary(study: Study) -> DataFrame:
    """One row, json: the headline tables of a study."""
    tables = {"pooled": study.pooled, "held_out": study.held_out, "split_auc": study.split_auc, "balance": study.balance, "best": study.best, "transfer": study.transfer}
    out = study.pooled.sparkSession.range(1).select(F.lit(1).alias("_one"))
    for name, table in tables.items():
        out = out.crossJoin(F.broadcast(table.agg(F.collect_list(F.struct(*table.columns)).alias(name))))
    return out.select(F.to_json(F.struct(*tables)).alias("json"))


def vector_bundles(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """Bundles of neighbouring vectors as articles: similarity to their label's mean, sources by number, verdicts by turns."""
    rows = scan(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").withColumn("bundle", F.expr(f"vec_id div {size}"))
    scored = clusters.similarities(rows, "label", "embedding")
    left, right = rows.select("bundle", "vec_id", "embedding").alias("l"), rows.select("bundle", "vec_id", "embedding").alias("r")
    cells = left.join(right, F.col("l.bundle") == F.col("r.bundle")).select(F.col("l.bundle").alias("bundle"), F.col("l.vec_id").alias("i"), F.col("r.vec_id").alias("j"), vectors.cosine(F.col("l.embedding"), F.col("r.embedding")).alias("c"))
    lines = cells.groupBy("bundle", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda x: x["c"]).alias("line"))
    matrix = lines.groupBy("bundle").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("pairwise"))
    article = F.struct(
        F.concat(F.lit("Title "), "vec_id").alias("title"), F.concat(F.lit("src"), (F.col("vec_id") * F.col("vec_id") % 7).cast("string")).alias("domain"), (F.col("vec_id") % 3 > 0).alias("body_available"),
        F.lit(True).alias("url_resolved"), F.when(F.col("vec_id") % 11 == 0, "debunk").otherwise("neutral").alias("stance"),
    )
    own = scored.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("vec_id", "similarity", article.alias("a")))).alias("x")).join(matrix, "bundle")
    return own.select(
        F.format_string("C%05d", "bundle").alias("claim_id"), F.lit("s").alias("summary"), F.when(F.col("bundle") % 2 == 0, "TRUE").otherwise("FALSE").alias("verdict"), F.when(F.col("bundle") % 5 < 3, "calibration").otherwise("evaluation").alias("split"),
        F.transform("x", lambda x: x["a"]).alias("articles"), F.transform("x", lambda x: x["similarity"]).alias("similarities"), "pairwise", F.array(F.lit("one"), F.lit("two")).alias("claims"), F.slice("pairwise", 1, 2).alias("claim_similarities"),
    )


def study_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all methods over bundles of vectors, best first."""
    return run_study(vector_bundles(spark, sf_dir)).pooled


def bundle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method's score of every bundle of vectors."""
    return rivals.score_bundles(vector_bundles(spark, sf_dir)).withColumn("score", F.round("score", 1))


SQL_SCORES = """
WITH cent AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label),
rows AS (SELECT vec_id, vec_id // 8 AS bundle, CAST(embedding AS DOUBLE[]) AS v, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s, vec_id * vec_id % 7 AS src FROM embeddings JOIN cent USING (label)),
up AS (SELECT a.bundle, avg(list_cosine_similarity(a.v, b.v)) AS coh FROM rows a JOIN rows b ON a.bundle = b.bundle AND a.vec_id < b.vec_id GROUP BY a.bundle),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY s DESC) AS k, row_number() OVER (PARTITION BY bundle ORDER BY vec_id) AS p FROM rows),
facts AS (SELECT r.bundle, avg(s) FILTER (k <= 3) AS t3, count(DISTINCT src) AS ns, coalesce(any_value(coh), 0.5) AS coh,
  sum(CASE WHEN vec_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0.5 END * CASE WHEN vec_id % 11 = 0 THEN 0.0::DOUBLE ELSE 0.5 END) / sum(CASE WHEN vec_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0.5 END) AS conf, avg((vec_id % 3 > 0)::INT) AS real, count(*) AS n FROM ranked r LEFT JOIN up USING (bundle) GROUP BY r.bundle),
backed AS (SELECT bundle, sum((b >= 2)::INT) AS ok, count(*) AS claims FROM (SELECT a.bundle, a.p, count(DISTINCT b.src) FILTER (list_cosine_similarity(a.v, b.v) >= 0.55) AS b FROM ranked a JOIN rows b USING (bundle) WHERE a.p <= 2 GROUP BY a.bundle, a.p) GROUP BY bundle),
out AS (
  SELECT f.*, ok, CASE WHEN ns >= 5 THEN 1.0 WHEN ns = 4 THEN 0.95 WHEN ns = 3 THEN 0.85 WHEN ns = 2 THEN 0.72 ELSE 0.6 END::DOUBLE AS ladder FROM facts f JOIN backed USING (bundle))
SELECT printf('C%05d', bundle) AS claim_id, method, round(score, 1) AS score FROM (
  SELECT bundle, 'corroboration' AS method, CAST(least(99, greatest(5, trunc((30 + 70 * t3) * ladder * (0.7::DOUBLE + 0.3::DOUBLE * coh)))) AS DOUBLE) AS score FROM out UNION ALL
  SELECT bundle, 'source_count', CAST(least(99, 45 + 10 * ns) AS DOUBLE) FROM out UNION ALL SELECT bundle, 'semantic_only', round(30 + 70 * t3, 2) FROM out UNION ALL
  SELECT bundle, 'claim_substantiation', round(100 * (0.75::DOUBLE * ok / 2 + 0.25::DOUBLE * real), 2) FROM out UNION ALL
  SELECT bundle, 'evidence_verdict', round(100 * conf * (0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, ns / 5.0::DOUBLE)), 2) FROM out)
"""

QUERIES = {"study_metrics": study_metrics, "bundle_scores": bundle_scores}
SQL = {"bundle_scores": SQL_SCORES}
