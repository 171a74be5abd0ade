"""Parameter sweeps: evidence is gathered once, every variant scores it as one more row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceweave.functions import scores
from sourceweave.functions.scores import DEFAULT, SOURCE_LADDER, ScoreParams
from sourceweave.operators import metrics

# The families of variants.
LADDERS = {
    "flat": ((1, 1.00),),
    "mild": ((5, 1.00), (4, 0.98), (3, 0.95), (2, 0.90), (1, 0.85)),
    "current": SOURCE_LADDER,
    "steep": ((5, 1.00), (4, 0.90), (3, 0.75), (2, 0.55), (1, 0.35)),
}
SEMANTIC_BASES, TOP_KS, COHERENCE_BASES, FLAG_THRESHOLDS = (0, 20, 30, 50), (1, 3, 5, 0), (0.50, 0.70, 0.90, 1.00), (60, 70, 75, 85)
STANCE_BASES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.3, 0.0)
THRESHOLD_FAMILY = "flag threshold"
PARAM_FIELDS = ("semantic_base", "semantic_range", "top_k", "ladder", "coherence_base", "coherence_range", "lone_coherence", "stance_base", "score_min", "score_max", "flag_threshold")


def families() -> dict[str, list[ScoreParams]]:
    """The variants of each family, in the order in which equals are preferred."""
    change = DEFAULT.with_values
    return {
        "semantic scale": [change(semantic_base=float(b), semantic_range=100.0 - b, label=f"{b}/{100 - b}") for b in SEMANTIC_BASES],
        "top-k sources": [change(top_k=k, label=f"top-{k or 'all'}") for k in TOP_KS],
        "source ladder": [change(ladder=ladder, label=name) for name, ladder in LADDERS.items()],
        "coherence mapping": [change(coherence_base=b, coherence_range=round(1 - b, 2), label=f"{b:.2f}/{1 - b:.2f}") for b in COHERENCE_BASES],
        THRESHOLD_FAMILY: [change(flag_threshold=t, label=str(t)) for t in FLAG_THRESHOLDS],
    }


def params_table(spark: SparkSession, variants: dict[str, list[ScoreParams]] | None = None) -> DataFrame:
    """(family, nth, variant, p): a row a variant, its parameters in a struct. A few dozen rows."""
    rows = [
        (family, nth, v.label, v.semantic_base, v.semantic_range, v.top_k, [(n, float(f)) for n, f in sorted(v.ladder, reverse=True)], v.coherence_base, v.coherence_range, v.lone_coherence, v.stance_base, v.score_min, v.score_max, v.flag_threshold)
        for family, own in (variants or families()).items()
        for nth, v in enumerate(own)
    ]
    types = ("double", "double", "int", "array<struct<n: int, f: double>>", "double", "double", "double", "double", "int", "int", "int")
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(PARAM_FIELDS, types))
    flat = spark.createDataFrame(rows, f"family string, nth int, variant string, {schema}")
    return flat.select("family", "nth", "variant", F.struct(*PARAM_FIELDS).alias("p"))


def score_variants(evidence: DataFrame, variants: DataFrame, *keep: str) -> DataFrame:
    """Every row of ``evidence`` (similarities, sources, upper; support may follow) under every variant.

    The variants are the broadcast side: evidence is read once and not shuffled.
    """
    p = {f: F.col(f"p.{f}") for f in PARAM_FIELDS}
    support = F.col("support") if "support" in evidence.columns else None
    parts = scores.score_arrays(F.col("similarities"), F.col("sources"), F.col("upper"), p, support)
    crossed = evidence.crossJoin(F.broadcast(variants))
    return crossed.select(*keep, "family", "nth", "variant", parts["final_score"].alias("final_score"), parts["flagged"].alias("flagged"), F.col("p.flag_threshold").alias("flag_threshold"))


def rate_variants(scored: DataFrame) -> DataFrame:
    """AUC, correlation, F1 and accuracy (at the variant's own threshold) of each variant; scored has label."""
    rows = scored.withColumn("score", F.col("final_score").cast("double"))
    keys = ["family", "nth", "variant"]
    decided = metrics.classification(rows, [*keys, "flag_threshold"], F.col("flag_threshold")).drop("flag_threshold")
    return metrics.roc_auc(rows, keys).join(metrics.pearson(rows, keys), keys).join(decided, keys)


def best_variants(rated: DataFrame) -> DataFrame:
    """The best variant of each family: by AUC and correlation, the threshold's by F1 and accuracy; the first of equals."""
    flag = F.col("family") == THRESHOLD_FAMILY
    first = F.when(flag, F.col("f1")).otherwise(F.round("roc_auc", 4))
    second = F.when(flag, F.col("accuracy")).otherwise(F.round("pearson_r", 4))
    rank = Window.partitionBy("family").orderBy(F.coalesce(first, F.lit(0.0)).desc(), F.coalesce(second, F.lit(0.0)).desc(), "nth")
    return rated.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")


def tuned(best: DataFrame) -> ScoreParams:
    """The parameters that join the best variants of all families but the threshold's."""
    chosen = {r.family: r.nth for r in best.select("family", "nth").collect()}  # a row a family
    out = DEFAULT
    fields = {"semantic scale": ("semantic_base", "semantic_range"), "top-k sources": ("top_k",), "source ladder": ("ladder",), "coherence mapping": ("coherence_base", "coherence_range")}
    for family, names in fields.items():
        if family in chosen:
            variant = families()[family][chosen[family]]
            out = out.with_values(**{n: getattr(variant, n) for n in names})
    return out.with_values(label="tuned")


def transfer(evidence: DataFrame, params: ScoreParams) -> DataFrame:
    """(split, n, production_auc, tuned_auc) of the default and the tuned parameters on each split."""
    variants = params_table(evidence.sparkSession, {"transfer": [DEFAULT.with_values(label="production"), params.with_values(label="tuned")]})
    scored = score_variants(evidence, variants, "split", "label").withColumn("score", F.col("final_score").cast("double"))
    aucs = metrics.roc_auc(scored, ["split", "variant"]).groupBy("split").pivot("variant", ["production", "tuned"]).agg(F.round(F.first("roc_auc"), 4))
    sizes = evidence.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(aucs, "split").select("split", "n", F.col("production").alias("production_auc"), F.col("tuned").alias("tuned_auc"))


def calibrate_stance(evidence: DataFrame, calibration: str = "calibration") -> float | None:
    """The stance_base with the best AUC on the calibration split, None unless one beats having none."""
    own = evidence.where(F.col("split") == calibration)
    variants = params_table(own.sparkSession, {"stance": [DEFAULT, *[DEFAULT.with_values(stance_base=b, label=str(b)) for b in STANCE_BASES]]})
    scored = score_variants(own, variants, "label").withColumn("score", F.col("final_score").cast("double"))
    rated = sorted((r.nth, r.roc_auc) for r in metrics.roc_auc(scored, ["nth"]).collect())  # eight rows
    if own.count() < 6 or not rated or rated[0][1] is None:
        return None
    best, most = None, rated[0][1]
    for nth, value in rated[1:]:
        if value > most:
            best, most = STANCE_BASES[nth - 1], value
    return best
