"""Rival scores over evidence bundles, a bundle a row, all from 0 to 100.

Bundle columns: articles (array of structs with title, text, domain, body_available, url_resolved, stance), summary,
similarities, claims and claim_similarities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions import fixed, scores, text, vectors
from sourceweave.functions.scores import DEFAULT, ScoreParams
from sourceweave.operators import topics


def _sources(articles: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(articles, lambda a: a["domain"]), lambda d: d.isNotNull() & (d != "")))


def source_count(articles: Column) -> Column:
    """Trust grows with the number of sources."""
    return F.least(F.lit(99), 45 + 10 * F.size(_sources(articles))).cast("double")


def semantic_only(similarities: Column, params: ScoreParams = DEFAULT) -> Column:
    """The first factor of the score alone; 0 without similarities."""
    some = F.size(F.coalesce(similarities, F.array().cast("array<double>"))) > 0
    return F.when(some, params.semantic_base + params.semantic_range * vectors.top_mean(similarities, params.top_k)).otherwise(0.0)


def sensational_lexicon(articles: Column) -> Column:
    """100 less the mean share of sensational language; 0 without articles."""
    shares = F.transform(articles, lambda a: text.sensational_share(F.coalesce(a["title"], F.lit("")), a["text"]))
    return F.coalesce(100 * (1 - vectors.mean(shares)), F.lit(0.0))


def claim_substantiation(articles: Column, claims: Column, matrix: Column, threshold: float = 0.55) -> Column:
    """Share of claims that two sources or more back, and share of sources that exist."""

    def backed(row: Column) -> Column:
        named = F.zip_with(row, F.transform(articles, lambda a: a["domain"]), lambda s, d: F.when(s >= threshold, d))
        return F.size(F.array_distinct(F.filter(named, lambda d: d.isNotNull() & (d != "")))) >= 2

    share = F.size(F.filter(matrix, backed)) / F.size(claims)
    real = F.coalesce(F.size(F.filter(articles, lambda a: a["url_resolved"] & a["body_available"])) / F.nullif(F.size(articles), F.lit(0)), F.lit(0.0))
    some = (F.size(F.coalesce(claims, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(matrix, F.array().cast("array<array<double>>"))) > 0)
    return F.when(some, 100 * (0.75 * share + 0.25 * real)).otherwise(0.0)


def stance_value(stance: Column) -> Column:
    return F.when(stance == "debunk", 0.0).when(stance == "promote", 1.0).otherwise(0.5)


def stance_support(articles: Column) -> Column:
    """Mean stance of the articles, 0.5 without any."""
    return F.coalesce(vectors.mean(F.transform(articles, lambda a: stance_value(a["stance"]))), F.lit(0.5))


def evidence_verdict(articles: Column) -> Column:
    """Weighted mean stance (a read body counts twice a headline), less for few sources; 0 without articles."""
    weight = lambda a: F.when(F.coalesce(a["body_available"], F.lit(False)), 1.0).otherwise(0.5)
    add = lambda s, x: s + x
    total = F.aggregate(F.transform(articles, weight), F.lit(0.0), add)
    support = F.aggregate(F.transform(articles, lambda a: weight(a) * stance_value(a["stance"])), F.lit(0.0), add)
    cover = F.least(F.lit(1.0), F.size(_sources(articles)) / 5)
    return F.when(F.size(articles) > 0, 100 * support / total * (0.6 + 0.4 * cover)).otherwise(0.0)


def reputation(bundles: DataFrame, profiles: DataFrame, key: str = "claim_id") -> DataFrame:
    """(key, score): mean over a bundle's domains of the criteria that each fulfils; 0 without domains.

    profiles: domain with the booleans reachable, about, corrections, staff, contact, has_bylines, labels_ads and
    labels_opinion; a domain without a profile fulfils only what its headlines show.
    """
    articles = bundles.select(key, F.explode("articles").alias("a")).select(key, F.col("a.domain").alias("domain"), F.coalesce(text.sensational_hits(F.col("a.title")) >= 2, F.lit(False)).alias("loud"))
    domains = articles.where("domain is not null and domain <> ''").groupBy(key, "domain").agg(F.bool_or("loud").alias("loud")).join(profiles, "domain", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    open_desk = has("reachable") & (has("about") | has("corrections"))
    holds = {
        "no_repeated_false_content": open_desk, "responsible_gathering": open_desk, "corrections_policy": has("corrections"), "news_opinion_separation": has("labels_opinion"),
        "no_deceptive_headlines": ~F.col("loud"), "ownership_financing_disclosed": has("about"), "advertising_labelled": has("labels_ads"),
        "who_is_in_charge": has("staff") | has("contact"), "content_creators_named": has("has_bylines") | has("staff"),
    }
    earned = reduce(Column.__add__, [F.when(holds[c], w).otherwise(0.0) for c, w in fixed.REPUTATION_WEIGHTS.items()])
    found = domains.select(key, earned.alias("earned")).groupBy(key).agg(F.avg("earned").alias("score"))
    return bundles.select(key).join(found, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def all_methods(bundles: DataFrame, profiles: DataFrame, params: ScoreParams = DEFAULT, key: str = "claim_id") -> DataFrame:
    """(key, method, score) in long form for the score and all seven rivals: those of :func:`score_bundles`, reputation by
    ``profiles`` (as in :func:`reputation`), the lexicon, and the TF-IDF overlap of a summary and its articles' texts.
    """
    texts = bundles.select(key, F.posexplode("articles").alias("_at", "_a")).select(key, F.col("_at").cast("bigint").alias("_at"), F.col("_a.text").alias("text"))
    overlap = topics.tfidf_overlap(bundles.select(key, "summary"), texts, key, "_at")
    lexicon = bundles.select(key, sensational_lexicon(F.col("articles")).alias("score"))
    more = {"reputation": reputation(bundles, profiles, key), "sensational_lexicon": lexicon, "tfidf_overlap": overlap}
    long = [score_bundles(bundles, params, key), *[table.select(key, F.lit(m).alias("method"), F.round("score", 2).alias("score")) for m, table in more.items()]]
    return reduce(DataFrame.union, long)


def score_bundles(bundles: DataFrame, params: ScoreParams = DEFAULT, key: str = "claim_id") -> DataFrame:
    """(key, method, score) in long form for the score and the rivals that need nothing but the bundle."""
    own = scores.score_arrays(F.col("similarities"), F.transform("articles", lambda a: a["domain"]), vectors.upper_triangle(F.col("pairwise")), params.columns(), stance_support(F.col("articles")))
    methods = {
        "corroboration": own["final_score"].cast("double"),
        "source_count": source_count(F.col("articles")),
        "semantic_only": semantic_only(F.col("similarities"), params),
        "claim_substantiation": claim_substantiation(F.col("articles"), F.col("claims"), F.col("claim_similarities")),
        "evidence_verdict": evidence_verdict(F.col("articles")),
    }
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.round(s, 2).alias("score")) for m, s in methods.items()])).alias("m")
    return bundles.select(key, long).select(key, "m.method", "m.score")
