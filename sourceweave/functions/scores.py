"""The corroboration score and the labels drawn from scores."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceweave.functions import vectors

# Factor by number of independent sources.
SOURCE_LADDER = ((5, 1.00), (4, 0.95), (3, 0.85), (2, 0.72), (1, 0.60))


@dataclass(frozen=True)
class ScoreParams:
    """Parameters of the score: fixed values by default, overridden a call at a time."""

    semantic_base: float = 30.0
    semantic_range: float = 70.0
    top_k: int = 3
    ladder: tuple[tuple[int, float], ...] = SOURCE_LADDER
    coherence_base: float = 0.70
    coherence_range: float = 0.30
    lone_coherence: float = 0.50
    stance_base: float = 1.0
    score_min: int = 5
    score_max: int = 99
    flag_threshold: int = 75
    label: str = "default"

    def with_values(self, **changes: object) -> ScoreParams:
        return replace(self, **changes)

    def columns(self) -> dict[str, Column]:
        """The parameters as literals, for :func:`score_columns`."""
        steps = [F.struct(F.lit(n).alias("n"), F.lit(float(f)).alias("f")) for n, f in sorted(self.ladder, reverse=True)]
        return {k: F.lit(v) for k, v in self.__dict__.items() if k != "ladder"} | {"ladder": F.array(*steps)}


DEFAULT = ScoreParams()


def ladder_factor(n_sources: Column, ladder: Column) -> Column:
    """Factor of the first rung, highest first, that ``n_sources`` reaches; the lowest rung's below all."""
    reached = F.filter(ladder, lambda r: n_sources >= r["n"])
    return F.when(F.size(reached) > 0, reached[0]["f"]).otherwise(F.element_at(ladder, -1)["f"])


def score_columns(avg_similarity: Column, n_sources: Column, coherence: Column, params: dict[str, Column] | None = None, support: Column | None = None) -> dict[str, Column]:
    """The parts of the score from the mean top similarity, the number of sources and their mean agreement.

    coherence: null where a source is alone. support: share of coverage that supports, read only below stance_base 1.
    The score is truncated, not rounded, and flagged before it is clipped.
    """
    p = params or DEFAULT.columns()
    semantic = p["semantic_base"] + avg_similarity * p["semantic_range"]
    factor = ladder_factor(n_sources, p["ladder"])
    agreed = F.coalesce(coherence, p["lone_coherence"].cast("double"))
    coherent = p["coherence_base"] + agreed * p["coherence_range"]
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(support if support is not None else F.lit(None).cast("double"), F.lit(0.5))))
    stance = F.when(p["stance_base"] < 1, p["stance_base"] + (1 - p["stance_base"]) * share).otherwise(1.0)
    raw = (semantic * factor * coherent * stance).cast("int")
    return {
        "final_score": F.least(p["score_max"], F.greatest(p["score_min"], raw)), "semantic_score": semantic, "avg_similarity": avg_similarity,
        "source_factor": factor, "n_sources": n_sources, "coherence_factor": coherent, "source_coherence": agreed, "flagged": raw < p["flag_threshold"],
    }


def score_arrays(similarities: Column, sources: Column, upper: Column, params: dict[str, Column] | None = None, support: Column | None = None) -> dict[str, Column]:
    """:func:`score_columns` from arrays, with the sorted sources."""
    p = params or DEFAULT.columns()
    known = F.array_sort(F.array_distinct(F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))))
    sims = F.coalesce(similarities, F.array().cast("array<double>"))
    out = score_columns(vectors.top_mean(sims, p["top_k"]), F.size(known), vectors.mean(vectors.doubles(upper)), p, support)
    return out | {"sources": known}


def consensus(n_sources: Column) -> Column:
    return F.when(n_sources >= 5, "STRONG").when(n_sources == 4, "GOOD").when(n_sources == 3, "MODERATE").when(n_sources == 2, "WEAK").otherwise("SINGLE-SOURCE")


def confidence(score: Column) -> Column:
    """Band of a score: high from 80, moderate from 75, low above 50, else flagged."""
    return F.when(score >= 80, "high").when(score >= 75, "moderate").when(score > 50, "low").otherwise("flagged")


def agreement(cosine: Column) -> Column:
    return F.when(cosine > 0.85, "strong").when(cosine < 0.4, "weak").otherwise("neutral")


def sentiment(label: Column, value: Column, score: Column) -> tuple[Column, Column]:
    """(label, score): the first value there is, and the sign's label where none is given."""
    number = F.coalesce(value, score, F.lit(0.0))
    given = F.upper(F.coalesce(label, F.lit("")))
    sign = F.when(number > 0.2, "POSITIVE").when(number < -0.2, "NEGATIVE").otherwise("NEUTRAL")
    return F.when(given.isin("POSITIVE", "NEGATIVE", "NEUTRAL"), given).otherwise(sign), number


def signed_sentiment(label: Column, score: Column) -> Column:
    """A classifier's score with its sign: negative unless the label is POSITIVE."""
    return F.when(F.upper(label) == "POSITIVE", F.round(score, 4)).otherwise(-F.round(score, 4))


def sentiment_shares(label: Column) -> dict[str, Column]:
    """Whole percentages of positive, negative and neutral rows as aggregates; the neutral ones are what is left to 100."""
    share = lambda kind: F.floor(100 * F.sum((label == kind).cast("int")) / F.count(F.lit(1)) + 0.5).cast("int")
    positive, negative = share("POSITIVE"), share("NEGATIVE")
    return {"positive": positive, "negative": negative, "neutral": 100 - positive - negative}


def headline_only(articles: Column) -> Column:
    """Articles of an export that are known to lack a body."""
    return F.size(F.filter(articles, lambda a: a["bodyAvailable"] == F.lit(False)))


def mean_sentiment_label(mean: Column) -> Column:
    return F.when(mean > 0.2, "Positive").when(mean < -0.2, "Negative").otherwise("Neutral")


def straddles_chance(low: Column, high: Column) -> Column:
    return (low <= 0.5) & (high >= 0.5)
