"""Fact-checked claims: verdicts, caps, identifiers and the stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.functions import fixed, text
from sourceweave.shared import lookup, numbered


def verdict_of(rating: Column) -> Column:
    """TRUE or FALSE for clear ratings, null for all others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in fixed.VERDICTS.items() for x in pair]), F.lower(F.trim(rating)))


def collect_claims(reviews: DataFrame, per_verdict: int, order: str) -> DataFrame:
    """Rows (claim, rating, date, url, ...) with a verdict, a claim once by its first 90 characters, so many a verdict."""
    rated = reviews.withColumn("verdict", verdict_of(F.col("rating"))).where("verdict is not null")
    rated = rated.withColumn("_key", F.lower(F.substring("claim", 1, 90)))
    first = Window.partitionBy("_key").orderBy(order)
    once = rated.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_key")
    capped = Window.partitionBy("verdict").orderBy(order)
    kept = once.withColumn("_n", F.row_number().over(capped)).where(F.col("_n") <= per_verdict).drop("_n")
    return kept.withColumns({"topic": text.topic_of(F.col("claim")), "query": text.search_query(F.col("claim")), "url": text.single_slashes(F.col("url"))})


def stratified_split(rows: DataFrame, stratum: str, by: list[str], share: float = 0.6) -> DataFrame:
    """``rows`` with ``split``: in each stratum three of five rows in order are for calibration, up to its share.

    A row's place in its stratum is its place in all less that of the stratum's first row, so a stratum may be of any size. Of
    the first i + 1 rows of a stratum 3 (i div 5) + min(i mod 5 + 1, 3) are the ones that may be taken.
    """
    placed = numbered(rows, [stratum, *by], "_at")
    sizes = placed.groupBy(stratum).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    placed = lookup(placed.where(F.col(stratum).isNotNull()), [stratum], sizes, F.col("_at")).withColumn("_i", F.col("_at") - F.col("_first"))
    used = 3 * F.floor(F.col("_i") / 5) + F.least(F.col("_i") % 5 + 1, F.lit(3))
    # half goes to the even number, as in the rounding of the language the rule comes from
    taken = (F.col("_i") % 5 < 3) & (used <= F.bround(F.col("_n") * share))
    return placed.withColumn("split", F.when(taken, "calibration").otherwise("evaluation")).drop("_at", "_first", "_i", "_n")


def number_claims(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``claim_id``: C001 and so on in order."""
    return numbered(rows, by, "_at").withColumn("claim_id", F.format_string("C%03d", F.col("_at") + 1)).drop("_at")
