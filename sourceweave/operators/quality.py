"""How far a corpus can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceweave.functions import fixed, text, urls

MIN_BODY = 300


def assemble_row(topic: Column, title: Column, url: Column, date: Column, snippet: Column, publisher: Column, publisher_url: Column, body: Column) -> list[Column]:
    """The columns of a corpus row from a candidate and its body.

    The body counts from MIN_BODY characters on if it looks like text; else the snippet (50 characters) or the title stands in.
    """
    fit = F.coalesce((F.length(body) >= MIN_BODY) & text.looks_like_text(body), F.lit(False))
    short = text.trimmed(F.coalesce(snippet, F.lit("")))
    stand_in = F.when((F.length(short) >= 50) & text.looks_like_text(short), short).otherwise(title)
    return [
        text.strip_publisher_suffix(title, publisher).alias("title"), F.when(fit, body).otherwise(stand_in).alias("text"), topic.alias("topic_source"), date.alias("publish_date"), url.alias("url"),
        F.coalesce(publisher, F.lit("")).alias("publisher"), F.coalesce(publisher_url, F.lit("")).alias("publisher_url"), (urls.publisher_domain(url) != "").alias("url_resolved"), fit.alias("body_available"),
    ]


def is_usable_candidate(title: Column, snippet: Column, body: Column) -> Column:
    """English by title, snippet and the beginning of a body that looks like text."""
    b = F.when(text.looks_like_text(body), F.substring(F.coalesce(body, F.lit("")), 1, 2000)).otherwise("")
    return text.is_probably_english(F.concat_ws(" ", title, F.coalesce(snippet, F.lit("")), b))


def quality_report(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """One row: documents, resolved_share, known_share, body_share, median_body_chars, n_sources, aggregator_rows.

    columns: names of url, publisher_url, publisher, text and body_available where they differ; a missing
    body_available is inferred from the length of the text. An empty table gives zeros. The exact median comes from
    the counts of each length, so no row list is held.
    """
    name = {c: c for c in ("url", "publisher_url", "publisher", "text", "body_available")} | (columns or {})
    has = lambda c: name[c] in df.columns
    get = lambda c: F.col(name[c]) if has(c) else F.lit(None).cast("string")
    length = F.length(F.coalesce(get("text"), F.lit("")))
    body = F.coalesce(get("body_available"), F.lit(False)) if has("body_available") else (length >= MIN_BODY) & ~F.coalesce(get("text"), F.lit("")).contains(fixed.STUB_MARKER)
    rows = df.select(
        (urls.publisher_domain(get("url"), get("publisher_url")) != "").alias("resolved"), urls.source_identity(get("url"), get("publisher_url"), get("publisher")).alias("source"), body.alias("body"), length.alias("chars")
    )
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 4)
    return rows.agg(
        F.count(F.lit(1)).alias("documents"), share(F.col("resolved")).alias("resolved_share"), share(F.col("source") != "").alias("known_share"), share(F.col("body")).alias("body_share"),
        F.coalesce(F.percentile("chars", 0.5), F.lit(0.0)).cast("int").alias("median_body_chars"), F.count_distinct(F.when(F.col("source") != "", F.col("source"))).alias("n_sources"),
        F.coalesce(F.sum((~F.col("resolved")).cast("int")), F.lit(0)).cast("bigint").alias("aggregator_rows"),
    )


def quality_warnings(report: DataFrame) -> DataFrame:
    """The report with ``warnings``: shares of known sources and of bodies below one half."""
    percent = lambda c: F.concat(F.round(100 * F.col(c)).cast("int").cast("string"), F.lit("%"))
    some = F.col("documents") > 0
    sources = F.when(some & (F.col("known_share") < 0.5), F.concat(F.lit("few identifiable publishers: "), percent("known_share")))
    bodies = F.when(some & (F.col("body_share") < 0.5), F.concat(F.lit("few bodies: "), percent("body_share")))
    return report.withColumn("warnings", F.array_compact(F.array(sources, bodies)))
