"""The nested export of topics, its look-up, and the text dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.functions import scores, text, urls, vectors


def article_nodes(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, article): the export's node of each row.

    rows: title, text, url, publisher_url, publisher, publish_date, body_available, sentiment, sentiment_value,
    sentiment_score, similarity and coherence (agreement with the other rows, null without evidence).
    """
    domain = urls.source_identity(F.col("url"), F.col("publisher_url"), F.col("publisher"))
    publisher = F.coalesce("publisher", F.lit(""))
    shown = F.when((domain == "") | domain.startswith("name:"), publisher).otherwise(domain)
    label, value = scores.sentiment(F.col("sentiment"), F.col("sentiment_value"), F.col("sentiment_score"))
    node = F.struct(
        F.coalesce("title", F.lit("Untitled Article")).alias("title"), F.substring(F.coalesce("text", F.lit("")), 1, 240).alias("snippet"), F.coalesce("url", F.lit("")).alias("url"),
        F.when(shown == "", "unresolved-source").otherwise(shown).alias("source"), domain.alias("sourceKey"), publisher.alias("publisher"), (domain != "").alias("urlResolved"),
        F.col("body_available").alias("bodyAvailable"), F.coalesce(F.substring("publish_date", 1, 10), F.lit("")).alias("pubDate"), label.alias("sentiment"), value.alias("sentimentScore"),
        F.col("similarity").alias("similarityToSummary"), F.coalesce("coherence", F.array().cast("array<double>")).alias("coherenceScores"),
    )
    return rows.select(key, order, node.alias("article"), domain.alias("domain"))


def first_texts(rows: DataFrame, key: str, order: str, n: int = 4) -> DataFrame:
    """(key, text): the first ``n`` texts of each topic, of rows with a body where it has any."""
    has = F.coalesce("body_available", F.lit(False))
    rank = Window.partitionBy(key).orderBy(F.col("_has").desc(), order)
    # only the rank is asked of the window, so each task cuts its rows to n a topic before any text is shuffled
    first = rows.select(key, order, "text", has.alias("_has")).withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= n)
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "_has", "text"))).alias("_all"))
    fit = F.filter("_all", lambda x: (x["_has"] | ~F.col("_all")[0]["_has"]) & x["text"].isNotNull())
    return listed.where(F.size(fit) > 0).select(key, F.array_join(F.transform(fit, lambda x: x["text"]), " ").alias("text"))


def listed(column: Column) -> Column:
    """Trimmed, distinct, sorted items of comma-joined strings in an aggregate."""
    items = F.flatten(F.transform(F.collect_set(column), lambda s: F.split(s, ",")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")))


def topic_nodes(rows: DataFrame, key: str, order: str, summaries: DataFrame, coherence: str | None = None) -> DataFrame:
    """A row a topic (-1 and null left out): topic, topicName, intelligenceSummary, keywords, locations, articles, formulaBreakdown.

    rows as for :func:`article_nodes`, with topic_name, keyphrases and locations; summaries: (key, summary). coherence names a
    column with the topic's mean agreement for topics without rows of agreement. A topic becomes one document, so
    export-sized topics are meant, not corpora.
    """
    own = rows.where(F.col(key).isNotNull() & (F.col(key) != -1))
    nodes = article_nodes(own, key, order).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "article", "domain"))), lambda x: F.struct(x["article"].alias("article"), x["domain"].alias("domain"))).alias("all"))
    mean = F.max(coherence) if coherence else F.lit(None).cast("double")
    facts = own.groupBy(key).agg(mean.alias("agreed"), F.min_by("topic_name", order).alias("topicName"), listed(F.col("keyphrases")).alias("keys"), listed(F.col("locations")).alias("places"))
    joined = nodes.join(facts, key).join(summaries, key, "left")
    articles = F.transform("all", lambda x: x["article"])
    domains = F.transform("all", lambda x: x["domain"])
    upper = vectors.triangle_of_others(F.transform("all", lambda x: x["article"]["coherenceScores"]))
    sims = F.filter(F.transform("all", lambda x: x["article"]["similarityToSummary"]), lambda s: s.isNotNull())
    parts = scores.score_arrays(sims, domains, F.when((F.size(upper) == 0) & F.col("agreed").isNotNull(), F.array("agreed")).otherwise(upper))
    words = F.filter(F.slice(F.split("topicName", "_"), 2, 1000), lambda w: w != "")
    keywords = F.when(F.size("keys") > 0, F.col("keys")).when(F.size(words) > 0, words).otherwise(F.array(F.lit("OSINT")))
    breakdown = F.struct(
        parts["final_score"].alias("finalScore"), F.round(parts["semantic_score"], 2).alias("semanticScore"), F.round(parts["avg_similarity"], 4).alias("avgSimilarity"), parts["source_factor"].alias("domainFactor"),
        parts["n_sources"].alias("nDomains"), parts["sources"].alias("domains"), F.round(parts["coherence_factor"], 4).alias("coherenceFactor"), F.round(parts["source_coherence"], 4).alias("sourceCoherence"),
    )
    return joined.select(
        F.col(key), text.clean_topic_title(F.col("topicName")).alias("topic"), "topicName", F.coalesce("summary", F.lit("No articles available for this cluster.")).alias("intelligenceSummary"),
        keywords.alias("keywords"), F.when(F.size("places") > 0, F.col("places")).otherwise(F.array(F.lit("Global"))).alias("locations"), articles.alias("articles"), breakdown.alias("formulaBreakdown"),
    )


#: Topics that a page shows at first.
SHOWN_TOPICS = 10


def first_topics(topics: DataFrame, order: str = "ord", n: int = SHOWN_TOPICS) -> DataFrame:
    """The first ``n`` topics of an export, what its page shows."""
    return topics.orderBy(order).limit(n)


def find_topic(topics: DataFrame, needle: str, name: str = "topic", order: str = "ord") -> DataFrame:
    """At most one row: the topic of that name in any case, else the first of which one contains the other."""
    wanted = needle.strip().lower()
    low = F.lower(name)
    kind = F.when(low == wanted, 0).when(low.contains(wanted) | F.lit(wanted).contains(low), 1)
    ranked = topics.withColumn("_kind", kind).where(F.col("_kind").isNotNull() & F.lit(bool(wanted)))
    return ranked.orderBy("_kind", order).limit(1).drop("_kind")


def dossier(topics: DataFrame, key: str) -> DataFrame:
    """(key, entry): the text of each topic of two rows or more.

    topics: topic, n, mean_sentiment, final_score, sources (array), summary, keywords, places.
    """
    sign = scores.mean_sentiment_label(F.col("mean_sentiment"))
    named = F.array_join(F.slice("sources", 1, 8), ", ")
    lines = [
        F.concat(F.lit("SUBJECT: "), F.col("topic")),
        F.format_string("SENTIMENT: %s (Score: %s) | CORROBORATION: %s/100 %s", sign, F.round("mean_sentiment", 2).cast("string"), F.col("final_score").cast("string"), F.when(F.col("final_score") > 70, "ok").otherwise("review")),
        F.format_string("CONSENSUS: %s (%s sources: %s)", scores.consensus(F.size("sources")), F.size("sources").cast("string"), named),
        F.lit("-" * 50), F.col("summary"), F.lit(""), F.concat(F.lit("KEYWORDS: "), F.col("keywords")), F.concat(F.lit("PLACES: "), F.col("places")), F.concat(F.lit("SOURCES: "), named), F.lit("=" * 50),
    ]
    return topics.where("n >= 2").select(key, F.concat_ws("\n", *lines).alias("entry"))


def report_html(topics: DataFrame) -> DataFrame:
    """(topic, reference, html): a printable report of each topic of an export.

    Everything that comes from outside is escaped, addresses other than http(s) become `#`, snippets of more than 200
    characters are cut.
    """
    safe = lambda c: text.escape_html(c.cast("string"))
    score = F.col("formulaBreakdown")
    band = F.when(score.isNull(), "not scored").otherwise(scores.confidence(score["finalScore"]))

    def article(a: Column) -> Column:
        snippet = F.when(F.length(a["snippet"]) > 200, F.concat(F.substring(a["snippet"], 1, 197), F.lit("..."))).otherwise(a["snippet"])
        address = safe(urls.safe_href(a["url"]))
        return F.concat(F.lit('<li><a href="'), address, F.lit('">'), safe(a["title"]), F.lit("</a> <i>"), safe(a["source"]), F.lit("</i> "), safe(a["pubDate"]), F.lit("<p>"), safe(snippet), F.lit("</p></li>"))

    reference = text.report_reference(F.col("topic"))
    body = F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), safe(F.col("topic")), F.lit("</title></head><body><h1>"), safe(F.col("topic")), F.lit("</h1><p>"), safe(reference),
        F.lit("</p><p>Score "), F.coalesce(score["finalScore"].cast("string"), F.lit("-")), F.lit(" ("), band, F.lit("), "), scores.consensus(F.coalesce(score["nDomains"], F.lit(0))), F.lit("</p><p>"),
        safe(F.col("intelligenceSummary")), F.lit("</p><p>"), safe(F.array_join("keywords", ", ")), F.lit("</p><ol>"), F.array_join(F.transform("articles", article), ""), F.lit("</ol></body></html>"),
    )
    return topics.select("topic", reference.alias("reference"), body.alias("html"))
