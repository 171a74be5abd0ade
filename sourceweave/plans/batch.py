"""The whole way of a batch: corpus, dedup, vectors, topics, labels, time, evidence, scores and the export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave import shared
from sourceweave.functions import fixed, scores, text, vectors
from sourceweave.hooks import Embedder, encode_once, hash_words
from sourceweave.operators import clusters, dedup, export, quality, timebins, topics
from sourceweave.plans.texts import _WS, _quoted
from sourceweave.sources import tables
from sourceweave.streaming.model import adaptive_k


@dataclass(frozen=True)
class Batch:
    """What a batch leaves: the corpus with topics, their names and counts, counts over time, the topics' nodes, the export and the agreement of all pairs of articles."""

    corpus: DataFrame
    names: DataFrame
    counts: DataFrame
    over_time: DataFrame
    nodes: DataFrame
    document: DataFrame
    agreement: DataFrame


@dataclass(frozen=True)
class Enrichment:
    """What a batch asks of the caller's models, each of an article's first 512 characters; without a model there is no value.

    sentiment: a struct of label and score; places: an array of names; summarise: a summary of a topic's first texts, null where the
    model has none (the extractive one then stands in); phrases: how many key phrases an article gets from the embedder.
    """

    sentiment: Callable[[Column], Column] | None = None
    places: Callable[[Column], Column] | None = None
    summarise: Callable[[Column], Column] | None = None
    phrases: int = 0


def enriched(rows: DataFrame, how: Enrichment, embed: Embedder, key: str = "ord", vector: str = "embedding") -> DataFrame:
    """``rows`` with sentiment, sentiment_score, sentiment_value, keyphrases and locations (both comma-joined)."""
    short = text.short(F.col("text"))
    null = lambda kind: F.lit(None).cast(kind)
    told = rows.withColumn("_s", how.sentiment(short) if how.sentiment else null("struct<label: string, score: double>"))
    score = F.round("_s.score", 4)
    told = told.withColumns({"sentiment": F.col("_s.label"), "sentiment_score": score, "sentiment_value": F.when(score.isNotNull(), scores.signed_sentiment(F.col("_s.label"), score))}).drop("_s")
    told = told.withColumn("locations", F.array_join(F.array_distinct(how.places(short)), ", ") if how.places else null("string"))
    if not how.phrases:
        return told.withColumn("keyphrases", null("string"))
    found = topics.keyphrases(rows, key, "text", vector, embed, how.phrases).select(key, F.array_join("phrases", ", ").alias("keyphrases"))
    return told.join(found, key, "left")


#: Rows that a batch needs at least.
LEAST_ROWS = 6


def run_batch(
    corpus: DataFrame, embed: Embedder, threshold: float = 0.85, k: int | None = None, matrix_rows: int | None = None, stop_hosts: int = 0, generated_at: str = "", enrichment: Enrichment = Enrichment()
) -> Batch:
    """A batch over ``corpus`` (tables.CORPUS with ``ord``, a unique bigint) of LEAST_ROWS rows or more.

    Titles and near texts are deduplicated, the rest is clustered on the vectors of title and text. A topic's summary takes
    the best sentences of its first four bodies, or is the caller's model's; similarities are those of its vector. Agreement by article
    is the long table ``agreement`` (topic_id, i, j, cosine; i < j in ``ord``), worked out when it is read. The
    export's document shows it as a matrix in every topic, or, where ``matrix_rows`` is given, in topics of at most so many
    articles; a topic's score takes the mean agreement, which needs no pairs, in either case. Hosts are no topic terms: the
    ``stop_hosts`` most frequent ones are left out as literals, all others by a join.
    """
    spark = corpus.sparkSession
    usable = corpus.where("text is not null")
    if usable.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"a batch takes {LEAST_ROWS} rows with a text or more")
    once = dedup.keep_first(usable, ["title"], "ord").withColumn("clustering_text", topics.clustering_text(F.col("title"), F.col("text")))
    encoded = shared.stored(encode_once(once, "clustering_text", embed), "encoded")
    kept = shared.stored(dedup.semantic_first(encoded, "ord", "text", "embedding", threshold), "kept")
    clustered, _ = clusters.kmeans(kept, "embedding", k or adaptive_k(kept.count()))
    located = shared.stored(enriched(clustered.withColumnRenamed("topic", "topic_id"), enrichment, embed), "topics")
    hosts = located.select(F.regexp_extract("url", "://(?:www[.])?([^/.]+)", 1).alias("d")).where("d <> ''").groupBy("d").count()
    frequent = [r.d for r in hosts.orderBy(F.col("count").desc(), "d").limit(stop_hosts).collect()] if stop_hosts else []
    stop = topics.stop_words(tuple(frequent))
    others = hosts.select(F.lower("d").alias("word")).where((F.length("word") > 2) & ~F.col("d").isin(*frequent)).distinct()
    n_topics = (located.agg(F.max("topic_id")).first()[0] or 0) + 1
    terms = topics.term_counts(located, "topic_id", "clustering_text", stop, more=None if others.isEmpty() else others)
    named = topics.labels(topics.top_terms(topics.class_tfidf(terms, "topic_id", n_topics), "topic_id"), "topic_id", stop=stop).withColumnRenamed("label", "topic_name")
    assigned = located.join(F.broadcast(named), "topic_id", "left").withColumn("topic_name", F.coalesce("topic_name", F.concat("topic_id", F.lit("_cluster "), "topic_id")))
    first = shared.stored(export.first_texts(located, "topic_id", "ord"), "first-texts")
    summaries = topics.extractive_summaries(first, "topic_id", "text")
    if enrichment.summarise:
        models = first.select("topic_id", enrichment.summarise(F.substring("text", 1, 3000)).alias("_said"))
        summaries = summaries.join(models, "topic_id", "left").select("topic_id", F.coalesce(F.when(F.col("_said") != "", F.col("_said")), "summary").alias("summary"))
    summaries = shared.stored(summaries, "summaries")
    # a row a topic, at most n_topics of them: sent to all tasks
    centres = shared.stored(summaries.select("topic_id", embed(F.col("summary")).alias("centroid")), "centres")
    agreed = shared.stored(clusters.pairwise_coherence(located, "topic_id", "embedding").select("topic_id", "n", F.col("coherence").alias("mean_coherence")), "agreed")
    articles = assigned.join(F.broadcast(centres), "topic_id").withColumn("similarity", vectors.cosine(F.col("embedding"), F.col("centroid"))).drop("centroid").join(F.broadcast(agreed.drop("n")), "topic_id")
    shown = agreed if matrix_rows is None else agreed.where(F.col("n") <= matrix_rows)
    pairs = dedup.cosine_pairs(located.join(F.broadcast(shown.select("topic_id")), "topic_id", "left_semi"), "topic_id", "ord", "embedding")
    both = pairs.select(F.col("i").alias("ord"), F.col("j").alias("other"), "cosine").union(pairs.select("j", "i", "cosine"))
    rows = both.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "cosine"))), lambda x: x["cosine"]).alias("coherence"))
    articles = articles.withColumn("coherence", F.lit(None).cast("array<double>")) if matrix_rows == 0 else articles.join(rows, "ord", "left")
    nodes = export.topic_nodes(articles, "topic_id", "ord", summaries, "mean_coherence")
    over_time = timebins.topics_over_time(assigned.withColumn("_when", timebins.parse_date(F.col("publish_date"))), "_when", "topic_id")
    document = tables.envelope(nodes, quality.quality_report(assigned), "batch", generated_at)
    return Batch(assigned, named, clusters.topic_counts(assigned, "topic_id", n_topics), over_time, nodes, document, dedup.cosine_pairs(assigned, "topic_id", "ord", "embedding"))


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a corpus: the first line is the title, the source the publisher."""
    docs = tables.scan(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars")
    return docs.select(
        F.col("doc_id").alias("ord"), F.substring_index("text", "\n", 1).alias("title"), "text", F.lit("all").alias("topic_source"), F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd").alias("publish_date"),
        F.lit(None).cast("string").alias("url"), F.col("source").alias("publisher"), F.lit(None).cast("string").alias("publisher_url"), F.lit(False).alias("url_resolved"), (F.col("n_chars") >= 300).alias("body_available"),
    )


def batch_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch over the documents with hashed words for vectors: the topics of its export, read again.

    The document is asked for without matrices of agreement, at every size; the score has the mean agreement.
    """
    found = tables.read_export(run_batch(documents_corpus(spark, sf_dir), hash_words(64), matrix_rows=0).document)
    return found.select("ord", "topic", F.size("articles").alias("n"), "formulaBreakdown.finalScore", "formulaBreakdown.nDomains", F.length("intelligenceSummary").alias("summary_chars"))


def _letters(text_: Column) -> Column:
    """A vector that SQL can make as well: how often each of four letters occurs."""
    return F.array(*[text.count_of(F.lower(F.coalesce(text_, F.lit(""))), c).cast("double") for c in "aeio"])


def enriched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what a caller's models say of their beginnings: a tone by length, capitalised words as places."""
    docs = documents_corpus(spark, sf_dir)
    tone = lambda c: F.struct(F.when(F.length(c) % 2 == 0, "POSITIVE").otherwise("NEGATIVE").alias("label"), (F.length(c) / 1024).alias("score"))
    places = lambda c: F.regexp_extract_all(c, F.lit("[A-Z][a-z]{3,}"), F.lit(0))
    found = enriched(docs, Enrichment(tone, places), _letters)
    return found.select("ord", "sentiment", "sentiment_score", "sentiment_value", F.md5(F.col("locations").cast("binary")).alias("locations"), F.col("keyphrases").isNull().alias("no_phrases"))


SQL_ENRICHED = """
WITH s AS (SELECT doc_id AS ord, substr(text, 1, 512) AS t FROM documents), l AS (SELECT *, regexp_extract_all(t, '[A-Z][a-z]{3,}') AS w, CAST(floor(length(t) / 1024.0::DOUBLE * 10000 + 0.5) AS DOUBLE) / 10000 AS v FROM s)
SELECT ord, CASE WHEN length(t) % 2 = 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment, v AS sentiment_score, CASE WHEN length(t) % 2 = 0 THEN v ELSE -v END AS sentiment_value,
  md5(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ', ')) AS locations, true AS no_phrases FROM l
"""


def keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five phrases of each document that are nearest to its vector of hashed words: of its first 512 characters, as a model is shown."""
    docs = tables.scan(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.short(F.col("text")).alias("text"))
    embed = hash_words(64)
    found = topics.keyphrases(docs.withColumn("v", embed(F.col("text"))), "doc_id", "text", "v", embed)
    return found.select("doc_id", F.array_join("phrases", "|").alias("phrases"))


# a phrase of one word, or of two in one slot, points along that slot; one of two slots halfway between
SQL_PHRASES = rf"""
WITH remainders AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k) ORDER BY k) AS t FROM range(256) r(k)),
d AS (SELECT doc_id, lower(substr(text, 1, 512)) AS t FROM documents),
k AS (SELECT doc_id, list_filter(regexp_extract_all(t, '[\pL\pN\pM_]+'), lambda w: length(w) > 1 AND NOT list_contains([{_quoted(fixed.ENGLISH_STOP_WORDS)}], w)) AS w FROM d),
p AS (SELECT DISTINCT doc_id, unnest(list_concat(list_transform(w, lambda x: [x, NULL]), list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]))) AS pair FROM k),
b AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(t, '{_WS}+'), lambda x: regexp_replace(x, '^[.,;:!?()"'']+|[.,;:!?()"'']+$', '', 'g')), lambda x: x <> '')) AS word FROM d),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM b UNION SELECT pair[1] FROM p UNION SELECT pair[2] FROM p WHERE pair[2] IS NOT NULL)),
slots AS MATERIALIZED (SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) % 64 AS slot FROM words, remainders),
n AS MATERIALIZED (SELECT doc_id, slot, count(*) AS n FROM b JOIN slots USING (word) GROUP BY doc_id, slot),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM n GROUP BY doc_id),
s AS (
  SELECT p.doc_id, p.pair[1] || coalesce(' ' || p.pair[2], '') AS phrase,
    round(coalesce((coalesce(na.n, 0) + CASE WHEN sb.slot <> sa.slot THEN coalesce(nb.n, 0) ELSE 0 END) / l.len / CASE WHEN sb.slot <> sa.slot THEN sqrt(2) ELSE 1 END, 0), 9) AS near
  FROM p JOIN slots sa ON sa.word = p.pair[1] LEFT JOIN slots sb ON sb.word = p.pair[2] LEFT JOIN n na ON na.doc_id = p.doc_id AND na.slot = sa.slot LEFT JOIN n nb ON nb.doc_id = p.doc_id AND nb.slot = sb.slot LEFT JOIN l ON l.doc_id = p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY near DESC, encode(phrase)) AS k FROM s)
SELECT doc_id, string_agg(phrase, '|' ORDER BY k) AS phrases FROM r WHERE k <= 5 GROUP BY doc_id
"""


QUERIES = {f.__name__: f for f in (batch_export, enriched_rows, keyphrases)}
SQL = {"enriched_rows": SQL_ENRICHED, "keyphrases": SQL_PHRASES}
