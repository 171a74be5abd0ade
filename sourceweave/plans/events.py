"""Queries over ``events`` and ``pages``: time bins, windows, sentiment, drift, look-ups, HTML and the stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave import shared
from sourceweave.functions import scores, urls
from sourceweave.operators import dedup, export, quality, timebins, topics
from sourceweave.sources import feeds, html, tables
from sourceweave.streaming import model, update, windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def topics_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types over time, zero counts included."""
    found = timebins.topics_over_time(_events(spark, sf_dir), "ts", "event_type")
    return found.select("topic", "bin", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("middle"), "frequency")


SQL_OVER_TIME = """
WITH e AS (SELECT epoch_us(ts) AS u, event_type FROM events), b AS (SELECT min(u) AS low, max(u) AS high FROM e),
n AS (SELECT low, high, CASE WHEN (high - low) // 86400000000 > 7 THEN greatest(6, least(20, (high - low) // 86400000000 // 7)) ELSE 6 END AS bins FROM b),
c AS (SELECT least(bins - 1, greatest(0, CAST(ceil((u - low) / ((high - low) / bins::DOUBLE)) AS BIGINT) - 1)) AS bin, event_type, count(*) AS f FROM e, n GROUP BY ALL),
g AS (SELECT k AS bin, event_type, low, high, bins FROM n, range(20) r(k), (SELECT DISTINCT event_type FROM events) WHERE k < bins)
SELECT event_type AS topic, CAST(g.bin AS INTEGER) AS bin, strftime(make_timestamp(CAST(trunc(low + (g.bin + 0.5::DOUBLE) * ((high - low) / bins::DOUBLE)) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS middle, coalesce(f, 0) AS frequency FROM g LEFT JOIN c USING (bin, event_type)
"""


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of each event type."""
    found = windows.tumbling_counts(_events(spark, sf_dir), "ts", "event_type")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


SQL_TUMBLING = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user."""
    found = windows.session_counts(_events(spark, sf_dir), "ts", "user_id")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


SQL_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, session
"""


def sentiment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of positive, neutral and negative events of each type; an event's tone is its value less 50, in fiftieths."""
    events = _events(spark, sf_dir)
    label, _ = scores.sentiment(F.lit(None).cast("string"), (F.col("value") - 50) / 50, F.lit(None).cast("double"))
    shares = [c.alias(k) for k, c in scores.sentiment_shares(F.col("label")).items()]
    grouped = events.withColumn("label", label).groupBy("event_type").agg(*shares, F.round(F.avg((F.col("value") - 50) / 50), 6).alias("mean"))
    return grouped.select("event_type", "positive", "negative", "neutral", scores.mean_sentiment_label(F.col("mean")).alias("tone"))


SQL_SENTIMENT = """
WITH e AS (SELECT event_type, (value - 50) / 50 AS v FROM events),
s AS (SELECT event_type, CAST(floor(100.0::DOUBLE * count(*) FILTER (v > 0.2) / count(*) + 0.5) AS INTEGER) AS positive, CAST(floor(100.0::DOUBLE * count(*) FILTER (v < -0.2) / count(*) + 0.5) AS INTEGER) AS negative, round(avg(v), 6) AS mean FROM e GROUP BY event_type)
SELECT event_type, positive, negative, 100 - positive - negative AS neutral, CASE WHEN mean > 0.2 THEN 'Positive' WHEN mean < -0.2 THEN 'Negative' ELSE 'Neutral' END AS tone FROM s
"""


def drift_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last two hundred values drift from a baseline of 30."""
    found = model.drift_of(_events(spark, sf_dir).select("event_id", F.col("value").alias("distance")), "event_id", 30.0)
    return found.select("n", F.round("mean_recent", 6).alias("mean_recent"), "drifting")


SQL_DRIFT = "SELECT count(*) AS n, round(avg(value), 6) AS mean_recent, count(*) >= 20 AND avg(value) > 45 AS drifting FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 200)"

NEEDLES = ("topic src1", " TOPIC SRC12 ", "the topic src3 of today", "src", "nothing", "", "5")


def topic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic that each of some needles finds; topics are the documents' sources in order of appearance."""
    seen = dedup.first_appearance(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "doc_id")
    names = shared.stored(seen.select(F.col("nth").alias("ord"), F.concat(F.lit("Topic "), "source").alias("topic")), "names")
    found = [export.find_topic(names, n).select(F.lit(k).alias("needle"), "topic") for k, n in enumerate(NEEDLES)]
    return reduce(DataFrame.union, found)


SQL_LOOKUP = f"""
WITH t AS (SELECT row_number() OVER (ORDER BY first) - 1 AS ord, 'Topic ' || source AS topic FROM (SELECT source, min(doc_id) AS first FROM documents GROUP BY source)), q(needle, w) AS (VALUES {', '.join(f"({k}, '{n.strip().lower()}')" for k, n in enumerate(NEEDLES))}),
m AS (SELECT needle, topic, row_number() OVER (PARTITION BY needle ORDER BY CASE WHEN lower(topic) = w THEN 0 ELSE 1 END, ord) AS k FROM q, t WHERE w <> '' AND (contains(lower(topic), w) OR contains(w, lower(topic))))
SELECT needle, topic FROM m WHERE k = 1
"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page."""
    return html.extract_links(tables.scan(spark, sf_dir, "pages", "page_id", "url", "html"), "^https?://")


SQL_LINKS = r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) AS links FROM pages),
l AS (SELECT page_id, pos, string_split(CASE WHEN starts_with(link, '/') THEN site || link ELSE link END, '?')[1] AS link FROM (SELECT page_id, site, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM h)),
f AS (SELECT page_id, link, min(pos) AS pos FROM l WHERE regexp_matches(link, '^https?://') GROUP BY page_id, link)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS nth, link FROM f
"""


VERDICTS = ("False", " Mostly True ", "Mixture")


def claim_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews found in pages to which data has been added: an object, a list, a graph, something else first, no review, or no JSON."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rating = F.element_at(F.array(*map(F.lit, VERDICTS)), (F.col("page_id") % len(VERDICTS) + 1).cast("int"))
    node = F.to_json(
        F.struct(
            F.lit("ClaimReview").alias("@type"), F.concat(F.lit("<i>Claim</i>  &amp; "), "page_id").alias("claimReviewed"), F.struct(rating.alias("alternateName")).alias("reviewRating"),
            F.lit("2024-05-06T07:08").alias("datePublished"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://f.org/"), "page_id")).alias("url"), F.when(F.col("page_id") % 4 == 0, F.struct(F.lit(" Ann ").alias("name"))).alias("author"),
        )
    )
    other = F.lit('{"@type": "NewsArticle", "headline": "ClaimReview"}')
    kind = F.col("page_id") % 6
    told = F.when(kind == 0, node).when(kind == 1, F.concat(F.lit("["), other, F.lit(", 7, "), node, F.lit("]"))).when(kind == 2, F.concat(F.lit('{"@graph": ['), other, F.lit(","), node, F.lit("]}"))).when(kind == 3, other).when(kind == 4, F.lit("ClaimReview {"))
    script = lambda c: F.concat(F.lit("<script type='application/ld+json'>"), c, F.lit("</script>"))
    added = F.concat("html", script(F.coalesce(told, other)), F.when(kind == 5, script(node)).otherwise(""))
    return html.extract_reviews(pages.withColumn("html", added))


SQL_REVIEWS = f"""
SELECT page_id, 'Claim & ' || page_id AS claim, trim([{', '.join(repr(v) for v in VERDICTS)}][page_id % {len(VERDICTS)} + 1]) AS rating, '2024-05-06' AS date, CASE WHEN page_id % 2 = 0 THEN 'https://f.org/' || page_id ELSE url END AS url,
  CASE WHEN page_id % 4 = 0 THEN 'Ann' ELSE '' END AS author FROM pages WHERE page_id % 6 IN (0, 1, 2, 5)
"""

DATES = ("Fri, 01 Mar 2024 08:15:00 GMT", "2023-03-01", "2025-12-31T23:59:59", "5 May 2024", "Mon, 1 Jan 2024 00:00:00 +0200")


def feed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of feeds made from the pages: three items each, of different dates, the second with more to say than its title."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")

    def item(k: int):
        date = F.element_at(F.array(*map(F.lit, DATES)), ((F.col("page_id") + k) % len(DATES) + 1).cast("int"))
        more = F.lit(" More to say &amp;amp; do") if k == 1 else F.lit("")
        return F.concat(
            F.lit("<item><title><![CDATA[Page "), "page_id", F.lit(f" part {k} - Reuters]]></title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><pubDate>"), date, F.lit("</pubDate><description>&lt;b&gt;Page "), "page_id",
            F.lit(f" part {k}&lt;/b&gt;"), more, F.lit(' Reuters</description><source url="https://www.reuters.com">Reuters</source></item>'),
        )

    return feeds.parse_feed(pages.withColumn("xml", F.concat(F.lit("<rss>"), item(0), item(1), item(2), F.lit("</rss>"))), keep=("page_id",))


SQL_FEEDS = """
WITH i AS (SELECT page_id, url, k, (page_id + k) % 5 AS d FROM pages, range(3) r(k))
SELECT page_id, CAST(k AS INTEGER) AS nth, 'Page ' || page_id || ' part ' || k || ' - Reuters' AS title, url, ['2024-03-01', '', '2025-12-31', '2024-05-05', '2023-12-31'][d + 1] AS date,
  CASE WHEN k = 1 THEN 'Page ' || page_id || ' part 1 More to say & do Reuters' ELSE '' END AS snippet, 'Reuters' AS publisher, 'https://www.reuters.com' AS publisher_url FROM i WHERE d NOT IN (1, 4)
"""


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses inside redirects made from the pages; some carry none, some are cut, some are no redirects."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    coded = lambda c: F.translate(F.base64(c.cast("binary")), "+/=\r\n", "-_")
    kind = F.col("page_id") % 5
    inside = F.when(kind == 0, coded(F.concat(F.lit("\x08\x13\xa4"), F.lit(" "), "url"))).when(kind == 1, coded(F.concat(F.lit("no address "), "page_id"))).when(kind == 2, F.lit("!not base64!")).otherwise(coded(F.concat(F.lit("AU_y~"), "url", F.lit(" \x01"))))
    link = F.when(kind == 4, F.concat(F.lit("https://news.google.com/topics/"), inside)).otherwise(F.concat(F.lit("https://news.google.com/rss/articles/"), inside, F.lit("?oc=5")))
    return pages.select("page_id", urls.decode_redirect(link).alias("url"))


SQL_REDIRECTS = r"""
WITH p AS (SELECT page_id, page_id % 5 AS k, url FROM pages), c AS (SELECT *, replace(replace(replace(to_base64(encode(CASE WHEN k = 1 THEN 'no address ' || page_id ELSE 'AU_y~' || url || ' ' || chr(1) END)), '+', '-'), '/', '_'), '=', '') AS inside FROM p)
SELECT page_id, CASE WHEN k IN (0, 3) THEN regexp_extract(url, '^[a-zA-Z0-9.\-_~:/?#\[\]@!$&''()*+,;=%]+') WHEN k = 1 THEN 'https://news.google.com/rss/articles/' || inside || '?oc=5' WHEN k = 2 THEN 'https://news.google.com/rss/articles/!not base64!?oc=5'
  ELSE 'https://news.google.com/topics/' || inside END AS url FROM c
"""


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of the documents by language as one JSON document, read again: a row a topic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    topic = (1000 * F.ascii("lang") + F.ascii(F.substring("lang", 2, 1))).cast("int")
    rows = docs.select(
        topic.alias("topic_id"), "doc_id", F.concat(topic.cast("string"), F.lit("_language_"), "lang").alias("topic_name"), F.substring("text", 1, 60).alias("title"), "text", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("publisher_url"), F.col("source").alias("publisher"), F.lit("2024-01-02T00:00").alias("publish_date"), F.lit(True).alias("body_available"), F.lit(None).cast("string").alias("sentiment"),
        (F.col("doc_id") % 5 / 10).alias("sentiment_value"), F.lit(None).cast("double").alias("sentiment_score"), (1 / (F.col("doc_id") + 2)).alias("similarity"), F.lit(None).cast("array<double>").alias("coherence"),
        F.lit(None).cast("string").alias("keyphrases"), F.lit(None).cast("string").alias("locations"),
    )
    summaries = topics.extractive_summaries(export.first_texts(rows, "topic_id", "doc_id"), "topic_id", "text")
    nodes = export.topic_nodes(rows, "topic_id", "doc_id", summaries)
    document = tables.envelope(nodes, quality.quality_report(rows), "batch", "2024-01-03T00:00:00")
    return tables.read_export(document).select("ord", "topic", "topicName", F.size("articles").alias("n"), "formulaBreakdown.finalScore", "formulaBreakdown.nDomains", F.array_join("keywords", ",").alias("keywords"))


SQL_EXPORT = """
WITH d AS (SELECT 1000 * ascii(lang) + ascii(substr(lang, 2, 1)) AS topic_id, lang, source, 1.0::DOUBLE / (doc_id + 2) AS s, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
t AS (SELECT topic_id, lang, count(*) AS n, count(DISTINCT source) AS ns, avg(s) FILTER (k <= 3) AS top FROM d GROUP BY topic_id, lang)
SELECT CAST(row_number() OVER (ORDER BY topic_id) - 1 AS INTEGER) AS ord, 'Language ' || upper(substr(lang, 1, 1)) || substr(lang, 2) AS topic, topic_id || '_language_' || lang AS "topicName", CAST(n AS INTEGER) AS n,
  CAST(least(99, greatest(5, trunc((30 + 70 * top) * CASE WHEN ns >= 5 THEN 1.0 WHEN ns = 4 THEN 0.95 WHEN ns = 3 THEN 0.85 WHEN ns = 2 THEN 0.72 ELSE 0.6 END::DOUBLE * 0.85::DOUBLE))) AS INTEGER) AS "finalScore",
  CAST(ns AS INTEGER) AS "nDomains", 'language,' || lang AS keywords
FROM t
"""


def stream_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the vectors, folded in by a stream in three arrivals."""
    return folded(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def folded(spark: SparkSession, sf_dir: str, arrivals: int = 3) -> DataFrame:
    """The corpus that a stream leaves of the vectors; rows arrive by the remainder of their number, a batch an arrival."""
    rows = vector_rows(spark, sf_dir)
    path = shared.scratch_path(spark, "stream")
    updater = update.Updater(f"{path}/state")
    for k in range(arrivals):
        rows.where(F.col("ord") % arrivals == k).write.mode("append").parquet(f"{path}/in")
        updater.run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/checkpoint")
    return updater.corpus(spark)


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as rows of a corpus; every tenth repeats the url of the row at half its number, so repeats grow with the table."""
    own = F.when(F.col("vec_id") % 10 == 1, F.expr("vec_id div 2")).otherwise(F.col("vec_id"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("ord"), F.concat(F.lit("u"), own).alias("url"), F.concat(F.lit("t"), "vec_id").alias("title"), F.concat(F.lit("word"), F.col("label"), F.lit(" topic"), F.col("vec_id") % 13).alias("text"), "embedding"
    )


QUERIES = {
    f.__name__: f
    for f in (topics_over_time, tumbling_counts, session_counts, sentiment_split, drift_status, topic_lookup, page_links, claim_reviews, feed_candidates, redirects, export_json, stream_update)
}
SQL = {
    "topics_over_time": SQL_OVER_TIME, "tumbling_counts": SQL_TUMBLING, "session_counts": SQL_SESSIONS, "sentiment_split": SQL_SENTIMENT, "drift_status": SQL_DRIFT, "topic_lookup": SQL_LOOKUP,
    "page_links": SQL_LINKS, "claim_reviews": SQL_REVIEWS, "feed_candidates": SQL_FEEDS, "redirects": SQL_REDIRECTS, "export_json": SQL_EXPORT,
}
