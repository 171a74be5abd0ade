"""Queries over sources and sinks: candidates, hits, bodies, rows of a corpus, files out and in again, documents for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave import hooks, shared
from sourceweave.functions import fixed, scores, text, urls
from sourceweave.operators import claims, dedup, export, quality, rivals, timebins, topics
from sourceweave.plans.study import vector_bundles
from sourceweave.plans.texts import CUES, RATINGS, _bordered, _count, _cut_sql, _docs, _english, _looks, _quoted, _INFORMATIVE, _SENTENCES, _WS
from sourceweave.sources import feeds, html, search, tables


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan(spark, sf_dir, "pages", "page_id", "url", "html")


def tiered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three tiers of candidates for each language and source the rows of the first that has any."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat_ws("/", "lang", "source").alias("topic"), (1 + F.col("doc_id") * 7 % 3).cast("int").alias("tier"))
    return feeds.first_tier(docs).select("doc_id", "topic", "tier")


SQL_TIERS = """
WITH c AS (SELECT doc_id, lang || '/' || source AS topic, CAST(1 + doc_id * 7 % 3 AS INTEGER) AS tier FROM documents)
SELECT doc_id, topic, tier FROM c JOIN (SELECT topic, min(tier) AS tier FROM c GROUP BY topic) USING (topic, tier)
"""

HITS = 50


def answers(topic: str, limit: int):
    """What a search engine might say: one row more than is asked for."""
    for k in range(limit + 1):
        yield {"title": f"{topic} {k}", "url": f"https://x.org/{topic}/{k}", "date": f"2024-01-{1 + k % 28:02d}", "snippet": None if k % 2 else topic.upper(), "publisher": "X"}


def searched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven answers of a search for each language."""
    topics = sorted(r.lang for r in _docs(spark, sf_dir).select("lang").distinct().collect())  # what a job is asked for
    return search.searched(spark, topics, "sourceweave.plans.ingest:answers", 7)


SQL_SEARCHED = """
SELECT lang AS topic, lang || ' ' || k AS title, 'https://x.org/' || lang || '/' || k AS url, printf('2024-01-%02d', 1 + k) AS date, CASE WHEN k % 2 = 0 THEN upper(lang) END AS snippet, 'X' AS publisher, CAST(NULL AS VARCHAR) AS publisher_url
FROM (SELECT DISTINCT lang FROM documents), range(7) r(k)
"""


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty usable hits of a search whose answers are the documents, some without an address or of another age."""
    docs = _docs(spark, sf_dir)
    rows = docs.select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("https://x.org/"), "doc_id")).alias("url"),
        F.when(F.col("doc_id") % 5 > 0, "2024-06-01").otherwise("2023-06-01").alias("date"), F.substring("text", 1, F.lit(20) + (F.col("doc_id") % 60).cast("int")).alias("snippet"), F.col("text").alias("body"),
    )
    return feeds.search_hits(rows, HITS, "doc_id").select("doc_id", "title", "date")


SQL_HITS = f"""
WITH r AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, substr(text, 1, CAST(20 + doc_id % 60 AS INTEGER)) AS snippet, text AS body FROM documents WHERE doc_id % 7 > 0 AND doc_id % 5 > 0),
s AS (SELECT doc_id, title, concat_ws(' ', title, snippet, CASE WHEN {_looks('body')} THEN substr(body, 1, 2000) END) AS sample FROM r WHERE length(body) >= 300 OR length(snippet) >= 50)
SELECT doc_id, title, '2024-06-01' AS date FROM s WHERE {_english('sample')} ORDER BY doc_id LIMIT {HITS}
"""


def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty links of all pages that are fit for hits, none of example.org itself."""
    links = html.extract_titled_links(_pages(spark, sf_dir)).withColumn("n", F.col("page_id") * 1000 + F.col("nth"))
    return feeds.page_hits(links, "example.org", HITS, "n").select("n", "title", "url")


SQL_PAGE_HITS = rf"""
WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS a, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages),
l AS (SELECT page_id, site, unnest(a) AS a, unnest(t) AS t, unnest(range(len(a))) AS nth FROM h),
d AS (SELECT page_id * 1000 + nth AS n, site || replace(replace(a, '&quot;', '"'), '&amp;', '&') AS url, trim(regexp_replace(replace(replace(t, '&quot;', '"'), '&amp;', '&'), '{_WS}+', ' ', 'g')) AS title FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n) AS k FROM d WHERE length(title) >= 12 AND NOT ends_with(regexp_extract(url, '://([^/:?#]+)', 1), 'example.org'))
SELECT n, title, url FROM k WHERE k = 1 ORDER BY n LIMIT {HITS}
"""


def _lines(expression: str) -> str:
    """SQL of the text lines of markup: block elements break lines, other tags go."""
    broken = f"regexp_replace({expression}, '</?(title|h1|p|br|ul|li|div|article|main|hr|td|tr|table|pre|section)( [^>]*)?/?>', chr(10), 'g')"
    plain = f"regexp_replace(regexp_replace({broken}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    told = f"replace(replace(replace(replace({plain}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
    return f"array_to_string(list_filter(list_transform(string_split({told}, chr(10)), lambda l: trim(regexp_replace(l, '{_WS}+', ' ', 'g'))), lambda l: l <> ''), chr(10))"


def _clean(expression: str) -> str:
    """SQL of text.clean_text."""
    kept = f"list_filter(string_split({expression}, chr(10)), lambda l: l <> '' AND NOT list_contains([{_quoted(fixed.BOILERPLATE_LINES)}], lower(l)))"
    return f"trim(regexp_replace(array_to_string(list_filter(list_transform({kept}, lambda l: trim({_cut_sql('l')})), lambda l: l <> ''), ' '), '{_WS}+', ' ', 'g'))"


def _consent(expression: str) -> str:
    return " OR ".join(f"contains(lower(substr({expression}, 1, 3000)), '{m}')" for m in fixed.CONSENT_TEXTS)


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned text of each page: its article, or all of it where that is short."""
    return html.extract_bodies(_pages(spark, sf_dir))


SQL_HTML = rf"""
WITH h AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article, regexp_replace(html, '(?s)<(nav|footer|style|script)>.*?</(nav|footer|style|script)>', '', 'g') AS page FROM pages),
l AS (SELECT page_id, url, {_lines('article')} AS main, {_lines('page')} AS raw FROM h),
c AS (SELECT page_id, url, CASE WHEN length(main) >= 300 AND ({_looks('main')}) AND NOT ({_consent('main')}) THEN main ELSE raw END AS chosen FROM l),
b AS (SELECT page_id, url, {_clean('chosen')} AS body, ({_consent('chosen')}) AS wall FROM c)
SELECT page_id, url, CASE WHEN wall THEN '' ELSE body END AS body, NOT wall AND length(body) >= 300 AND ({_looks('body')}) AS body_available FROM b
"""


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV, odd ones appended once more, and read again: quotes, line breaks and blanks stay, control characters go."""
    docs = _docs(spark, sf_dir)
    made = docs.select(
        F.concat(F.lit(' "T" '), "doc_id").alias("title"), F.concat("text", F.lit('\x01"q", x\ny \x0b')).alias("text"), F.col("source").alias("topic_source"),
        *[F.lit(None).cast("string").alias(c) for c in ("publish_date", "url", "publisher", "publisher_url")], (F.col("doc_id") % 2 == 0).alias("url_resolved"), F.lit(None).cast("boolean").alias("body_available"),
    )
    path = shared.scratch_path(spark, "csv")
    tables.write_csv(made, path, "overwrite")
    tables.write_csv(made.where("not url_resolved"), path)
    return tables.read_csv(spark, path).groupBy("title", "topic_source", "url_resolved").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5(F.col("text").cast("binary"))).alias("low"), F.max(F.md5(F.col("text").cast("binary"))).alias("high"))


SQL_CSV = r"""
WITH r AS (SELECT ' "T" ' || doc_id AS title, source AS topic_source, doc_id % 2 = 0 AS url_resolved, md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') || '"q", x' || chr(10) || 'y ') AS m FROM documents)
SELECT title, topic_source, url_resolved, CAST(CASE WHEN url_resolved THEN 1 ELSE 2 END AS BIGINT) AS n, m AS low, m AS high FROM r
"""


def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of vectors written as one JSON document a file, read again for the evaluation split, and counted from their articles."""
    path = shared.scratch_path(spark, "bundles")
    tables.count_articles(vector_bundles(spark, sf_dir)).withColumn("file", F.col("claim_id")).write.partitionBy("file").json(path)
    read = tables.read_bundles(spark, path, "evaluation").drop("n_articles", "n_domains", "n_debunk")
    return tables.count_articles(read).select("claim_id", "n_articles", "n_domains", "n_debunk", F.size("similarities").alias("n_similarities"))


SQL_BUNDLES = """
SELECT printf('C%05d', b) AS claim_id, CAST(count(*) AS INTEGER) AS n_articles, CAST(count(DISTINCT v * v % 7) AS INTEGER) AS n_domains, CAST(count(*) FILTER (v % 11 = 0) AS INTEGER) AS n_debunk, CAST(count(*) AS INTEGER) AS n_similarities
FROM (SELECT vec_id AS v, vec_id // 8 AS b FROM embeddings) WHERE b % 5 >= 3 GROUP BY b HAVING count(*) >= 2
"""


def resume_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics (source and day) that a checkpoint of every third document lacks."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat_ws(" ", "source", F.col("doc_id") % 60).alias("topic_source"))
    return tables.resume(docs.select("topic_source").distinct(), docs.where("doc_id % 3 = 0"))


SQL_RESUME = """
WITH d AS (SELECT doc_id, source || ' ' || doc_id % 60 AS topic_source FROM documents)
SELECT DISTINCT topic_source FROM d WHERE topic_source NOT IN (SELECT topic_source FROM d WHERE doc_id % 3 = 0)
"""

ROW_URLS = ("https://news.google.com/rss/x", "https://www.reuters.com//world//a", "https://consent.google.com/m?x=1", "http://a.com/b//c")


def assembled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a corpus made of candidates and their bodies, a fourth of them without one, with the guards that each passes."""
    docs = _docs(spark, sf_dir)
    url = F.element_at(F.array(*map(F.lit, ROW_URLS)), (F.col("doc_id") % len(ROW_URLS) + 1).cast("int"))
    rows = docs.select(
        "doc_id", F.concat(F.lit("Headline "), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, " - Reuters").otherwise(" - Nobody")).alias("title"), url.alias("url"), F.substring("text", 1, F.lit(30) + (F.col("doc_id") % 60).cast("int")).alias("snippet"),
        F.when(F.col("doc_id") % 4 > 0, F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("We, Yahoo, are part of it. "), "text")).otherwise(F.col("text"))).alias("body"),
    )
    own = quality.assemble_row(F.lit("topic"), F.col("title"), F.col("url"), F.lit("2024-01-01"), F.col("snippet"), F.lit("Reuters"), F.lit(None).cast("string"), F.col("body"))
    found = rows.select(
        "doc_id", *own, quality.is_usable_candidate(F.col("title"), F.col("snippet"), F.col("body")).alias("usable"), text.is_consent_url(F.col("url")).alias("consent_url"),
        text.is_consent_text(F.col("body")).alias("consent_text"), text.single_slashes(F.col("url")).alias("plain_url"),
    )
    return found.withColumn("text", F.md5(F.col("text").cast("binary")))


SQL_ROWS = f"""
WITH r AS (SELECT doc_id, 'Headline ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' - Reuters' ELSE ' - Nobody' END AS title, 'Headline ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' - Nobody' END AS shown,
  [{_quoted(ROW_URLS)}][doc_id % {len(ROW_URLS)} + 1] AS url, substr(text, 1, CAST(30 + doc_id % 60 AS INTEGER)) AS snippet, CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 9 = 0 THEN 'We, Yahoo, are part of it. ' || text ELSE text END END AS body FROM documents),
f AS (SELECT *, coalesce(length(body) >= 300 AND ({_looks('body')}), false) AS fit, regexp_replace(regexp_replace(snippet, '^{_WS}+', ''), '{_WS}+$', '') AS short FROM r),
s AS (SELECT *, concat_ws(' ', title, snippet, CASE WHEN {_looks("coalesce(body, '')")} THEN substr(body, 1, 2000) ELSE '' END) AS sample FROM f)
SELECT doc_id, shown AS title, md5(CASE WHEN fit THEN body WHEN length(short) >= 50 AND ({_looks('short')}) THEN short ELSE title END) AS text, 'topic' AS topic_source, '2024-01-01' AS publish_date, url,
  'Reuters' AS publisher, '' AS publisher_url, NOT contains(url, 'google.com') AS url_resolved, fit AS body_available, {_english('sample')} AS usable, contains(url, 'consent.google') AS consent_url,
  coalesce({_consent('body')}, false) AS consent_text, replace(replace(replace(url, '://', chr(1)), '//', '/'), chr(1), '://') AS plain_url FROM s
"""


def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each document that may be held against sources: those that report, or all of them if none does."""
    found = _docs(spark, sf_dir).select("doc_id", text.claims_of(F.col("text")).alias("claims"))
    return found.select("doc_id", F.size("claims").alias("n_claims"), F.md5(F.array_join("claims", "|").cast("binary")).alias("digest"))


SQL_EVIDENCE = f"""
WITH {_SENTENCES}, g AS (SELECT doc_id, pos, sentence, ({_INFORMATIVE}) AS good FROM kept), a AS (SELECT *, bool_or(good) OVER (PARTITION BY doc_id) AS any_good FROM g),
c AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_claims, md5(string_agg(sentence, '|' ORDER BY pos)) AS digest FROM a WHERE good OR NOT any_good GROUP BY doc_id)
SELECT doc_id, coalesce(n_claims, 0) AS n_claims, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN c USING (doc_id)
"""


def claim_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of reviews of the benchmark's items, each once by its beginning, five a verdict."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rating = F.element_at(F.array(*map(F.lit, RATINGS)), (F.col("item_id") % len(RATINGS) + 1).cast("int"))
    twice = items.union(items.select(F.col("item_id") + 1_000_000, F.upper("text")))
    reviews = twice.select("item_id", F.col("text").alias("claim"), rating.alias("rating"), F.lit("2024-01-01").alias("date"), F.concat(F.lit("https://f.org//"), "item_id").alias("url"))
    return claims.collect_claims(reviews, 5, "item_id").select("item_id", "verdict", "topic", "url")


SQL_CAPS = rf"""
WITH i AS (SELECT item_id, text AS claim FROM benchmark UNION ALL SELECT item_id + 1000000, upper(text) FROM benchmark), m AS (SELECT item_id, claim, lower(trim([{_quoted(RATINGS)}][item_id % {len(RATINGS)} + 1])) AS r FROM i),
v AS (SELECT *, CASE WHEN r IN ('true', 'mostly true', 'correct attribution') THEN 'TRUE' WHEN r IN ('false', 'mostly false', 'fake', 'scam') THEN 'FALSE' END AS verdict FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY lower(substr(claim, 1, 90)) ORDER BY item_id) AS k FROM v WHERE verdict IS NOT NULL), c AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY item_id) AS n FROM o WHERE k = 1)
SELECT item_id, verdict, CASE {' '.join(f"WHEN regexp_matches(lower(claim), '{_bordered(p)}') THEN '{n}'" for n, p in fixed.TOPIC_PATTERNS.items())} ELSE 'general' END AS topic, 'https://f.org/' || item_id AS url FROM c WHERE n <= 5
"""


def topic_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which beginnings of documents may be asked for as topics."""
    return _docs(spark, sf_dir).select("doc_id", text.is_topic_request(F.substring("text", 1, (F.col("doc_id") % 70).cast("int"))).alias("fit"))


SQL_REQUESTS = r"SELECT doc_id, regexp_full_match(substr(text, 1, CAST(doc_id % 70 AS INTEGER)), '[\w .,''&()\-]{2,60}') AS fit FROM documents"


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier is shown of each document."""
    short = text.short(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(short).alias("n_chars"), F.md5(short.cast("binary")).alias("digest"))


SQL_SHORT = "SELECT doc_id, CAST(length(substr(text, 1, 512)) AS INTEGER) AS n_chars, md5(substr(text, 1, 512)) AS digest FROM documents"

TONES = ("POSITIVE", "negative", "Positive", "NEUTRAL")


def signed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a classifier's answers: scores with their sign."""
    label = F.element_at(F.array(*map(F.lit, TONES)), (F.col("event_id") % len(TONES) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scores.signed_sentiment(label, F.round(F.col("value"), 2) / 100).alias("value"))


SQL_SIGNED = f"SELECT event_id, CASE WHEN upper([{_quoted(TONES)}][event_id % {len(TONES)} + 1]) = 'POSITIVE' THEN 1 ELSE -1 END * round(round(value, 2) / 100, 4) AS value FROM events"


def near_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which users' values, in hundredths, have an interval that holds one half."""
    spread = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg((F.min("value") / 100).alias("low"), (F.max("value") / 100).alias("high"))
    return spread.select("user_id", scores.straddles_chance(F.col("low"), F.col("high")).alias("near_chance"))


SQL_CHANCE = "SELECT user_id, min(value) / 100 <= 0.5 AND max(value) / 100 >= 0.5 AS near_chance FROM events GROUP BY user_id"


def headline_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source that are known to lack a body, those that nothing is known of not counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.when(F.col("doc_id") % 6 > 0, F.col("n_chars") >= 500).alias("bodyAvailable"))
    return docs.groupBy("source").agg(F.collect_list(F.struct("bodyAvailable")).alias("articles")).select("source", scores.headline_only(F.col("articles")).alias("n"))


SQL_HEADLINES = "SELECT source, CAST(count(*) FILTER (doc_id % 6 > 0 AND n_chars < 500) AS INTEGER) AS n FROM documents GROUP BY source"


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time of the events, and the days between."""
    found = timebins.date_range(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")
    return found.select(F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "days")


SQL_RANGE = "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS INTEGER) AS days FROM events"


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in the order in which they first appear."""
    return dedup.first_appearance(_docs(spark, sf_dir), "source", "doc_id")


SQL_FIRST = "SELECT source, first, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS nth FROM (SELECT source, min(doc_id) AS first FROM documents GROUP BY source)"


def first_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics that a page shows at first, of topics that are the sources in order of appearance."""
    topics = dedup.first_appearance(_docs(spark, sf_dir), "source", "doc_id").select(F.col("nth").alias("ord"), F.concat(F.lit("Topic "), "source").alias("topic"))
    return export.first_topics(topics)


SQL_FIRST_TOPICS = "SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS ord, 'Topic ' || source AS topic FROM (SELECT source, min(doc_id) AS first FROM documents GROUP BY source) ORDER BY first LIMIT 10"


def dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dossier's entries of topics that are the documents of a source, by language as their sources; document 0 is a topic by itself, too small for an entry."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = [(F.col("doc_id") % 12).cast("string"), F.lit("-"), F.col("lang")]
    rows = docs.withColumn("source", F.when(F.col("doc_id") == 0, "alone").otherwise(F.col("source"))).groupBy("source").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.round(F.avg((F.col("doc_id") % 11 - 4) / 8), 4).alias("mean_sentiment"), (F.sum(F.col("doc_id") % 7) % 100).cast("int").alias("final_score"),
        F.array_sort(F.collect_set(F.concat(*parts))).alias("sources"), F.min_by(F.substring("text", 1, 80), "doc_id").alias("summary"),
    )
    topics = rows.withColumns({"topic": F.concat(F.lit("Topic "), "source"), "keywords": F.concat(F.lit("about "), "source"), "places": F.lit("Global")})
    return export.dossier(topics, "source")


SQL_DOSSIER = """
WITH r AS (SELECT source, count(*) AS n, round(avg((doc_id % 11 - 4) / 8.0::DOUBLE), 4) AS mean, sum(doc_id % 7) % 100 AS score, list_sort(list(DISTINCT (doc_id % 12) || '-' || lang)) AS s, min_by(substr(text, 1, 80), doc_id) AS summary
  FROM (SELECT * REPLACE (CASE WHEN doc_id = 0 THEN 'alone' ELSE source END AS source) FROM documents) GROUP BY source HAVING count(*) >= 2),
t AS (SELECT *, array_to_string(s[1:8], ', ') AS named FROM r)
SELECT source, array_to_string(['SUBJECT: Topic ' || source,
  'SENTIMENT: ' || CASE WHEN mean > 0.2 THEN 'Positive' WHEN mean < -0.2 THEN 'Negative' ELSE 'Neutral' END || ' (Score: ' || round(mean, 2) || ') | CORROBORATION: ' || CAST(score AS INTEGER) || '/100 ' || CASE WHEN score > 70 THEN 'ok' ELSE 'review' END,
  'CONSENSUS: ' || CASE WHEN len(s) >= 5 THEN 'STRONG' WHEN len(s) = 4 THEN 'GOOD' WHEN len(s) = 3 THEN 'MODERATE' WHEN len(s) = 2 THEN 'WEAK' ELSE 'SINGLE-SOURCE' END || ' (' || len(s) || ' sources: ' || named || ')',
  repeat('-', 50), summary, '', 'KEYWORDS: about ' || source, 'PLACES: Global', 'SOURCES: ' || named, repeat('=', 50)], chr(10)) AS entry FROM t
"""


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printable report of the documents of each source, by length and checksum."""
    docs = _docs(spark, sf_dir)
    article = F.struct(
        F.concat(F.lit("<Doc> "), "doc_id").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://x.org/?a=1&b="), "doc_id")).otherwise("javascript:x").alias("url"),
        F.col("lang").alias("source"), F.lit("2024-01-01").alias("pubDate"), F.substring("text", 1, F.lit(190) + (F.col("doc_id") % 20).cast("int")).alias("snippet"),
    )
    rows = docs.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", article.alias("a")))), lambda x: x["a"]).alias("articles"), F.count_distinct("lang").cast("int").alias("k"))
    score = F.struct((F.size("articles") % 100).alias("finalScore"), F.col("k").alias("nDomains"))
    topics = rows.select(F.concat(F.lit("Topic & "), "source").alias("topic"), F.lit("It's a \"summary\"").alias("intelligenceSummary"), F.array(F.lit("a"), F.lit("<b>")).alias("keywords"), "articles", score.alias("formulaBreakdown"))
    return export.report_html(topics).select("topic", "reference", F.length("html").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("digest"))


def _escaped(expression: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        expression = f"replace({expression}, '{raw}', '{entity}')"
    return expression


SQL_REPORTS = f"""
WITH a AS (SELECT source, doc_id, lang, '<li><a href="' || CASE WHEN doc_id % 2 = 0 THEN 'https://x.org/?a=1&amp;b=' || doc_id ELSE '#' END || '">&lt;Doc&gt; ' || doc_id || '</a> <i>' || lang || '</i> 2024-01-01<p>'
    || {_escaped("CASE WHEN length(s) > 200 THEN substr(s, 1, 197) || '...' ELSE s END")} || '</p></li>' AS item FROM (SELECT *, substr(text, 1, CAST(190 + doc_id % 20 AS INTEGER)) AS s FROM documents)),
t AS (SELECT source, 'Topic & ' || source AS topic, count(*) % 100 AS score, count(DISTINCT lang) AS k, string_agg(item, '' ORDER BY doc_id) AS items FROM a GROUP BY source),
r AS (SELECT *, 'REF-' || lpad(CAST(list_sum(list_transform(string_split(topic, ''), lambda x: ascii(x))) % 100000 AS VARCHAR), 5, '0') || '-' || upper(substr(topic, 1, 3)) AS reference FROM t),
h AS (SELECT topic, reference, '<!DOCTYPE html><html><head><meta charset=''utf-8''><title>' || {_escaped('topic')} || '</title></head><body><h1>' || {_escaped('topic')} || '</h1><p>' || reference || '</p><p>Score ' || CAST(score AS INTEGER)
    || ' (' || CASE WHEN score >= 80 THEN 'high' WHEN score >= 75 THEN 'moderate' WHEN score > 50 THEN 'low' ELSE 'flagged' END || '), '
    || CASE WHEN k >= 5 THEN 'STRONG' WHEN k = 4 THEN 'GOOD' WHEN k = 3 THEN 'MODERATE' WHEN k = 2 THEN 'WEAK' ELSE 'SINGLE-SOURCE' END || '</p><p>It&#039;s a &quot;summary&quot;</p><p>a, &lt;b&gt;</p><ol>' || items || '</ol></body></html>' AS html FROM r)
SELECT topic, reference, CAST(length(html) AS INTEGER) AS n_chars, md5(html) AS digest FROM h
"""


def export_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node of each document in an export, field by field."""
    docs = _docs(spark, sf_dir)
    rows = docs.select(
        F.lit(1).alias("topic_id"), "doc_id", F.when(F.col("doc_id") % 10 > 0, F.substring("text", 1, 60)).alias("title"), "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://www.site.com/"), "doc_id")).alias("url"),
        F.when(F.col("doc_id") % 5 == 0, "https://feeds.reuters.com/x").alias("publisher_url"), F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("publisher"), F.lit("2024-01-02T03:04:05").alias("publish_date"),
        (F.col("doc_id") % 2 == 0).alias("body_available"), F.when(F.col("doc_id") % 7 == 0, "negative").alias("sentiment"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 9 / 10 - 0.4).alias("sentiment_value"),
        F.when(F.col("doc_id") % 3 == 0, 0.5).alias("sentiment_score"), (F.col("doc_id") % 8 / 8).alias("similarity"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0.5))).alias("coherence"),
    )
    found = export.article_nodes(rows, "topic_id", "doc_id").select("doc_id", "article.*")
    return found.withColumns({"coherenceScores": F.size("coherenceScores"), "snippet": F.md5(F.col("snippet").cast("binary")), "sentimentScore": F.round("sentimentScore", 4)})


SQL_ARTICLES = """
WITH r AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'reuters.com' WHEN doc_id % 3 = 0 THEN 'site.com' WHEN doc_id % 4 > 0 THEN 'name:' || source ELSE '' END AS k, CASE WHEN doc_id % 4 > 0 THEN source ELSE '' END AS p,
  coalesce(CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 / 10.0::DOUBLE - 0.4::DOUBLE END, CASE WHEN doc_id % 3 = 0 THEN 0.5::DOUBLE END, 0.0::DOUBLE) AS v FROM documents),
s AS (SELECT *, CASE WHEN k = '' OR starts_with(k, 'name:') THEN p ELSE k END AS shown FROM r)
SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN substr(text, 1, 60) ELSE 'Untitled Article' END AS title, md5(substr(text, 1, 240)) AS snippet, CASE WHEN doc_id % 3 = 0 THEN 'https://www.site.com/' || doc_id ELSE '' END AS url,
  CASE WHEN shown = '' THEN 'unresolved-source' ELSE shown END AS source, k AS "sourceKey", p AS publisher, k <> '' AS "urlResolved", doc_id % 2 = 0 AS "bodyAvailable", '2024-01-02' AS "pubDate",
  CASE WHEN doc_id % 7 = 0 THEN 'NEGATIVE' WHEN v > 0.2 THEN 'POSITIVE' WHEN v < -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment, round(v, 4) AS "sentimentScore", doc_id % 8 / 8.0::DOUBLE AS "similarityToSummary",
  CAST((doc_id % 2 = 0)::INT AS INTEGER) AS "coherenceScores" FROM s
"""


def document_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document written over an older one and read again."""
    path = f"{shared.scratch_path(spark, 'document')}.json"
    docs = _docs(spark, sf_dir)
    tables.write_document(spark.range(1).select(F.lit("{}").alias("json")), path)
    tables.write_document(docs.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"))).alias("json")), path)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


SQL_DOCUMENT = """SELECT '{"documents":' || count(*) || ',"sources":' || count(DISTINCT source) || '}' AS json FROM documents"""


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of the documents' numbers: a row a language, a column a kind."""
    docs = _docs(spark, sf_dir).groupBy("lang", F.concat(F.lit("kind"), F.col("doc_id") % 3).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return tables.result_table(docs, "lang", "kind", "n")


SQL_RESULT = "SELECT lang, nullif(count(*) FILTER (doc_id % 3 = 0), 0) AS kind0, nullif(count(*) FILTER (doc_id % 3 = 1), 0) AS kind1, nullif(count(*) FILTER (doc_id % 3 = 2), 0) AS kind2 FROM documents GROUP BY lang"


def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched through a cache by a getter that knows them, then again by one that doesn't."""
    path = shared.scratch_path(spark, "cache")
    wanted = _pages(spark, sf_dir).select("url")
    hooks.through_cache(wanted.where(F.length("url") % 2 == 0), path, lambda u: f"first {u}").count()
    return hooks.through_cache(wanted, path, lambda u: f"second {u}")


SQL_CACHED = "SELECT DISTINCT url, CASE WHEN length(url) % 2 = 0 THEN 'first ' ELSE 'second ' END || url AS html FROM pages WHERE url IS NOT NULL"


def decoded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects decoded by a caller's decoder, which fails for some of them."""
    url = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("https://news.google.com/rss/articles/"), "page_id")).otherwise(F.col("url"))
    answer = lambda u: {"status": int(u.rsplit("/", 1)[1]) % 2 == 0, "decoded_url": "https://decoded.org/" + u.rsplit("/", 1)[1]}
    return _pages(spark, sf_dir).select("page_id", hooks.decoded(url, answer).alias("url"))


SQL_DECODED = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 2 = 0 THEN 'https://decoded.org/' || page_id ELSE 'https://news.google.com/rss/articles/' || page_id END AS url FROM pages"


def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the documents' clustering texts, each text encoded once: a row for each slot that isn't zero."""
    docs = _docs(spark, sf_dir).select("doc_id", topics.clustering_text(F.substring_index("text", "\n", 1), F.col("text")).alias("t"))
    found = hooks.encode_once(docs, "t", hooks.hash_words(64)).select("doc_id", F.posexplode("embedding").alias("slot", "value"))
    return found.where("value <> 0").select("doc_id", "slot", F.round("value", 6).alias("value"))


SQL_EMBEDDED = rf"""
WITH remainders AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k) ORDER BY k) AS t FROM range(256) r(k)),
w AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(lower(string_split(text, chr(10))[1] || '. ' || substr(text, 1, 1200)), '{_WS}+'), lambda x: regexp_replace(x, '^[.,;:!?()"'']+|[.,;:!?()"'']+$', '', 'g')), lambda x: x <> '')) AS word FROM documents),
h AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w),
s AS MATERIALIZED (SELECT word, CAST(xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) % 64 AS INTEGER) AS slot FROM h, remainders),
n AS (SELECT doc_id, slot, count(*) AS n FROM w JOIN s USING (word) GROUP BY doc_id, slot)
SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM n
"""

PROFILE = ("reachable", "about", "corrections", "staff", "contact", "has_bylines", "labels_ads", "labels_opinion")


def reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reputation of the sources of each language and kind; a source's criteria follow from its number, two have no profile."""
    docs = _docs(spark, sf_dir)
    title = F.when(F.col("doc_id") % 97 == 0, "SHOCKING truth exposed").otherwise("A plain title")
    bundles = docs.groupBy(F.concat_ws("-", "lang", F.col("doc_id") % 4).alias("claim_id")).agg(F.collect_list(F.struct(title.alias("title"), F.col("source").alias("domain"))).alias("articles"))
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    profiles = docs.select("source").distinct().where(number > 1).select(F.col("source").alias("domain"), *[((number + k) % (k + 2) == 0).alias(c) for k, c in enumerate(PROFILE)])
    return rivals.reputation(bundles, profiles).select("claim_id", F.round("score", 6).alias("score"))


SQL_REPUTATION = """
WITH d AS (SELECT lang || '-' || doc_id % 4 AS claim_id, source, bool_or(doc_id % 97 = 0) AS loud, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS k FROM documents GROUP BY ALL),
h AS (SELECT *, k > 1 AND k % 2 = 0 AS reachable, k > 1 AND (k + 1) % 3 = 0 AS about, k > 1 AND (k + 2) % 4 = 0 AS corrections, k > 1 AND (k + 3) % 5 = 0 AS staff, k > 1 AND (k + 4) % 6 = 0 AS contact, k > 1 AND (k + 5) % 7 = 0 AS bylines,
  k > 1 AND (k + 6) % 8 = 0 AS ads, k > 1 AND (k + 7) % 9 = 0 AS opinion FROM d),
e AS (SELECT claim_id, (22 + 18) * (reachable AND (about OR corrections))::INT + 12.5::DOUBLE * corrections::INT + 12.5::DOUBLE * opinion::INT + 10 * (NOT loud)::INT + 7.5::DOUBLE * about::INT + 7.5::DOUBLE * ads::INT
  + 5 * (staff OR contact)::INT + 5 * (bylines OR staff)::INT AS earned FROM h)
SELECT claim_id, round(avg(earned), 6) AS score FROM e GROUP BY claim_id
"""

QUERIES = {
    f.__name__: f
    for f in (
        tiered_candidates, searched_candidates, search_hits, page_hits, html_text, csv_round_trip, bundle_files, resume_topics, assembled_rows, claim_evidence, claim_caps, topic_requests, short_texts, signed_values, near_chance,
        headline_only, date_range, first_seen, first_topics, dossier, report_pages, export_articles, document_file, result_table, cached_pages, decoded_urls, embedded_texts, reputation,
    )
}
SQL = {
    "tiered_candidates": SQL_TIERS, "searched_candidates": SQL_SEARCHED, "search_hits": SQL_HITS, "page_hits": SQL_PAGE_HITS, "html_text": SQL_HTML, "csv_round_trip": SQL_CSV, "bundle_files": SQL_BUNDLES, "resume_topics": SQL_RESUME, "assembled_rows": SQL_ROWS,
    "claim_evidence": SQL_EVIDENCE, "claim_caps": SQL_CAPS, "topic_requests": SQL_REQUESTS, "short_texts": SQL_SHORT, "signed_values": SQL_SIGNED, "near_chance": SQL_CHANCE, "headline_only": SQL_HEADLINES, "date_range": SQL_RANGE,
    "first_seen": SQL_FIRST, "first_topics": SQL_FIRST_TOPICS, "dossier": SQL_DOSSIER, "report_pages": SQL_REPORTS, "export_articles": SQL_ARTICLES, "document_file": SQL_DOCUMENT, "result_table": SQL_RESULT,
    "cached_pages": SQL_CACHED, "decoded_urls": SQL_DECODED, "embedded_texts": SQL_EMBEDDED, "reputation": SQL_REPUTATION,
}
