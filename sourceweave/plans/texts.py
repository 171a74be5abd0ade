"""Queries over ``documents``, ``benchmark`` and ``pages``: text predicates, cleaning, sources, terms and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceweave.functions import fixed, text, urls
from sourceweave.operators import claims, dedup, quality, rivals, topics, topk
from sourceweave.sources.tables import scan


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# one line of SQL each for counting characters of a class, and for Unicode white space
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _count(column: str, pattern: str) -> str:
    return f"(length({column}) - length(regexp_replace({column}, '{pattern}', '', 'g')))"


def _looks(column: str) -> str:
    return (
        f"CASE WHEN length({column}) < 20 THEN regexp_replace({column}, '{_WS}', '', 'g') <> '' ELSE {_count(column, chr(92) + 'x{FFFD}')} <= 0.01 * length({column}) "
        rf"AND {_count(column, '[\x00-\x08\x0b\x0c\x0e-\x1f]')} <= 0.01 * length({column}) AND {_count(column, chr(92) + 'p{L}')} / length({column})::DOUBLE >= 0.45 END"
    )


def looks_like_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are text, not a binary payload."""
    return _docs(spark, sf_dir).select("doc_id", text.looks_like_text(F.col("text")).alias("is_text"))


SQL_LOOKS = f"SELECT doc_id, {_looks('text')} AS is_text FROM documents"


def english_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents pass the English guard."""
    return _docs(spark, sf_dir).select("doc_id", text.is_probably_english(F.col("text")).alias("english"))


def _english(column: str) -> str:
    tokens = f"regexp_extract_all({column}, '[a-zA-Z'']+')"
    hits = f"len(list_filter({tokens}, lambda x: list_contains([{_quoted(fixed.ENGLISH_MARKERS)}], lower(x))))"
    return f"CASE WHEN {_count(column, '[' + fixed.FOREIGN_LETTERS + ']')} > length({column}) * 0.004 THEN false WHEN len({tokens}) < 12 THEN true ELSE {hits} / len({tokens})::DOUBLE >= 0.04 END"


SQL_ENGLISH = f"SELECT doc_id, {_english('text')} AS english FROM documents"


def informative_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, and how many of them report."""
    rows = _docs(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("every"))
    return rows.select("doc_id", F.size("every").alias("n_sentences"), F.size(F.filter("every", lambda s: text.is_informative_sentence(s))).alias("n_informative"))


_SENTENCES = f"""
s AS (SELECT doc_id, pos, regexp_replace(regexp_replace(sentence, '^{_WS}+', ''), '{_WS}+$', '') AS sentence FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM documents)),
kept AS (SELECT * FROM s WHERE sentence <> '')"""

_INFORMATIVE = f"""
  len(list_filter(regexp_split_to_array(sentence, '{_WS}+'), lambda w: w <> '')) BETWEEN 8 AND 70
  AND NOT regexp_matches(sentence, '(?i){fixed.BOILERPLATE_SENTENCE}') AND NOT regexp_matches(sentence, '[|•]')
  AND {_count('sentence', chr(92) + 'p{L}')} / greatest(1, length(sentence))::DOUBLE >= 0.6 AND ({_looks('sentence')})"""

SQL_INFORMATIVE = f"""
WITH {_SENTENCES},
c AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER ({_INFORMATIVE}) AS INTEGER) AS good FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(good, 0) AS n_informative FROM documents LEFT JOIN c USING (doc_id)
"""


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents, by length and checksum."""
    clean = text.clean_text(F.concat(F.col("text"), F.lit("\nLoading...\nSee more © 2024 all\nRead more about it")))
    return _docs(spark, sf_dir).select("doc_id", F.length(clean).alias("n_chars"), F.md5(clean.cast("binary")).alias("digest"))


def _cut_sql(expression: str) -> str:
    for pattern in fixed.LINE_CUTS:
        expression = f"regexp_replace({expression}, '(?i){pattern}', '')"
    return expression


SQL_CLEAN = f"""
WITH lines AS (SELECT doc_id, list_transform(string_split(text || chr(10) || 'Loading...' || chr(10) || 'See more © 2024 all' || chr(10) || 'Read more about it', chr(10)), lambda x: trim(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g'))) AS l FROM documents),
cut AS (SELECT doc_id, list_transform(list_filter(l, lambda x: x <> '' AND NOT list_contains([{_quoted(fixed.BOILERPLATE_LINES)}], lower(x))), lambda x: regexp_replace({_cut_sql('x')}, '^{_WS}+|{_WS}+$', '', 'g')) AS l FROM lines),
joined AS (SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(l, lambda x: x <> ''), ' '), '{_WS}+', ' ', 'g')) AS clean FROM cut)
SELECT doc_id, CAST(length(clean) AS INTEGER) AS n_chars, md5(clean) AS digest FROM joined
"""


def stance_and_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stance and topic of each benchmark item put before each document's beginning: a cue now and then."""
    docs = _docs(spark, sf_dir).withColumn("title", F.element_at(F.array(*map(F.lit, CUES)), (F.col("doc_id") % len(CUES) + 1).cast("int")))
    return docs.select("doc_id", text.stance(F.col("title"), F.col("text"), F.col("source")).alias("stance"), text.topic_of(F.concat("title", F.lit(" "), "text")).alias("topic"))


# RE2 takes word borders for ASCII ones; these are for all letters
def _bordered(pattern: str) -> str:
    return r"(^|[^\pL\pN_])" + pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"ai\b", "ai") + r"($|[^\pL\pN_])"


CUES = ("Officials deny it", "The claim is false", "Vote in the Senate", "A new study of species", "Markets and prices", "No evidence for a vaccine", "AI and robots", "Missile strike", "Photo was ai-generated")

SQL_STANCE = rf"""
WITH t AS (SELECT doc_id, source, text, [{_quoted(CUES)}][doc_id % {len(CUES)} + 1] AS title FROM documents), u AS (SELECT *, lower(title || ' ' || text) AS low FROM t)
SELECT doc_id,
  CASE WHEN list_contains([{_quoted(fixed.FACT_CHECK_DOMAINS)}], source) OR regexp_matches(title || ' ' || substr(text, 1, 400), '(?i){fixed.DENIAL.replace("'", "''")}') THEN 'debunk' ELSE 'neutral' END AS stance,
  CASE {' '.join(f"WHEN regexp_matches(low, '{_bordered(p)}') THEN '{n}'" for n, p in fixed.TOPIC_PATTERNS.items())} ELSE 'general' END AS topic
FROM u
"""


def sensational_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How free of sensational language each document is."""
    return _docs(spark, sf_dir).select("doc_id", F.round(100 * (1 - text.sensational_share(None, F.col("text"))), 6).alias("score"))


_HITS = " + ".join(f"contains(lower(head), '{t.replace(chr(39), chr(39) * 2)}')::INT" for t in fixed.SENSATIONAL_TERMS)
SENSATIONAL = f"""
heads AS (SELECT doc_id, substr(text, 1, 600) AS head FROM documents),
parts AS (SELECT doc_id, head, list_filter(regexp_split_to_array(head, '{_WS}+'), lambda w: w <> '') AS w FROM heads),
hits AS (SELECT doc_id, w, {_HITS} + least(3, len(list_filter(w, lambda x: length(x) > 3 AND upper(x) = x AND lower(x) <> x))) + least(3, length(head) - length(replace(head, '!', ''))) AS h FROM parts),
sensational AS (SELECT doc_id, round(100 * (1 - least(1.0::DOUBLE, h / greatest(1.0::DOUBLE, len(w) / 100.0::DOUBLE) / 6.0::DOUBLE)), 6) AS score FROM hits)"""
SQL_SENSATIONAL = f"WITH {SENSATIONAL} SELECT doc_id, score FROM sensational"


def title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return dedup.keep_first(_docs(spark, sf_dir).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")), ["digest"], "doc_id").select("doc_id", "digest")


SQL_TITLE_DEDUP = "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text"


def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd ids that neither share a text with an even one, nor with one kept before."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), F.md5(F.col("text").cast("binary")).alias("title"))
    return dedup.unseen(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), ("url", "title"), "doc_id").select("doc_id", "title")


SQL_SEEN = "SELECT min(doc_id) AS doc_id, md5(text) AS title FROM documents GROUP BY text HAVING bool_and(doc_id % 2 = 1)"


def class_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one- and two-word terms by language."""
    return topics.term_counts(_docs(spark, sf_dir), "lang", "text", topics.stop_words())


_TOKENS = rf"""
tok AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[\pL\pN\pM_]+'), lambda t: length(t) > 1 AND NOT list_contains([{_quoted(topics.stop_words())}], t)) AS t FROM documents),
terms AS (SELECT lang, unnest(t) AS term FROM tok UNION ALL SELECT lang, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok),
counts AS (SELECT lang, term, count(*) AS tf FROM terms GROUP BY lang, term)"""
SQL_TERMS = f"WITH {_TOKENS} SELECT lang, term, tf FROM counts"


def ctfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve terms of the largest class-based weight of each language."""
    weighed = topics.class_tfidf(topics.term_counts(_docs(spark, sf_dir), "lang", "text", topics.stop_words()), "lang", 4)
    return topics.top_terms(weighed, "lang").select("lang", "rank", "term", F.round("weight", 6).alias("weight"))


SQL_CTFIDF = f"""
WITH {_TOKENS},
spread AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
w AS (SELECT lang, c.term, tf * ln(1 + (SELECT sum(tf) / 4.0::DOUBLE FROM counts) / (df + 0.00001::DOUBLE)) AS weight FROM counts c JOIN spread USING (term)),
r AS (SELECT lang, term, weight, row_number() OVER (PARTITION BY lang ORDER BY round(weight, 9) DESC, encode(term)) AS rank FROM w)
SELECT lang, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 12
"""


def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of each language from its top terms."""
    weighed = topics.class_tfidf(topics.term_counts(_docs(spark, sf_dir), "lang", "text", topics.stop_words()), "lang", 4)
    found = topics.labels(topics.top_terms(weighed, "lang"), "lang")
    return found.select("lang", "label", text.clean_topic_title(F.col("label")).alias("title"))


def folded_labels(ranked: str, key: str, stop: str) -> str:
    """SQL of topics.chosen_terms: CTEs that end in ``chosen`` (key, terms), from ``ranked`` (key, rank, term), term after term."""
    stem = "CASE WHEN length(w) > 4 AND w[-1] = 's' AND w[-2] <> 's' THEN w[:-2] ELSE w END"
    return rf"""
offers AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY rank) AS nth, term, list_transform(string_split(term, ' '), lambda w: {stem}) AS stems FROM {ranked}
  WHERE list_bool_and(list_transform(string_split(term, ' '), lambda w: length(w) > 1)) AND NOT list_bool_and(list_transform(string_split(term, ' '), lambda w: list_contains([{stop}], w)))),
fold AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS nth, CAST([] AS STRUCT(term VARCHAR, stems VARCHAR[])[]) AS kept FROM {ranked}
  UNION ALL
  SELECT f.{key}, o.nth, CASE WHEN len(kept) >= 4 OR list_has_all(flatten(list_transform(kept, lambda k: k.stems)), o.stems) THEN kept
    ELSE list_append(list_filter(kept, lambda k: len(k.stems) > 1 OR NOT list_has_any(k.stems, o.stems)), {{'term': o.term, 'stems': o.stems}}) END FROM fold f JOIN offers o ON o.{key} = f.{key} AND o.nth = f.nth + 1),
chosen AS (SELECT {key}, arg_max(list_transform(kept, lambda k: k.term), nth) AS terms FROM fold GROUP BY {key})"""


def title_sql(name: str) -> str:
    """SQL of text.clean_topic_title of an expression without blanks at its ends."""
    parts = f"list_filter(regexp_split_to_array(replace(regexp_replace({name}, '^-*[0-9]+_', ''), '_', ' '), ' +'), lambda w: w <> '')"
    first = f"list_filter({parts}, lambda w, i: list_position(list_transform({parts}, lambda x: lower(x)), lower(w)) = i)"
    shown = f"list_transform({first}, lambda w: CASE WHEN upper(w) = w AND lower(w) <> w THEN w ELSE upper(w[1]) || lower(w[2:]) END)"
    return f"coalesce(nullif(array_to_string({shown}, ' '), ''), {name})"


SQL_LABELS = rf"""
WITH RECURSIVE {_TOKENS},
spread AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
w AS (SELECT lang, c.term, tf * ln(1 + (SELECT sum(tf) / 4.0::DOUBLE FROM counts) / (df + 0.00001::DOUBLE)) AS weight FROM counts c JOIN spread USING (term)),
ranked AS (SELECT * FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY round(weight, 9) DESC, encode(term)) AS rank FROM w) WHERE rank <= 12),
{folded_labels('ranked', 'lang', _quoted(topics.stop_words()))},
named AS (SELECT lang, lang || '_' || CASE WHEN len(terms) > 0 THEN array_to_string(terms, '_') ELSE 'cluster ' || lang END AS label FROM chosen)
SELECT lang, label, {title_sql('label')} AS title FROM named
"""


def extractive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sentences of each document."""
    return topics.extractive_summaries(_docs(spark, sf_dir), "doc_id", "text")


SQL_SUMMARIES = rf"""
WITH {_SENTENCES}, long AS (SELECT doc_id, pos, sentence, ({_INFORMATIVE}) AS good FROM kept WHERE length(sentence) > 15),
chosen AS (SELECT doc_id, pos, sentence, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT *, bool_or(good) OVER (PARTITION BY doc_id) AS any_good FROM long) WHERE good OR NOT any_good),
tf AS (SELECT doc_id, pos, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, pos, n, unnest(list_filter(regexp_extract_all(lower(sentence), '[\pL\pN_]+'), lambda t: length(t) > 1 AND NOT list_contains([{_quoted(fixed.ENGLISH_STOP_WORDS)}], t))) AS term FROM chosen) GROUP BY doc_id, pos, term),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY doc_id, term),
w AS (SELECT doc_id, pos, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (doc_id, term)),
sums AS (SELECT doc_id, pos, round(sum(w) / sqrt(sum(w * w)), 9) AS score FROM w GROUP BY doc_id, pos),
best AS (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id ORDER BY coalesce(score, 0) DESC, c.pos DESC) AS k FROM chosen c LEFT JOIN sums USING (doc_id, pos)),
joined AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM best WHERE k <= 3 GROUP BY doc_id)
SELECT doc_id, coalesce(summary, substr(text, 1, 400) || '...') AS summary FROM documents LEFT JOIN joined USING (doc_id)
"""


def tfidf_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's first document is borne out by its others."""
    docs = _docs(spark, sf_dir)
    first = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("summary"), F.min("doc_id").alias("first"))
    rest = docs.join(first.select("source", "first"), "source").where("doc_id <> first")
    return topics.tfidf_overlap(first.select("source", "summary"), rest, "source", "doc_id").select("source", F.round("score", 5).alias("score"))


SQL_OVERLAP = rf"""
WITH first AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source),
tok AS (SELECT d.source, doc_id, doc_id = first AS own, list_filter(regexp_extract_all(lower(text), '[\pL\pN\pM_]+'), lambda t: length(t) > 1 AND NOT list_contains([{_quoted(fixed.ENGLISH_STOP_WORDS)}], t)) AS t FROM documents d JOIN first USING (source) WHERE regexp_replace(text, '{_WS}', '', 'g') <> ''),
tf AS (SELECT source, doc_id, own, term, count(*) AS tf FROM (SELECT source, doc_id, own, unnest(t) AS term FROM tok) GROUP BY ALL),
n AS (SELECT source, count(*) AS n FROM tok GROUP BY source), df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY source, term),
w AS (SELECT source, doc_id, own, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (source, term) JOIN n USING (source)),
norms AS (SELECT source, doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY source, doc_id),
near AS (SELECT b.source, b.doc_id, sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)) AS sim FROM w a JOIN w b ON a.source = b.source AND a.term = b.term AND a.own AND NOT b.own
  JOIN norms na ON na.source = a.source AND na.doc_id = a.doc_id JOIN norms nb ON nb.source = b.source AND nb.doc_id = b.doc_id GROUP BY b.source, b.doc_id),
sims AS (SELECT t.source, t.doc_id, coalesce(sim, 0) AS sim FROM tok t LEFT JOIN near n ON n.source = t.source AND n.doc_id = t.doc_id WHERE NOT t.own),
top AS (SELECT source, sim, row_number() OVER (PARTITION BY source ORDER BY sim DESC, doc_id) AS k FROM sims)
SELECT source, round(coalesce(100 * avg(sim), 0), 5) AS score FROM first LEFT JOIN (SELECT * FROM top WHERE k <= 3) USING (source) GROUP BY source
"""


def claim_source_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents nearest to each benchmark item by the cosine of their term counts, function words left out.

    Items are the stated queries: they travel to the documents, which are not shuffled.
    """
    words = text.terms(F.col("text"), fixed.ENGLISH_STOP_WORDS)
    found = topk.nearest(_docs(spark, sf_dir), "doc_id", words, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", words, 3)
    return found.select("item_id", "rank", "doc_id", "similarity")


SQL_CLAIMS = rf"""
WITH q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\pL\pN\pM_]+'), lambda t: length(t) > 1 AND NOT list_contains([{_quoted(fixed.ENGLISH_STOP_WORDS)}], t))) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\pL\pN\pM_]+'), lambda t: length(t) > 1 AND NOT list_contains([{_quoted(fixed.ENGLISH_STOP_WORDS)}], t))) AS term FROM documents) GROUP BY ALL),
nq AS (SELECT item_id, sqrt(sum(qf * qf)) AS nq FROM q GROUP BY item_id), nd AS (SELECT doc_id, sqrt(sum(tf * tf)) AS nd FROM d GROUP BY doc_id),
s AS (SELECT item_id, doc_id, round(sum(qf * tf) / (any_value(nq) * any_value(nd)), 6) AS similarity FROM q JOIN d USING (term) JOIN nq USING (item_id) JOIN nd USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM s)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, similarity FROM r WHERE rank <= 3
"""


def evidence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each source's documents: toxic ones count as denials, unlabelled ones as neutral, from 300 characters on as read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    article = F.struct((F.col("n_chars") >= 300).alias("body_available"), F.when(F.col("toxic") == 1, "debunk").otherwise("neutral").alias("stance"), F.col("lang").alias("domain"))
    bundles = docs.join(toxic, "doc_id", "left").groupBy("source").agg(F.collect_list(article).alias("articles"))
    return bundles.select("source", F.round(rivals.evidence_verdict(F.col("articles")), 6).alias("score"), F.round(rivals.stance_support(F.col("articles")), 6).alias("support"))


SQL_VERDICT = """
WITH t AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT source, lang, CASE WHEN n_chars >= 300 THEN 1.0::DOUBLE ELSE 0.5 END AS w, CASE WHEN toxic = 1 THEN 0.0::DOUBLE ELSE 0.5 END AS s FROM documents LEFT JOIN t USING (doc_id))
SELECT source, round(100 * sum(w * s) / sum(w) * (0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, count(DISTINCT lang) / 5.0::DOUBLE)), 6) AS score, round(avg(s), 6) AS support FROM r GROUP BY source
"""


def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain and source of each page, and whether an aggregator's."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    u = F.col("url")
    return pages.select("page_id", urls.registrable_domain(u).alias("domain"), urls.is_aggregator(u).alias("aggregator"), urls.source_identity(u).alias("source"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^(www\.|news\.|edition\.|feeds\.|amp\.|m\.)', '')"
_AGGREGATOR = rf"(list_contains([{_quoted(fixed.AGGREGATOR_HOSTS)}], regexp_replace(d, '^(www\.|news\.|edition\.|feeds\.|amp\.|m\.)', '')) OR ends_with(d, '.google.com'))"
SQL_DOMAIN = f"WITH p AS (SELECT page_id, {_HOST} AS d FROM pages) SELECT page_id, d AS domain, {_AGGREGATOR} AS aggregator, CASE WHEN {_AGGREGATOR} THEN '' ELSE d END AS source FROM p"

LINKS = (
    "https://news.google.com/rss/articles/x", "https://www.google.com/a", "https://news.search.yahoo.com/q", "https://msn.com/en", "https://www.reuters.com/w", "https://m.bbc.co.uk/n",
    "https://blog.example.com/", "https://feeds.feedproxy.google.com/z", "http://user:pw@Edition.CNN.com:8080/x?y#z", "no url", "", "https://duckduckgo.com/?q=a",
)


PUBLISHERS = ("https://www.wsj.com/", "https://news.google.com/x", "", "https://m.bbc.co.uk/news")


def aggregator_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the pages' addresses and links with all kinds of hosts in turn, with the publisher behind each."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    rows = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(pick(LINKS)).alias("url"), pick(PUBLISHERS).alias("by"))
    u = F.col("url")
    return rows.select("page_id", urls.registrable_domain(u).alias("domain"), urls.is_aggregator(u).alias("aggregator"), urls.publisher_domain(u, F.col("by")).alias("publisher"), urls.safe_href(u).alias("href"))


SQL_AGGREGATOR = rf"""
WITH l AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE [{_quoted(LINKS)}][page_id % {len(LINKS)} + 1] END AS url, [{_quoted(PUBLISHERS)}][page_id % {len(PUBLISHERS)} + 1] AS given FROM pages),
p AS (SELECT page_id, url, given, {_HOST} AS d FROM l), q AS (SELECT p.*, {_AGGREGATOR} AS aggregator FROM p)
SELECT page_id, d AS domain, aggregator, CASE WHEN contains(given, 'wsj') THEN 'wsj.com' WHEN contains(given, 'bbc') THEN 'bbc.co.uk' WHEN d <> '' AND NOT aggregator THEN d ELSE '' END AS publisher,
  CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url ELSE '#' END AS href FROM q
"""


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of the documents as a corpus with publisher names."""
    docs = _docs(spark, sf_dir).withColumns({"url": F.lit("https://news.google.com/rss"), "publisher": F.when(F.col("doc_id") % 3 > 0, F.col("source"))})
    return quality.quality_warnings(quality.quality_report(docs)).withColumn("warnings", F.array_join("warnings", "; "))


SQL_QUALITY = """
WITH d AS (SELECT CASE WHEN doc_id % 3 > 0 THEN 'name:' || source ELSE '' END AS s, length(text) AS n, text FROM documents),
r AS (SELECT count(*) AS documents, 0.0::DOUBLE AS resolved_share, round(avg((s <> '')::INT), 4) AS known_share, round(avg((n >= 300 AND NOT contains(text, '[Full report at direct source'))::INT), 4) AS body_share,
  CAST(trunc(quantile_cont(n, 0.5)) AS INTEGER) AS median_body_chars, count(DISTINCT nullif(s, '')) AS n_sources, count(*) AS aggregator_rows FROM d)
SELECT *, concat_ws('; ', CASE WHEN known_share < 0.5 THEN 'few identifiable publishers: ' || CAST(round(100 * known_share) AS INTEGER) || '%' END, CASE WHEN body_share < 0.5 THEN 'few bodies: ' || CAST(round(100 * body_share) AS INTEGER) || '%' END) AS warnings FROM r
"""

RATINGS = ("True", "mostly true", "Correct Attribution", "FALSE", "Mostly False", "Fake", "Scam", "Mixture", "Unproven", "", " false ")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of ratings on the benchmark's items, capped, split and numbered."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rating = F.element_at(F.array(*map(F.lit, RATINGS)), (F.col("item_id") % len(RATINGS) + 1).cast("int"))
    rated = items.select("item_id", claims.verdict_of(rating).alias("verdict")).where("verdict is not null")
    return claims.number_claims(claims.stratified_split(rated, "verdict", ["item_id"]), ["verdict", "item_id"])


SQL_VERDICTS = f"""
WITH m AS (SELECT item_id, lower(trim([{_quoted(RATINGS)}][item_id % {len(RATINGS)} + 1])) AS r FROM benchmark),
v AS (SELECT item_id, CASE WHEN r IN ('true', 'mostly true', 'correct attribution') THEN 'TRUE' WHEN r IN ('false', 'mostly false', 'fake', 'scam') THEN 'FALSE' END AS verdict FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY item_id) - 1 AS i, count(*) OVER (PARTITION BY verdict) AS n FROM v WHERE verdict IS NOT NULL),
u AS (SELECT *, sum((i % 5 < 3)::INT) OVER (PARTITION BY verdict ORDER BY item_id) AS used FROM o)
SELECT item_id, verdict, CASE WHEN i % 5 < 3 AND used <= round_even(n * 0.6::DOUBLE, 0) THEN 'calibration' ELSE 'evaluation' END AS split, printf('C%03d', row_number() OVER (ORDER BY verdict, item_id)) AS claim_id FROM u
"""

ENDINGS = (" - Reuters", " | Daily Planet", " - Nobody At All", "", " — The Guardian", " - X - Bloomberg")
SAID = ("Reuters", "The Daily Planet", None, "", "Someone")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of the documents' first words and an outlet's name, without that; names of topics made of them as titles, and the references of their reports."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    words = _docs(spark, sf_dir).select("doc_id", F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 4).alias("w"))
    named = F.array_join(F.concat("w", F.transform(F.slice("w", 1, 1), F.upper), F.array(F.lit("NATO"))), "_")
    rows = words.select("doc_id", F.concat(F.array_join("w", " "), pick(ENDINGS)).alias("headline"), pick(SAID).alias("publisher"), F.concat(F.lit("-"), F.col("doc_id") % 20, F.lit("_"), named).alias("name"))
    title = text.clean_topic_title(F.col("name"))
    return rows.select("doc_id", text.strip_publisher_suffix(F.col("headline"), F.col("publisher")).alias("headline"), title.alias("title"), text.report_reference(title).alias("reference"), text.escape_html(F.concat("headline", F.lit("<'\"&>"))).alias("escaped"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries of claims made from the benchmark's items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    claim = F.concat(F.element_at(F.array(*map(F.lit, LEADS)), (F.col("item_id") % len(LEADS) + 1).cast("int")), "text")
    return items.select("item_id", text.search_query(claim).alias("query"))


LEADS = ("In August 2026, ", "According to the office, ", "A video circulating online shows ", "Senator Smith said that ", "", "“Reportedly ")

SQL_TITLES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+')[1:4] AS w FROM documents),
r AS (SELECT doc_id, array_to_string(w, ' ') || [{_quoted(ENDINGS)}][doc_id % {len(ENDINGS)} + 1] AS headline, lower(coalesce([{", ".join("NULL" if x is None else repr(x) for x in SAID)}][doc_id % {len(SAID)} + 1], '')) AS said,
  '-' || doc_id % 20 || '_' || array_to_string(list_concat(w, list_concat(list_transform(w[1:1], lambda x: upper(x)), ['NATO'])), '_') AS name FROM w),
p AS (SELECT *, trim(headline) AS t, lower(regexp_extract(trim(headline), '{fixed.SUFFIX_PATTERN}', 1)) AS suffix, {title_sql('name')} AS title FROM r)
SELECT doc_id, CASE WHEN suffix <> '' AND ((said <> '' AND (contains(said, suffix) OR contains(suffix, said))) OR list_contains([{_quoted(fixed.KNOWN_OUTLETS)}], suffix)) THEN trim(regexp_replace(t, '{fixed.SUFFIX_PATTERN}', '')) ELSE t END AS headline, title,
  'REF-' || lpad(CAST(list_sum(list_transform(string_split(title, ''), lambda x: ascii(x))) % 100000 AS VARCHAR), 5, '0') || '-' || upper(substr(title, 1, 3)) AS reference,
  replace(replace(replace(replace(replace(headline || '<''"&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped
FROM p
"""

_SAID = fixed.QUERY_ATTRIBUTION
SQL_SEARCH = rf"""
WITH c AS (SELECT item_id, [{_quoted(LEADS)}][item_id % {len(LEADS)} + 1] || text AS claim FROM benchmark),
a AS (SELECT item_id, claim, regexp_replace(trim(regexp_replace(claim, '\s+', ' ', 'g')), '^["“”]+|["“”]+$', '', 'g') AS q FROM c),
b AS (SELECT item_id, claim, regexp_replace(regexp_replace(q, '^(in|as of|during|on|by|after|before|amid|following)[^,]{{0,60}},\s*', '', 'i'), '^according to [^,]{{1,60}},\s*', '', 'i') AS q FROM a),
s AS (SELECT *, regexp_extract(q, '{_SAID}', 1) AS speaker, regexp_extract(q, '{_SAID}', 2) AS rest FROM b),
d AS (SELECT item_id, claim, CASE WHEN len(string_split(rest, ' ')) >= 5 THEN array_to_string(string_split(speaker, ' ')[-4:], ' ') || ' ' || rest ELSE q END AS q FROM s),
e AS (SELECT item_id, claim, regexp_replace(q, '^(a |an |the )?(video|photo|image|post|screenshot|meme|clip)[^,]{{0,40}}(showed|shows|depicts|circulating[^,]{{0,30}})\s*', '', 'i') AS q FROM d),
f AS (SELECT item_id, claim, regexp_replace(regexp_replace(regexp_replace(q, '(authentically|genuinely|reportedly|allegedly)', ' ', 'gi'), '["“”''’]', '', 'g'), '[^\pL\pN\pM_\s%$.-]', ' ', 'g') AS q FROM e)
SELECT item_id, regexp_replace(array_to_string(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')[:12], ' '), '[ .,-]+$', '') AS query FROM f
"""

QUERIES = {
    f.__name__: f
    for f in (
        looks_like_text, english_guard, informative_sentences, clean_text, stance_and_topic, sensational_score, title_dedup, seen_anti_join, class_term_counts, ctfidf_top_terms, topic_labels,
        extractive_summaries, tfidf_overlap, claim_source_similarity, evidence_verdict, registrable_domain, aggregator_flag, quality_report, verdicts, titles, search_queries,
    )
}
SQL = {
    "looks_like_text": SQL_LOOKS, "english_guard": SQL_ENGLISH, "informative_sentences": SQL_INFORMATIVE, "clean_text": SQL_CLEAN, "stance_and_topic": SQL_STANCE, "sensational_score": SQL_SENSATIONAL,
    "title_dedup": SQL_TITLE_DEDUP, "seen_anti_join": SQL_SEEN, "class_term_counts": SQL_TERMS, "ctfidf_top_terms": SQL_CTFIDF, "topic_labels": SQL_LABELS, "tfidf_overlap": SQL_OVERLAP, "claim_source_similarity": SQL_CLAIMS,
    "extractive_summaries": SQL_SUMMARIES, "titles": SQL_TITLES, "search_queries": SQL_SEARCH, "evidence_verdict": SQL_VERDICT, "registrable_domain": SQL_DOMAIN, "aggregator_flag": SQL_AGGREGATOR, "quality_report": SQL_QUALITY, "verdicts": SQL_VERDICTS,
}
