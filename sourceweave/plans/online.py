"""Queries of the online topic model over ``embeddings``, and of the study's parts: counts, names, matched numbers, folded rows, class balance, stance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave import shared
from sourceweave.functions import text, vectors
from sourceweave.operators import clusters, rivals, sweep, topics
from sourceweave.plans import events
from sourceweave.plans.clusters import _EVIDENCE, evidence
from sourceweave.plans.study import vector_bundles
from sourceweave.plans.texts import _quoted, folded_labels, title_sql
from sourceweave.sources.tables import scan
from sourceweave.streaming import model


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a text of their label and number; those of odd rows have a word that no even row has."""
    words = F.concat(F.lit("word"), F.col("label"), F.lit(" topic"), F.col("vec_id") % 13, F.when(F.col("vec_id") % 2 == 1, F.concat(F.lit(" only"), "vec_id")).otherwise(""))
    return scan(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").withColumn("text", words)


def _updated(spark: SparkSession, sf_dir: str) -> tuple[model.TopicModel, DataFrame]:
    """A model whose topics are the labels, learnt from the even rows, after the batch of the odd ones; and that batch."""
    rows = _rows(spark, sf_dir)
    even, odd = rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")
    centres = clusters.centroids(even.withColumn("unit", vectors.unit(F.col("embedding"))), "label", "unit").orderBy("label").collect()  # a row a topic
    counts = topics.term_counts(even.select(F.col("label").cast("int").alias("topic"), "text"), "topic", "text")
    start = model.TopicModel([list(r.centroid) for r in centres], [float(r.n) for r in centres], counts, (), {i: (i + 1) % len(centres) for i in range(len(centres))}, 0.5)
    return model.partial_update(start, odd, "embedding", "text", "vec_id")


def online_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic after a batch: rows of the batch by public number, weight and length of the moved centroid, and counts of the frozen vocabulary."""
    state, batch = _updated(spark, sf_dir)
    taken = batch.groupBy("topic").agg(F.count(F.lit(1)).alias("n_batch"))
    told = spark.createDataFrame([(i, state.alias[i], w, sum(x * x for x in c) ** 0.5) for i, (c, w) in enumerate(zip(state.centroids, state.weights))], "raw int, topic int, weight double, length double")
    counts = state.counts.groupBy(F.col("topic").alias("raw")).agg(F.sum("tf").alias("n_terms"), F.count(F.lit(1)).alias("n_distinct"))
    found = told.join(taken, "topic", "left").join(counts, "raw", "left")
    return found.select("raw", "topic", "weight", F.round("length", 6).alias("length"), F.coalesce("n_batch", F.lit(0)).alias("n_batch"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


_ONLINE = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, 'word' || label AS a, 'topic' || vec_id % 13 AS b, 'only' || vec_id AS c FROM embeddings),
u AS (SELECT *, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v),
cent AS (SELECT label, list(m ORDER BY i) AS c, any_value(n) AS n FROM (SELECT label, i, avg(u[i]) AS m, count(*) AS n FROM u, range(1, 65) t(i) WHERE vec_id % 2 = 0 GROUP BY label, i) GROUP BY label),
numbered AS (SELECT row_number() OVER (ORDER BY label) - 1 AS raw, c, n, count(*) OVER () AS k FROM cent),
first AS (SELECT vec_id, u.u AS u, arg_min(raw, (list_distance(u.u, numbered.c), raw)) AS raw FROM u, numbered WHERE vec_id % 2 = 1 GROUP BY ALL),
sums AS (SELECT raw, list(s ORDER BY i) AS s, any_value(n) AS n FROM (SELECT raw, i, sum(u[i]) AS s, count(*) AS n FROM first, range(1, 65) t(i) GROUP BY raw, i) GROUP BY raw),
moved AS (SELECT raw, k, m.n + coalesce(s.n, 0) AS weight, CASE WHEN s.n IS NULL THEN m.c ELSE list_transform(range(1, 65), lambda i: (m.c[i] * m.n + s.s[i]) / (m.n + s.n)) END AS c FROM numbered m LEFT JOIN sums s USING (raw)),
again AS (SELECT u.vec_id, a, b, u.c, arg_min(m.raw, (list_distance(u.u, m.c), m.raw)) AS raw FROM u, moved m WHERE vec_id % 2 = 1 GROUP BY ALL),
base AS (SELECT CAST(label AS BIGINT) AS raw, unnest([a, b, a || ' ' || b]) AS term FROM v WHERE vec_id % 2 = 0),
added AS (SELECT raw, unnest([a, b, a || ' ' || b]) AS term FROM again),
merged AS (SELECT raw, term, count(*) AS tf FROM (SELECT * FROM base UNION ALL SELECT * FROM added WHERE term IN (SELECT term FROM base)) GROUP BY raw, term)"""

SQL_ONLINE = f"""
WITH {_ONLINE}
SELECT CAST(raw AS INTEGER) AS raw, CAST((raw + 1) % k AS INTEGER) AS topic, weight::DOUBLE AS weight, round(sqrt(list_inner_product(c, c)), 6) AS length, (SELECT count(*) FROM again g WHERE g.raw = m.raw) AS n_batch,
  CAST(coalesce((SELECT sum(tf) FROM merged x WHERE x.raw = m.raw), 0) AS BIGINT) AS n_terms, (SELECT count(*) FROM merged x WHERE x.raw = m.raw) AS n_distinct FROM moved m
"""


def topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the topics of the model after a batch, by public number."""
    names = model.topic_names(_updated(spark, sf_dir)[0])
    return names.select("topic", "label", text.clean_topic_title(F.col("label")).alias("title"))


SQL_NAMES = f"""
WITH RECURSIVE {_ONLINE},
spread AS (SELECT term, count(*) AS df FROM merged GROUP BY term),
w AS (SELECT (raw + 1) % (SELECT max(k) FROM numbered) AS topic, m.term, tf * ln(1 + (SELECT sum(tf) / max(k)::DOUBLE FROM merged, (SELECT max(k) AS k FROM numbered)) / (df + 0.00001::DOUBLE)) AS weight FROM merged m JOIN spread USING (term)),
ranked AS (SELECT * FROM (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, encode(term)) AS rank FROM w) WHERE rank <= 12),
{folded_labels('ranked', 'topic', _quoted(topics.stop_words()))},
named AS (SELECT topic, topic || '_' || CASE WHEN len(terms) > 0 THEN array_to_string(terms, '_') ELSE 'cluster ' || topic END AS label FROM chosen)
SELECT CAST(topic AS INTEGER) AS topic, label, {title_sql('label')} AS title FROM named
"""


def matched_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public numbers that all labels, learnt anew from the odd rows in reverse, take over from those of the even rows."""
    means = {}
    for part in (0, 1):
        own = scan(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").where(f"vec_id % 2 = {part}")
        means[part] = [list(r.centroid) for r in clusters.centroids(own, "label", "embedding").orderBy("label").collect()]  # a row a label
    empty = spark.createDataFrame([], "topic int, term string, tf bigint")
    k = len(means[0])
    before = model.TopicModel(means[0], [1.0] * k, empty, (), {i: (i + 2) % k for i in range(k)})
    fresh = model.aligned(model.TopicModel(means[1][::-1], [1.0] * len(means[1]), empty), before)
    return spark.createDataFrame(sorted(fresh.alias.items()), "raw int, public int")


# the best assignment of the first raw topics to each set of old ones, as bits, raw topic after raw topic
SQL_MATCHED = """
WITH RECURSIVE c AS (SELECT part, dense_rank() OVER (PARTITION BY part ORDER BY label) - 1 AS nth, count(*) OVER (PARTITION BY part) AS k, c FROM (
  SELECT part, label, list(m ORDER BY i) AS c FROM (SELECT vec_id % 2 AS part, label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL)),
s AS MATERIALIZED (SELECT f.k - 1 - f.nth AS raw, b.nth AS old, b.k, list_cosine_similarity(f.c, b.c) AS s FROM c f, c b WHERE f.part = 1 AND b.part = 0),
best(raw, used, total, p) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST([] AS BIGINT[])
  UNION ALL
  SELECT b.raw + 1, b.used | (1::BIGINT << s.old), max(b.total + s.s), arg_max(list_append(b.p, s.old), b.total + s.s) FROM best b JOIN s ON s.raw = b.raw AND b.used & (1::BIGINT << s.old) = 0 GROUP BY b.raw, b.used | (1::BIGINT << s.old)),
whole AS (SELECT p, len(p) AS k FROM best ORDER BY raw DESC LIMIT 1)
SELECT CAST(raw AS INTEGER) AS raw, CAST((p[raw + 1] + 2) % k AS INTEGER) AS public FROM (SELECT p, k, unnest(range(k)) AS raw FROM whole)
"""


def folded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream in three arrivals leaves of the vectors, a tenth of which repeat an address: rows, addresses, and rows without a topic, by the last digit."""
    found = events.folded(spark, sf_dir).groupBy((F.col("ord") % 10).alias("digit"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("n_urls"), F.sum(F.col("topic").isNull().cast("bigint")).alias("n_unplaced"))


SQL_FOLDED = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 10 = 1 THEN vec_id // 2 ELSE vec_id END AS url FROM embeddings), k AS (SELECT arg_min(vec_id, (vec_id % 3, vec_id)) AS vec_id, url FROM r GROUP BY url)
SELECT vec_id % 10 AS digit, count(*) AS n, count(DISTINCT url) AS n_urls, CAST(0 AS BIGINT) AS n_unplaced FROM k GROUP BY vec_id % 10
"""


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of each split and verdict, the mean support of their articles, and its range."""
    found = vector_bundles(spark, sf_dir).select("split", "verdict", rivals.stance_support(F.col("articles")).alias("support"))
    return found.groupBy("split", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("support"), 6).alias("support"), F.round(F.min("support"), 6).alias("least"))


SQL_BALANCE = """
WITH b AS (SELECT vec_id // 8 AS b, avg(CASE WHEN vec_id % 11 = 0 THEN 0.0::DOUBLE ELSE 0.5 END) AS s FROM embeddings GROUP BY vec_id // 8)
SELECT CASE WHEN b % 5 < 3 THEN 'calibration' ELSE 'evaluation' END AS split, CASE WHEN b % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS verdict, count(*) AS n, round(avg(s), 6) AS support, round(min(s), 6) AS least FROM b GROUP BY ALL
"""


def calibrated_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stance factor that does best on the calibration split, null if none beats having none; support follows from a bundle's number."""
    own = shared.stored(evidence(spark, sf_dir).withColumn("support", F.col("bundle") * 7 % 10 / 10), "stance")
    return spark.createDataFrame([(sweep.calibrate_stance(own),)], "stance_base double")


SQL_STANCE = f"""
WITH {_EVIDENCE},
bases(nth, base) AS (VALUES (0, 1.0), (1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6), (5, 0.5), (6, 0.3), (7, 0.0)),
plain AS (SELECT bundle, label, nth, base::DOUBLE AS base, bundle * 7 % 10 / 10.0::DOUBLE AS support, ns, coh, 30 + t3 * 70 AS semantic FROM ev, bases WHERE split = 'calibration'),
sc AS (SELECT nth, base, label, least(99, greatest(5, CAST(trunc(semantic * CASE WHEN ns >= 5 THEN 1.0 WHEN ns = 4 THEN 0.95 WHEN ns = 3 THEN 0.85 WHEN ns = 2 THEN 0.72 ELSE 0.6 END::DOUBLE * (0.7::DOUBLE + coh * 0.3::DOUBLE)
  * CASE WHEN base < 1 THEN base + (1 - base) * support ELSE 1.0 END) AS INTEGER))) AS score FROM plain),
smid AS (SELECT *, rank() OVER (PARTITION BY nth ORDER BY score) + (count(*) OVER (PARTITION BY nth, score) - 1) / 2.0::DOUBLE AS mr FROM sc),
auc AS (SELECT nth, base, (sum(mr) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) AS auc, count(*) AS n FROM smid GROUP BY nth, base),
best AS (SELECT nth, base, row_number() OVER (ORDER BY auc DESC, nth) AS k, n FROM auc)
SELECT CASE WHEN nth > 0 AND n >= 6 THEN base END AS stance_base FROM best WHERE k = 1
"""

QUERIES = {f.__name__: f for f in (online_update, topic_names, matched_topics, folded_rows, class_balance, calibrated_stance)}
SQL = {"online_update": SQL_ONLINE, "topic_names": SQL_NAMES, "matched_topics": SQL_MATCHED, "folded_rows": SQL_FOLDED, "class_balance": SQL_BALANCE, "calibrated_stance": SQL_STANCE}
