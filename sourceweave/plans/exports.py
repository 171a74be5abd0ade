"""Queries over published exports: documents by language as topics, written in versions and read again, and what changed between two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave import shared
from sourceweave.sources import published
from sourceweave.sources.tables import scan


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles of a topic: their language and source."""
    return scan(spark, sf_dir, "documents", "doc_id", "lang", "source", "text").withColumn("topic", F.concat_ws("/", "lang", "source"))


def published_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the newest of two versions, whole texts, as its manifest and parts give them."""
    path = shared.scratch_path(spark, "published")
    rows = _articles(spark, sf_dir)
    published.publish(rows.where("doc_id % 2 = 0"), path)
    published.publish(rows, path)
    return published.published(spark, path).select("doc_id", "topic", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


SQL_PUBLISHED = "SELECT doc_id, concat_ws('/', lang, source) AS topic, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_sha256 FROM documents"


def topic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that are new, changed or gone in each of three versions: one without some documents, one without some sources, one with some texts in capitals."""
    path = shared.scratch_path(spark, "versions")
    rows, digit = _articles(spark, sf_dir), F.substring("source", -1, 1)
    published.publish(rows.where((F.col("doc_id") % 50 != 3) & (digit != "1")), path)
    published.publish(rows.where(digit != "2"), path)
    published.publish(rows.where(digit != "2").withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.upper("text")).otherwise(F.col("text"))), path)
    return published.changes_since(spark, path, 0, "topic")[0]


SQL_CHANGES = """
WITH d AS (SELECT concat_ws('/', lang, source) AS topic, doc_id, lang, source, text, right(source, 1) AS digit FROM documents),
v AS (SELECT 1 AS version, topic, doc_id, text FROM d WHERE doc_id % 50 <> 3 AND digit <> '1' UNION ALL SELECT 2, topic, doc_id, text FROM d WHERE digit <> '2'
  UNION ALL SELECT 3, topic, doc_id, CASE WHEN doc_id % 100 = 0 THEN upper(text) ELSE text END FROM d WHERE digit <> '2'),
t AS (SELECT version, topic, count(*) AS n, list(doc_id || ':' || text ORDER BY doc_id, text) AS held FROM v GROUP BY version, topic),
p AS (SELECT s.version, coalesce(a.topic, b.topic) AS topic, b.n AS n_before, a.n AS n_after, b.held AS old, a.held AS now FROM (SELECT unnest([1, 2, 3]) AS version) s
  JOIN (SELECT DISTINCT topic FROM v) k ON true LEFT JOIN t a ON a.version = s.version AND a.topic = k.topic LEFT JOIN t b ON b.version = s.version - 1 AND b.topic = k.topic)
SELECT CAST(version AS INTEGER) AS version, topic, CASE WHEN old IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' ELSE 'changed' END AS change, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after
FROM p WHERE old IS DISTINCT FROM now
"""

QUERIES = {f.__name__: f for f in (published_articles, topic_changes)}
SQL = {"published_articles": SQL_PUBLISHED, "topic_changes": SQL_CHANGES}
