from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceweave import hooks
from sourceweave.operators import dedup, topics
from sourceweave.plans import batch
from sourceweave.sources import tables


def corpus(spark, n):
    kinds = ("The central committee agreed on Tuesday to lower the interest rate by half a point. ", "A large storm crossed the northern coast and left many thousand homes without any power. ", "The football club signed a young striker from the island team on a contract of four years. ")
    rows = [(i, f"Title {i} of {i % 3}", kinds[i % 3] * 6 + f"Number {i} said so to word{i} and name{i} there.", f"https://www.site{i % 7}.com/{i}", f"2024-02-{1 + i % 28:02d}", True) for i in range(n)]
    rows += [(n, "Title 0 of 0", "again", "https://x.com", None, True), (n + 1, "New title", rows[1][2], "https://y.com", "soon", None), (n + 2, "No text", None, None, None, None)]
    made = spark.createDataFrame(rows, "ord bigint, title string, text string, url string, publish_date string, body_available boolean")
    return made.withColumns({"publisher": F.lit(None).cast("string"), "publisher_url": F.lit(None).cast("string")})


def test_batch(spark):
    found = batch.run_batch(corpus(spark, 30), hooks.hash_words(64), threshold=0.999, generated_at="now")
    rows = found.corpus.count()
    assert 25 <= rows <= 31
    assert found.counts.agg(F.sum("n")).first()[0] == rows
    assert found.over_time.agg(F.sum("frequency")).first()[0] == found.corpus.where("publish_date like '2024%'").count()
    topics = tables.read_export(found.document).collect()
    assert sum(len(t.articles) for t in topics) == rows and all(5 <= t.formulaBreakdown.finalScore <= 99 for t in topics)
    assert all(len(a.coherenceScores) == len(t.articles) - 1 for t in topics for a in t.articles)
    large = tables.read_export(batch.run_batch(corpus(spark, 30), hooks.hash_words(64), threshold=0.999, matrix_rows=1).document).collect()
    assert all(5 <= t.formulaBreakdown.finalScore <= 99 and not a.coherenceScores for t in large for a in t.articles)
    assert all(t.formulaBreakdown.sourceCoherence != 0.5 for t in large if len(t.articles) > 1)


def test_agreement_of_large_topics(spark):
    found = batch.run_batch(corpus(spark, 30), hooks.hash_words(64), threshold=0.999, matrix_rows=1)
    rows = found.corpus.select("topic_id", "ord", "embedding").collect()
    unit = {r.ord: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows}
    want = {(a.topic_id, a.ord, b.ord): float(unit[a.ord] @ unit[b.ord]) for a in rows for b in rows if a.topic_id == b.topic_id and a.ord < b.ord}
    assert len(want) > len(rows)
    for table in (found.agreement, dedup.cosine_pairs(found.corpus, "topic_id", "ord", "embedding", block=4)):
        got = table.collect()
        assert len(got) == len(want) and {(r.topic_id, r.i, r.j): r.cosine for r in got} == pytest.approx(want)


def test_rare_hosts_are_no_terms(spark):
    name = F.concat(F.lit("site"), F.col("ord") % 7)
    named = corpus(spark, 30).withColumn("title", F.concat(F.repeat(F.concat(name, F.lit(" ")), 20), "title"))
    names = batch.run_batch(named, hooks.hash_words(64), threshold=0.999, stop_hosts=1).names.collect()
    assert names and not any("site" in r.topic_name for r in names)
    docs = spark.createDataFrame([(1, "alpha site5 beta gamma"), (1, "site5 site6"), (2, "beta site6 gamma")], "k int, t string")
    hosts = spark.createDataFrame([("site5",), ("site6",)], "word string")
    by_join, by_list = (topics.term_counts(docs, "k", "t", **how).orderBy("k", "term").collect() for how in ({"more": hosts}, {"stop": ("site5", "site6")}))
    assert by_join == by_list and ("alpha beta" in {r.term for r in by_join})


def test_enrichment(spark):
    """What the caller's models say reaches the export: sentiment, places, key phrases and summaries."""
    how = batch.Enrichment(
        sentiment=lambda c: F.struct(F.when(c.contains("storm"), "NEGATIVE").otherwise("POSITIVE").alias("label"), F.lit(0.91).alias("score")),
        places=lambda c: F.when(c.contains("coast"), F.array(F.lit("Coast"), F.lit("North"), F.lit("Coast"))).otherwise(F.array().cast("array<string>")),
        summarise=lambda c: F.when(c.contains("football"), "A model's summary."), phrases=2,
    )
    found = batch.run_batch(corpus(spark, 30), hooks.hash_words(64), threshold=0.999, enrichment=how)
    rows = found.corpus.collect()
    assert {(r.sentiment, r.sentiment_value) for r in rows if "storm" in r.text} == {("NEGATIVE", -0.91)} and {r.locations for r in rows if "coast" in r.text} == {"Coast, North"}
    assert all(1 <= len(r.keyphrases.split(", ")) <= 2 for r in rows)
    nodes = tables.read_export(found.document).collect()
    assert any(n.intelligenceSummary == "A model's summary." for n in nodes) and any(n.locations == ["Coast", "North"] for n in nodes)
    assert {a.sentiment for n in nodes for a in n.articles} == {"POSITIVE", "NEGATIVE"} and all("OSINT" not in n.keywords for n in nodes)


def test_a_batch_of_too_few_rows(spark):
    with pytest.raises(ValueError, match="6 rows"):
        batch.run_batch(corpus(spark, 30).limit(5), hooks.hash_words(16))


def test_every_topic_has_its_matrix(spark):
    """No size of a topic changes what the document holds unless the caller names one."""
    found = tables.read_export(batch.run_batch(corpus(spark, 260), hooks.hash_words(4096), threshold=0.99999, k=1).document).first()
    assert len(found.articles) > 200 and all(len(a.coherenceScores) == len(found.articles) - 1 for a in found.articles)
