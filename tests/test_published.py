from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sourceweave.sources import published


def topics(spark, rows):
    return spark.createDataFrame(rows, "topic string, ord bigint, title string, vector array<double>")


ROWS = [("a", 1, "one", [1.0, 2.0]), ("a", 2, None, []), ("b", 1, "x" * 5000, None), (None, 1, "none", [0.5])]


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/export"


def test_a_version_is_what_was_published(spark, path):
    assert published.versions(path) == []
    with pytest.raises(LookupError):
        published.manifest(path)
    assert published.publish(topics(spark, ROWS).repartition(3), path) == 1
    assert sorted(published.published(spark, path).collect(), key=str) == sorted(topics(spark, ROWS).collect(), key=str)
    assert published.publish(topics(spark, ROWS[:1]), path) == 2
    assert published.published(spark, path).count() == 1 and published.published(spark, path, 1).count() == 4
    assert published.publish(topics(spark, ROWS).limit(0), path) == 3
    assert published.published(spark, path).schema == topics(spark, ROWS).schema and published.published(spark, path).isEmpty()
    with pytest.raises(LookupError):
        published.manifest(path, 9)


def test_a_large_topic_lies_in_several_parts(spark, path):
    rows = spark.range(60000).select(F.lit("hot").alias("topic"), "id", F.repeat(F.lit("word "), 20).alias("text")).repartition(2)
    published.publish(rows, path, part_bytes=500_000)
    told = published.manifest(path)
    assert len(told["parts"]) > 2 and told["rows"] == 60000 == sum(p["rows"] for p in told["parts"])
    assert published.published(spark, path).select("id").distinct().count() == 60000


def test_a_job_that_fails_leaves_the_version_before(spark, path, tmp_path):
    published.publish(topics(spark, ROWS), path)
    before = published.manifest(path)
    broken = topics(spark, ROWS).repartition(2).withColumn("title", F.when(F.col("topic") == "b", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("title")))
    with pytest.raises(Exception, match="broken"):
        published.publish(broken, path)
    assert published.versions(path) == [1] and published.manifest(path) == before
    assert published.published(spark, path).count() == 4
    assert len(list((tmp_path / "export" / "parts").iterdir())) == 1
    assert published.publish(topics(spark, ROWS), path) == 2


def test_parts_without_a_manifest_do_not_count(spark, path, tmp_path):
    published.publish(topics(spark, ROWS), path)
    stray = tmp_path / "export" / "parts" / "stray"
    stray.mkdir()
    (stray / "000000-0-0000.parquet").write_bytes(b"half a file")
    (tmp_path / "export" / "versions" / "0000000002-x.draft").write_text("{")
    assert published.versions(path) == [1] and published.published(spark, path).count() == 4
    published.publish(topics(spark, ROWS), path)
    published.publish(topics(spark, ROWS[:2]), path)
    assert published.expire(path, 2) == [1] and not stray.exists()
    assert published.published(spark, path, 2).count() == 4 and published.published(spark, path).count() == 2
    with pytest.raises(LookupError):
        published.changes_since(spark, path, 0, "topic")


def test_changes_by_topic(spark, path):
    published.publish(topics(spark, ROWS), path)
    published.publish(topics(spark, [ROWS[1], ROWS[0], ("c", 1, "new", None), (None, 1, "other", [0.5])]), path)
    published.publish(topics(spark, [ROWS[1], ROWS[0], ROWS[0], (None, 1, "other", [0.5])]), path)
    found, at = published.changes_since(spark, path, 1, "topic")
    told = {(r.version, r.topic): (r.change, r.n_before, r.n_after) for r in found.collect()}
    assert at == 3
    assert told == {(2, "b"): ("gone", 1, 0), (2, "c"): ("new", 0, 1), (2, None): ("changed", 1, 1), (3, "c"): ("gone", 1, 0), (3, "a"): ("changed", 2, 3)}
    first, _ = published.changes_since(spark, path, 0, "topic")
    assert sorted(r.change for r in first.where("version = 1").collect()) == ["new"] * 3
    assert published.changes_since(spark, path, 3, "topic") == (None, 3)
