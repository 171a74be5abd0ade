from __future__ import annotations

import base64
import hashlib

from sourceweave.llm import warc
from sourceweave.llm.common import scratch_path

PAGES = [
    (3, "https://a.com/1", "<p>one</p>"), (1, "https://a.com/2", "<p>one</p>"), (2, None, "<p>two</p>"), (4, "https://a.com/3", ""), (5, "u\r\nWARC-Type: evil", None),
    (6, "https://a.com/é", "été \U0001f642" * 5000), (1, "https://a.com/2", "<p>one</p>"), (None, "x", "<p>one</p>"), (None, "y", "alone"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id bigint, url string, html string, sha256 string, row int")


def test_round_trip(spark):
    found = warc.archive_round_trip(table(spark, PAGES)).collect()
    groups = {}
    for page, _, html in PAGES:
        groups.setdefault((html or "").encode(), []).append(page)
    want = []
    for payload, pages in groups.items():
        known = sorted(pages, key=lambda p: (p is None, p or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want += [(p, len(payload), digest, "revisit" if k else "response", known[0] if k else None) for k, p in enumerate(known)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_records_hold_what_was_written(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_archive(table(spark, PAGES), path)
    records = warc.read_records(spark, path).collect()
    assert len(records) == len(PAGES)
    assert sorted(bytes(r.payload) for r in records) == sorted((h or "").encode() for *_, h in PAGES)
    for r in records:
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        block = rest[: -len(b"\r\n\r\n")]
        assert len(block) == int(fields[b"Content-Length"])
        http, body = block.split(b"\r\n\r\n", 1)
        assert body == (bytes(r.payload) if fields[b"WARC-Type"] == b"response" else b"") and b"\r\n" + b"WARC-Type: evil" not in head
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({(h or "") for *_, h in PAGES})


def test_empty(spark):
    assert warc.archive_round_trip(table(spark, [])).count() == 0


def test_a_payload_of_a_third_of_all_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 10)
    rows = [(i, f"https://a.com/{i}", "hot" if i % 3 == 0 else f"page {i}") for i in range(300)]
    path = scratch_path(spark, "test-warc-hot")
    warc.write_archive(table(spark, rows), path)
    stored = spark.read.parquet(f"{path}/records")
    hot = stored.groupBy("sha256", "share").count().agg({"count": "max"}).first()[0]
    assert hot < 40 and stored.count() == 300
    facts = {r.page_id: r for r in warc.read_facts(spark, path).collect()}
    assert len(facts) == 300 and facts[3].refers_to == 0 and facts[3].payload_bytes == 3 and facts[1].record_type == "response"


def test_facts_come_from_the_record_bytes(spark, tmp_path):
    """A header that states another length, or another digest, than the record has stops the reader."""
    import pytest
    from pyspark.sql import functions as F

    path = scratch_path(spark, "test-warc-bad")
    warc.write_archive(table(spark, PAGES), path)
    header = F.col("header").cast("string")
    for name, bad in (("length", F.regexp_replace(header, "(\r\nContent-Length: )", "$11")), ("digest", F.regexp_replace(header, "sha1:[A-Z2-7]", "sha1:0"))):
        spark.read.parquet(f"{path}/records").withColumn("header", bad.cast("binary")).write.parquet(f"file://{tmp_path}/{name}/records")
        spark.read.parquet(f"{path}/payloads").write.parquet(f"file://{tmp_path}/{name}/payloads")
        with pytest.raises(Exception, match="a record doesn't have|a header doesn't have"):
            warc.read_facts(spark, f"file://{tmp_path}/{name}").collect()
