"""A content-addressed WARC archive.

Two tables under one path: ``payloads`` (each distinct payload once, under its SHA-256, with the number of records that
refer to it) and ``records`` (the exact header bytes of each record, with the SHA-256 of its payload). A record is put
together again by a join, and all that is read of an archive is read from the bytes of such records. Records of a payload that is already there are `revisit` records that refer to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.llm.common import lookup, materialise, scratch_path

WARC_DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records that meet one copy of their payload, about.
RECORDS = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEADER = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: five hexadecimal digits make four characters."""
    out = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def _safe(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")


def _headers() -> Column:
    """Header bytes of a record: the WARC header, an empty line and the HTTP header with its empty line."""
    http = F.concat(F.lit(f"{HTTP_HEADER}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda column: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn("page_id")), line("WARC-Target-URI", _safe(F.col("url"))),
        F.lit(f"WARC-Date: {WARC_DATE}{CRLF}"), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("first_id")), F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), line("Content-Length", block.cast("string")), F.lit(CRLF),
    )
    return F.concat(warc, http).cast("binary")


def _shares() -> Column:
    """Copies of a payload that are dealt out when records are read: one for each RECORDS of them (column refs)."""
    return F.floor(F.col("refs") / RECORDS).cast("int") + 1


def write_archive(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) as a content-addressed archive under ``path``.

    The payload is the html in UTF-8 (null: empty). Of equal payloads (SHA-256, SHA-1 and length), empty ones
    included, the record of the smallest page_id is the response and the others revisit it; null page_ids come after
    all others; of rows that repeat a page_id the first is the response. Line breaks in a url are escaped.
    An empty table makes an empty archive.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256))
    facts = materialise(rows.select("page_id", F.monotonically_increasing_id().alias("row"), "url", digest.alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("payload_bytes")), "warc-facts")
    key = ["sha256", "sha1", "payload_bytes"]
    rank = F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "row")
    first = facts.groupBy(*key).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("refs")).select(*key, F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"), "refs")
    typed = lookup(facts, key, first, F.col("row")).withColumn("record_type", F.when(F.col("row") == F.col("first_row"), "response").otherwise("revisit"))
    typed = typed.withColumn("sha1", base32_of_hex(F.col("sha1")))
    typed.select("page_id", "row", "sha256", F.pmod("row", _shares()).cast("int").alias("share"), _headers().alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    rows.groupBy(digest.alias("sha256")).agg(F.any_value("payload").alias("payload"), F.count(F.lit(1)).alias("refs")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    records = spark.read.schema("page_id bigint, row bigint, sha256 binary, share int, header binary").parquet(f"{path}/records")
    payloads = spark.read.schema("sha256 binary, payload binary, refs bigint").parquet(f"{path}/payloads")
    proven = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload doesn't have its digest")))
    return records, payloads.select("sha256", proven.alias("payload"), "refs")


def field(header: Column, name: str) -> Column:
    """A field of the WARC header of a record, null if it has none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload, record (bytes): the records of an archive as a WARC file holds them.

    A response has its payload in its block, a revisit has not; ``payload`` is the full payload of either. A payload
    that many records share is dealt to as many copies as there are thousands of them, so no task gets all. An
    empty archive has no records.
    """
    records, payloads = _tables(spark, path)
    copies = payloads.withColumn("share", F.explode(F.sequence(F.lit(0), _shares() - 1))).drop("refs")
    whole = records.join(copies, ["sha256", "share"])
    body = F.when(field(F.col("header").cast("string"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return whole.select("page_id", "header", "payload", F.concat(F.col("header"), body, F.lit(CRLF * 2).cast("binary")).alias("record"))


def _proven(value: Column, holds: Column, fault: str) -> Column:
    return F.when(holds, value).otherwise(F.raise_error(F.lit(fault)))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the bytes of an archive's records.

    A record is cut into WARC header, block and end; the block, whose length the header must state, into HTTP header and
    body. The body of a response is its payload; that of a revisit is empty, and its payload is the one that
    :func:`read_records` joined to it. Length and digest are worked out from that payload; a record whose headers say
    otherwise stops the query. Page_ids may be null or repeat; an empty payload is one like any other.
    """
    ends = CRLF * 2
    cut = read_records(spark, path).select("page_id", "payload", "record", F.substring_index(F.col("record").cast("string"), ends, 1).alias("_warc"))
    at = F.octet_length("_warc")
    block = F.substring(F.col("record"), at + len(ends) + 1, F.octet_length("record") - at - 2 * len(ends))
    cut = cut.withColumns({"_warc": F.concat("_warc", F.lit(CRLF)), "_block": block, "_tail": F.substring(F.col("record"), F.octet_length("record") - len(ends) + 1, F.lit(len(ends))).cast("string")}).drop("record")
    stated = lambda text, name: F.regexp_extract(text, rf"\r\n{name}: ([0-9]+)\r\n", 1).cast("bigint")
    whole = (stated(F.col("_warc"), "Content-Length") == F.octet_length("_block")) & (F.col("_tail") == ends)
    cut = cut.withColumn("_block", _proven(F.col("_block"), whole, "a record doesn't have the length its header states")).withColumn("_http", F.substring_index(F.col("_block").cast("string"), ends, 1))
    kind = field(F.col("_warc"), "WARC-Type")
    body = F.substring(F.col("_block"), F.octet_length("_http") + len(ends) + 1, F.octet_length("_block"))
    read = cut.select("page_id", kind.alias("record_type"), "_warc", F.concat("_http", F.lit(CRLF)).alias("_http"), F.when(kind == "response", body).otherwise(F.col("payload")).alias("_full"))
    size, digest = F.octet_length("_full").cast("bigint"), base32_of_hex(F.sha1("_full"))
    measured = read.withColumns({"_size": size, "_digest": digest})
    refers = F.regexp_extract(F.coalesce(field(F.col("_warc"), "WARC-Refers-To"), F.lit("")), "^<urn:page:(.*)>$", 1)
    return measured.select(
        "page_id", _proven(F.col("_size"), stated(F.col("_http"), "Content-Length") == F.col("_size"), "a record doesn't have its payload's length").alias("payload_bytes"),
        _proven(F.col("_digest"), F.concat(F.lit("sha1:"), F.col("_digest")) == field(F.col("_warc"), "WARC-Payload-Digest"), "a header doesn't have its payload's digest").alias("payload_digest"),
        "record_type", F.when(refers != "", refers.cast("bigint")).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read its records back: see :func:`read_facts`.

    One row a page, null and repeated page_ids included; an empty table gives an empty result. Columns beyond page_id, url and html are not read.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_facts(pages.sparkSession, path)
