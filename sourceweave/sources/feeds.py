"""News feeds: RSS documents to candidates, tiers of sources, and the hooks that fetch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.functions import text, urls
from sourceweave.operators.timebins import parse_date
from sourceweave.sources.html import strip_tags

CANDIDATE = "title string, url string, date string, snippet string, publisher string, publisher_url string"
#: Fetches (topic, limit) from one source into CANDIDATE rows: what reaches the network is the caller's.
Fetch = Callable[[str, int], DataFrame]

FIRST_YEAR = 2024


def _tag(item: Column, name: str) -> Column:
    inner = F.regexp_extract(item, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")


def parse_feed(feeds: DataFrame, xml: str = "xml", keep: tuple[str, ...] = (), today: Column | None = None, limit: int = 50) -> DataFrame:
    """Candidates of RSS documents, at most ``limit`` a document, in order (column nth).

    Items before FIRST_YEAR go; a date that can't be read counts as ``today``. A snippet that says no more than title and
    publisher is blank; redirects are decoded where their address is inside.
    """
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<item[\s>].*?</item>"), F.lit(0))
    rows = feeds.withColumn("_doc", F.monotonically_increasing_id()).select("_doc", *keep, F.posexplode(items).alias("nth", "item"))
    source = F.regexp_extract("item", r'(?is)<source[^>]*\burl="([^"]*)"', 1)
    when = parse_date(_tag(F.col("item"), "pubDate"))
    fields = rows.select(
        "_doc", *keep, "nth", strip_tags(_tag(F.col("item"), "title")).alias("title"), urls.decode_redirect(F.trim(strip_tags(_tag(F.col("item"), "link")))).alias("url"),
        F.date_format(F.coalesce(when, (today if today is not None else F.current_timestamp()).cast("timestamp")), "yyyy-MM-dd").alias("date"),
        strip_tags(strip_tags(_tag(F.col("item"), "description"))).alias("snippet"), strip_tags(_tag(F.col("item"), "source")).alias("publisher"), source.alias("publisher_url"),
    )
    plain = lambda c: F.lower(F.regexp_replace(c, r"(?U)[\W_]+", ""))
    bare = F.replace(F.replace(plain(F.col("snippet")), plain(text.strip_publisher_suffix(F.col("title"), F.col("publisher")))), plain(F.col("publisher")))
    kept = fields.where((F.col("title") != "") & (F.substring("date", 1, 4).cast("int") >= FIRST_YEAR)).withColumn("snippet", F.when(bare == "", "").otherwise(F.col("snippet")))
    rank = Window.partitionBy("_doc").orderBy("nth")
    return kept.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= limit).drop("_n", "_doc")


def first_tier(candidates: DataFrame, topic: str = "topic", tier: str = "tier") -> DataFrame:
    """The rows of each topic's first tier that has any."""
    first = candidates.groupBy(topic).agg(F.min(tier).alias(tier))
    return candidates.join(first, [topic, tier], "left_semi")


def search_hits(rows: DataFrame, limit: int, order: str, body: str = "body") -> DataFrame:
    """Hits of a search with a date and an address, of this age, with some text, in English: ``limit`` of them."""
    dated = rows.where(F.col("url").isNotNull() & (F.col("url") != "") & F.col("date").isNotNull()).where(F.substring("date", 1, 4).cast("int") >= FIRST_YEAR)
    some = (F.length(F.coalesce(body, F.lit(""))) >= 300) | (F.length(F.coalesce("snippet", F.lit(""))) >= 50)
    english = text.is_probably_english(F.concat_ws(" ", "title", "snippet", F.when(text.looks_like_text(F.col(body)), F.substring(body, 1, 2000))))
    return dated.where(some & english).orderBy(order).limit(limit)


def page_hits(links: DataFrame, host: str, limit: int, order: str) -> DataFrame:
    """Hits read from a page of links (title, url): titles of twelve characters, addresses once, none of ``host`` itself."""
    outside = links.where((F.length("title") >= 12) & ~urls.registrable_domain(F.col("url")).endswith(host) & F.col("url").rlike("^https?://"))
    once = Window.partitionBy("url").orderBy(order)
    return outside.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n").orderBy(order).limit(limit)
