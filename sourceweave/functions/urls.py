"""From URLs and publisher names to the identity of a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceweave.functions import fixed


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, fixed.HOST_PREFIX, "")


def registrable_domain(url: Column) -> Column:
    """Lower-case host without one leading service prefix; '' where there is no host."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    # a host with characters that the URI syntax lacks (an underscore) is still a host
    loose = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1))
    return _bare(F.when(host != "", host).otherwise(loose))


def is_aggregator(url_or_host: Column) -> Column:
    """True for hosts that only pass articles on. A URL's host loses its prefix twice, as its domain does once more."""
    given = F.coalesce(url_or_host, F.lit(""))
    host = _bare(F.when(given.contains("//"), registrable_domain(given)).otherwise(F.lower(given)))
    return host.isin(*fixed.AGGREGATOR_HOSTS) | host.endswith(fixed.AGGREGATOR_SUFFIX)


def publisher_domain(url: Column, publisher_url: Column | None = None) -> Column:
    """The first domain, of the publisher's URL and then the article's, that is no aggregator's; else ''."""
    usable = [F.when((registrable_domain(u) != "") & ~is_aggregator(u), registrable_domain(u)) for u in (publisher_url, url) if u is not None]
    return F.coalesce(*usable, F.lit(""))


def name_key(publisher: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(publisher, F.lit(""))), r"(?U)\s+", " "))


def source_identity(url: Column, publisher_url: Column | None = None, publisher: Column | None = None) -> Column:
    """The publisher's domain, else the domain its name stands for, else `name:` and the name, else ''."""
    domain = publisher_domain(url, publisher_url)
    if publisher is None:
        return domain
    name = name_key(publisher)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in fixed.PUBLISHER_DOMAINS.items() for x in pair]), name)
    return F.when(domain != "", domain).when(name == "", "").otherwise(F.coalesce(known, F.concat(F.lit("name:"), name)))


def decode_redirect(url: Column) -> Column:
    """The URL that the base64 part of an article redirect carries; the URL itself where it carries none."""
    part = F.regexp_extract(url, r"/articles/([^?/]*)", 1)
    padded = F.rpad(F.translate(part, "-_", "+/"), (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    plain = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    found = F.regexp_extract(plain, r"https?://[a-zA-Z0-9.\-_~:/?#\[\]@!$&'()*+,;=%]+", 0)
    return F.when(url.contains("/articles/") & (found != ""), found).otherwise(url)


def safe_href(url: Column) -> Column:
    """A URL fit for a link: only http and https, `#` otherwise."""
    return F.when(F.coalesce(url, F.lit("")).rlike("(?i)^https?://"), url).otherwise(F.lit("#"))
