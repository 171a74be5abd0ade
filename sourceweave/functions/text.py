"""Text predicates, cleaning and rewriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceweave.functions import fixed

SENTENCE_BREAK = r"(?<=[.!?])(?U)\s+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count_of(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in the class ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def short(text: Column) -> Column:
    """The beginning of a text that a classifier is shown."""
    return F.substring(_text(text), 1, 512)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def looks_like_text(text: Column) -> Column:
    """False for binary payloads: too many replacement or control characters, or too few letters."""
    s = _text(text)
    n = F.greatest(F.length(s), F.lit(1))
    share = lambda pattern: count_of(s, pattern) / n
    fit = (share("\ufffd") <= 0.01) & (share(CONTROL) <= 0.01) & (share(r"\p{L}") >= 0.45)
    return F.when(F.length(s) < 20, trimmed(s) != "").otherwise(fit)


def is_probably_english(text: Column, min_tokens: int = 12) -> Column:
    """A language guard: foreign letters, then the density of English function words; short texts pass."""
    s = _text(text)
    tokens = F.regexp_extract_all(s, F.lit("[a-zA-Z']+"), F.lit(0))
    hits = F.size(F.filter(tokens, lambda t: F.lower(t).isin(*fixed.ENGLISH_MARKERS)))
    foreign = count_of(s, f"[{fixed.FOREIGN_LETTERS}]") > F.length(s) * 0.004
    return F.when(foreign, False).when(F.size(tokens) < min_tokens, True).otherwise(hits / F.greatest(F.size(tokens), F.lit(1)) >= 0.04)


def is_informative_sentence(sentence: Column, min_words: int = 8, max_words: int = 70) -> Column:
    """A sentence that reports: of fair length, mostly letters, without site chrome or separators."""
    s = trimmed(_text(sentence))
    chrome = s.rlike("(?iuU)" + fixed.BOILERPLATE_SENTENCE) | s.rlike("[|•]")
    letters = count_of(s, r"\p{L}") / F.greatest(F.length(s), F.lit(1))
    return F.size(words(s)).between(min_words, max_words) & ~chrome & (letters >= 0.6) & looks_like_text(s)


def is_consent_url(url: Column) -> Column:
    return reduce(Column.__or__, [F.lower(_text(url)).contains(m) for m in fixed.CONSENT_URLS])


def is_consent_text(text: Column) -> Column:
    """Markers of a consent wall at the beginning of a text."""
    head = F.lower(F.substring(_text(text), 1, 3000))
    return reduce(Column.__or__, [head.contains(m) for m in fixed.CONSENT_TEXTS])


def clean_text(text: Column) -> Column:
    """Lines without boilerplate, cut where boilerplate begins, joined by single blanks."""
    lines = F.transform(F.split(_text(text), "\n"), trimmed)
    lines = F.filter(lines, lambda x: (x != "") & ~F.lower(x).isin(*fixed.BOILERPLATE_LINES))
    cut = lambda x: trimmed(reduce(lambda y, p: F.regexp_replace(y, "(?iuU)" + p, ""), fixed.LINE_CUTS, x))
    joined = F.array_join(F.filter(F.transform(lines, cut), lambda x: x != ""), " ")
    return trimmed(F.replace(trimmed(F.regexp_replace(joined, r"(?U)\s+", " ")), F.lit("\0"), F.lit("")))


def sentences(text: Column) -> Column:
    """Sentences of a text, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(_text(text), SENTENCE_BREAK), trimmed), lambda s: s != "")


def claims_of(summary: Column) -> Column:
    """The informative sentences of a summary, or all of them if none is."""
    every = sentences(summary)
    good = F.filter(every, lambda s: is_informative_sentence(s))
    return F.when(F.size(good) > 0, good).otherwise(every)


def strip_publisher_suffix(title: Column, publisher: Column | None = None) -> Column:
    """A headline without its trailing publisher, if that is the one announced or a known outlet."""
    t = trimmed(_text(title))
    pattern = "(?U)" + fixed.SUFFIX_PATTERN
    suffix = F.lower(trimmed(F.regexp_extract(t, pattern, 1)))
    said = F.lower(trimmed(_text(publisher))) if publisher is not None else F.lit("")
    own = (said != "") & (said.contains(suffix) | suffix.contains(said))
    return F.when((suffix != "") & (own | suffix.isin(*fixed.KNOWN_OUTLETS)), trimmed(F.regexp_replace(t, pattern, ""))).otherwise(t)


def clean_topic_title(name: Column) -> Column:
    """A topic's name as a title: without its number, each word once, capitalised unless in capitals."""
    n = trimmed(_text(name))
    bare = F.when(n.rlike(r"^-*\d+_"), F.regexp_replace(n, r"^-*\d+_", "")).otherwise(n)
    parts = words(F.translate(bare, "_", " "))
    lowered = F.transform(parts, F.lower)
    first = F.filter(parts, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1)
    shown = F.transform(first, lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))))
    title = F.array_join(shown, " ")
    return F.when(title == "", n).otherwise(title)


def topic_of(text: Column) -> Column:
    """The first of six topics whose words occur, else `general`."""
    low = F.lower(_text(text))
    topic = None
    for name, pattern in fixed.TOPIC_PATTERNS.items():
        hit = low.rlike("(?U)" + pattern)
        topic = F.when(hit, name) if topic is None else topic.when(hit, name)
    return topic.otherwise("general")


def search_query(claim: Column, max_words: int = 12) -> Column:
    """A news-search query from a claim: context clauses, attributions, artefacts and hedges dropped, words cut."""
    replaced = lambda start, steps: reduce(lambda out, step: F.regexp_replace(out, *step), steps, start)
    bare = trimmed(F.regexp_replace(F.regexp_replace(_text(claim), r"<[^>]*>", " "), r"(?U)\s+", " "))
    bare = replaced(bare, [(p, "") for p in fixed.QUERY_LEADS])
    speaker, substance = F.regexp_extract(bare, fixed.QUERY_ATTRIBUTION, 1), F.regexp_extract(bare, fixed.QUERY_ATTRIBUTION, 2)
    named = F.concat_ws(" ", F.slice(words(speaker), F.greatest(F.size(words(speaker)) - 3, F.lit(1)), F.lit(4)))
    said = F.when(F.size(words(substance)) >= 5, F.concat(named, F.lit(" "), substance)).otherwise(bare)
    plain = replaced(said, fixed.QUERY_CUTS)
    query = F.regexp_replace(F.array_join(F.slice(words(plain), 1, max_words), " "), r"[ .,\-]+$", "")
    return F.when(query != "", query).otherwise(F.array_join(F.slice(words(_text(claim)), 1, max_words), " "))


def stance(title: Column, text: Column, domain: Column) -> Column:
    """`debunk` for domains that check facts and for cues of a denial at the beginning, else `neutral`."""
    d = _text(domain)
    checker = reduce(Column.__or__, [(d == x) | d.endswith("." + x) for x in fixed.FACT_CHECK_DOMAINS])
    head = F.concat(_text(title), F.lit(" "), F.substring(_text(text), 1, 400))
    return F.when(checker | head.rlike("(?iuU)" + fixed.DENIAL), "debunk").otherwise("neutral")


def sensational_hits(text: Column) -> Column:
    """Distinct cues, up to three words in capitals and up to three exclamation marks."""
    s = _text(text)
    low = F.lower(s)
    cues = reduce(Column.__add__, [low.contains(t).cast("int") for t in fixed.SENSATIONAL_TERMS])
    shouted = F.size(F.filter(words(s), lambda w: (F.length(w) > 3) & (F.upper(w) == w) & (F.lower(w) != w)))
    return cues + F.least(shouted, F.lit(3)) + F.least(count_of(s, "!"), F.lit(3))


def sensational_share(title: Column | None, text: Column) -> Column:
    """How sensational an article is, from 0 to 1: hits for each hundred words, six being the most."""
    head = F.substring(_text(text), 1, 600)
    s = head if title is None else F.concat(_text(title), F.lit(" "), head)
    return F.least(F.lit(1.0), sensational_hits(s) / F.greatest(F.lit(1.0), F.size(words(s)) / 100) / 6.0)


def is_topic_request(topic: Column) -> Column:
    """A topic that a job may be asked for: 2 to 60 word characters, blanks and plain punctuation."""
    return F.coalesce(topic.rlike(r"\A[\w .,'&()\-]{2,60}\z"), F.lit(False))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def single_slashes(url: Column) -> Column:
    """`//` as `/`, but after a colon."""
    return F.regexp_replace(url, r"(?<!:)//", "/")


def escape_html(value: Column) -> Column:
    out = _text(value)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def report_reference(topic: Column, prefix: str = "REF") -> Column:
    """A checksum of a topic for its report: the sum of its character codes, and its first letters."""
    total = F.aggregate(F.transform(F.split(topic, ""), F.ascii), F.lit(0), lambda a, b: a + b)
    return F.concat(F.lit(prefix + "-"), F.lpad((total % 100000).cast("string"), 5, "0"), F.lit("-"), F.upper(F.substring(topic, 1, 3)))


def terms(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-case words of two or more word characters, stop words left out."""
    tokens = F.regexp_extract_all(F.lower(_text(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def with_bigrams(tokens: Column) -> Column:
    """Terms followed by the pairs of neighbouring ones."""
    n = F.size(tokens)
    pairs = F.when(n > 1, F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(1))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(tokens, F.coalesce(pairs, F.array().cast("array<string>")))
