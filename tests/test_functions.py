from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sourceweave.functions import scores, text, urls, vectors
from sourceweave.functions.scores import DEFAULT


def column(spark, values, kind, build):
    """What ``build`` makes of each value, in one job."""
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, v {kind}")
    return [r.out for r in rows.select("n", build(F.col("v")).alias("out")).orderBy("n").collect()]


def test_domains(spark):
    given = ["https://www.reuters.com/x", "http://m.news.bbc.co.uk/a", "https://blog.example.com", "not a url", "", None, "http://user:pw@Edition.CNN.com:80/x"]
    assert column(spark, given, "string", urls.registrable_domain) == ["reuters.com", "news.bbc.co.uk", "blog.example.com", "", "", "", "cnn.com"]


def test_aggregators_lose_their_prefix_twice(spark):
    given = ["https://news.google.com/rss", "https://news.search.yahoo.com/q", "msn.com", "https://www.reuters.com", "feedproxy.google.com", "www.bing.com"]
    assert column(spark, given, "string", urls.is_aggregator) == [True, False, True, False, True, True]


def test_source_identity(spark):
    rows = spark.createDataFrame(
        [
            (0, "https://news.google.com/x", "https://www.wsj.com", "WSJ"), (1, "https://news.sky.com/x", None, None), (2, "https://www.msn.com/a", None, "Sky  News"),
            (3, "https://msn.com", "", "Daily Planet "), (4, "https://msn.com", None, None), (5, None, None, " "),
        ],
        "n int, u string, p string, name string",
    )
    found = [r.s for r in rows.select("n", urls.source_identity(F.col("u"), F.col("p"), F.col("name")).alias("s")).orderBy("n").collect()]
    assert found == ["wsj.com", "sky.com", "news.sky.com", "name:daily planet", "", ""]


def test_redirects(spark):
    import base64

    inner = base64.urlsafe_b64encode(b"\x08\x13\x22 https://www.example.com/a-b?c=1\xd2\x01").decode().rstrip("=")
    given = [f"https://news.google.com/rss/articles/{inner}?oc=5", "https://news.google.com/rss/articles/????", "https://x.com/a", None]
    assert column(spark, given, "string", urls.decode_redirect) == ["https://www.example.com/a-b?c=1", given[1], given[2], None]


def test_looks_like_text(spark):
    given = ["short", "   ", None, "", "a" * 30, "1234567890" * 5, "abc\x01" * 20, "letters and more letters " * 4, "café " * 10, "�" * 5 + "a" * 100]
    assert column(spark, given, "string", text.looks_like_text) == [True, False, False, False, True, False, False, True, True, False]


def test_english_guard(spark):
    given = ["the cat", "die katze sitzt auf dem dach und schaut über den garten hinaus zum zaun", "the cat is on the roof and it looks to the garden for a bird", "și țara mea este foarte frumoasă și mare", None]
    assert column(spark, given, "string", text.is_probably_english) == [True, False, True, False, True]


def test_informative_sentences(spark):
    good = "The committee agreed on Tuesday to lower the rate by half a point."
    given = [good, "Too short.", "Subscribe to our newsletter for more of the best stories every single day.", "one | two three four five six seven eight nine", "word " * 71, None, "1 2 3 4 5 6 7 8 9 10 eleven"]
    assert column(spark, given, "string", text.is_informative_sentence) == [True, False, False, False, False, False, False]


def test_clean_text(spark):
    given = ["A line.\n  Read more \nB goes on. Click here for more\n\nLoading...\n© 2024 All\nC  d\x00", None, "", "Loading"]
    assert column(spark, given, "string", text.clean_text) == ["A line. B goes on. C d", "", "", ""]


def test_sentences_and_claims(spark):
    assert column(spark, ["One. Two!  Three? Four", "", None], "string", text.sentences) == [["One.", "Two!", "Three?", "Four"], [], []]
    long = "The committee agreed on Tuesday to lower the rate by half a point."
    assert column(spark, [f"Hm. {long}", "Hm. Ha."], "string", text.claims_of) == [[long], ["Hm.", "Ha."]]


@pytest.mark.parametrize(
    ("title", "publisher", "want"),
    [
        ("Rates rise - Reuters", None, "Rates rise"), ("Rates rise - Daily Planet", "The Daily Planet", "Rates rise"), ("Rates rise - again", None, "Rates rise - again"), ("A — b | CNN", None, "A — b"),
        ("Plain", "Plain", "Plain"), (None, None, ""),
    ],
)
def test_publisher_suffix(spark, title, publisher, want):
    row = spark.createDataFrame([(title, publisher)], "t string, p string").select(text.strip_publisher_suffix(F.col("t"), F.col("p")).alias("o")).first()
    assert row.o == want


def test_topic_titles(spark):
    given = ["8_election_primary_2026_midterm", "-1_outliers", "3_rate rates_Rate", "4_NATO_nato summit", "plain words", "", "7_"]
    assert column(spark, given, "string", text.clean_topic_title) == ["Election Primary 2026 Midterm", "Outliers", "Rate Rates", "NATO Summit", "Plain Words", "", "7_"]


def test_search_queries(spark):
    given = ["In August 2026, Senator Bob Smith said that the new tax on imported steel will end next year", "A video circulating online shows the mayor of a town dancing", "“Reportedly the moon, it is closer.”", ""]
    found = column(spark, given, "string", text.search_query)
    assert found[0] == "Senator Bob Smith the new tax on imported steel will end next"
    assert found[2] == "the moon it is closer"
    assert found[3] == ""


def test_stance_and_topic(spark):
    rows = spark.createDataFrame([(0, "No evidence", "", "x.com"), (1, "All well", "quiet", "www.snopes.com"), (2, "All well", "quiet", "notsnopes.com"), (3, None, None, None)], "n int, t string, b string, d string")
    assert [r.s for r in rows.select("n", text.stance(F.col("t"), F.col("b"), F.col("d")).alias("s")).orderBy("n").collect()] == ["debunk", "debunk", "neutral", "neutral"]
    assert column(spark, ["The Senate votes on a vote", "war", "price", "covid", "AI", "earth", "none", None], "string", text.topic_of) == ["politics", "conflict", "economy", "health", "technology", "science", "general", "general"]


def test_sensational(spark):
    assert column(spark, ["SHOCKING truth!!!! exposed", "calm words", None], "string", text.sensational_hits) == [3 + 1 + 3, 0, 0]


def test_report_reference_and_escape(spark):
    assert column(spark, ["abc"], "string", text.report_reference) == ["REF-00294-ABC"]
    assert column(spark, ["<a href=\"x\">'&'</a>", None], "string", text.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&#039;&amp;&#039;&lt;/a&gt;", ""]
    assert column(spark, ["https://a//b", "a//b"], "string", text.single_slashes) == ["https://a/b", "a/b"]


def test_terms_and_bigrams(spark):
    assert column(spark, ["The big Été a x1", "", None], "string", lambda c: text.with_bigrams(text.terms(c, ("the",)))) == [["big", "été", "x1", "big été", "été x1"], [], []]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(
        vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("z"), vectors.unit(F.col("a")).alias("u"), vectors.distance(F.col("a"), F.col("b")).alias("d")
    ).first()
    assert row.c == pytest.approx(0.96) and row.z == 0 and row.u == pytest.approx([0.6, 0.8]) and row.d == pytest.approx(2**0.5)


def test_triangles(spark):
    m = [[1.0, 0.1, 0.2], [0.1, 1.0, 0.3], [0.2, 0.3, 1.0]]
    assert column(spark, [m, None], "array<array<double>>", vectors.upper_triangle) == [[0.1, 0.2, 0.3], []]
    assert column(spark, [[[0.1, 0.2], [0.1, 0.3], [0.2, 0.3]]], "array<array<double>>", vectors.triangle_of_others) == [[0.1, 0.2, 0.3]]


def score(spark, sims, sources, upper, params=DEFAULT, support=None):
    rows = spark.createDataFrame([(sims, sources, upper, support)], "s array<double>, d array<string>, u array<double>, p double")
    return rows.select(*[c.alias(k) for k, c in scores.score_arrays(F.col("s"), F.col("d"), F.col("u"), params.columns(), F.col("p")).items()]).first()


def test_score_formula(spark):
    r = score(spark, [0.9, 0.8, 0.7, 0.2], ["a", "b", "c", "d", "a", "", None], [0.8] * 6)
    assert (round(r.semantic_score, 2), r.source_factor, round(r.coherence_factor, 4), r.final_score, r.n_sources) == (86.0, 0.95, 0.94, 76, 4)
    assert r.sources == ["a", "b", "c", "d"] and not r.flagged


@pytest.mark.parametrize(("n", "factor"), [(7, 1.0), (5, 1.0), (4, 0.95), (3, 0.85), (2, 0.72), (1, 0.60), (0, 0.60)])
def test_ladder(spark, n, factor):
    assert score(spark, [0.5], [str(i) for i in range(n)], []).source_factor == factor


def test_score_edges(spark):
    top = score(spark, [1.0] * 5, list("abcde"), [1.0] * 10)
    assert top.final_score == 99 and not top.flagged
    lone = score(spark, [0.9], ["a"], [])
    assert (lone.source_coherence, round(lone.coherence_factor, 2), lone.source_factor) == (0.5, 0.85, 0.6)
    none = score(spark, None, None, None)
    assert (none.avg_similarity, none.n_sources) == (0.0, 0)
    assert score(spark, [0.959197, 0.795958], ["a", "b"], [0.693206]).final_score == 59


def test_stance_factor_is_off_by_default(spark):
    base = score(spark, [0.9], ["a", "b"], [0.5])
    assert score(spark, [0.9], ["a", "b"], [0.5], DEFAULT, 0.0).final_score == base.final_score
    assert score(spark, [0.9], ["a", "b"], [0.5], DEFAULT.with_values(stance_base=0.5), 0.0).final_score < base.final_score


STRESS = {
    85: ([0.9811, 0.8189, 0.7926, 0.7398, 0.8524], [0.8275, 0.7811, 0.7375, 0.8608, 0.6848, 0.6960, 0.8418, 0.6802, 0.7678, 0.7394], 91.89, 0.9285),
    71: ([0.9804, 0.5288, 0.5764, 0.4932, 0.7051], [0.5117, 0.5647, 0.4638, 0.7044, 0.5168, 0.5849, 0.5389, 0.5418, 0.4124, 0.4563], 82.78, 0.8589),
    79: ([0.9743, 0.8081, 0.7982, 0.5288, 0.5586], [0.8226, 0.7854, 0.5255, 0.5489, 0.7028, 0.5445, 0.4901, 0.4778, 0.5393, 0.5057], 90.21, 0.8783),
}


@pytest.mark.parametrize("want", list(STRESS))
def test_stress_cohorts(spark, want):
    sims, upper, semantic, coherence = STRESS[want]
    r = score(spark, sims, list("abcde"), upper)
    assert r.final_score == want
    assert r.semantic_score == pytest.approx(semantic, abs=0.05) and r.coherence_factor == pytest.approx(coherence, abs=0.0005)


def test_labels_of_scores(spark):
    assert column(spark, [6, 5, 4, 3, 2, 1, 0], "int", scores.consensus) == ["STRONG", "STRONG", "GOOD", "MODERATE", "WEAK", "SINGLE-SOURCE", "SINGLE-SOURCE"]
    assert column(spark, [80, 79, 75, 74, 51, 50], "int", scores.confidence) == ["high", "moderate", "moderate", "low", "low", "flagged"]
    assert column(spark, [0.86, 0.85, 0.4, 0.39], "double", scores.agreement) == ["strong", "neutral", "neutral", "weak"]


def test_sentiment(spark):
    rows = spark.createDataFrame([(0, "positive", None, None), (1, None, 0.2, None), (2, "odd", None, -0.3), (3, None, 0.21, -1.0)], "n int, l string, v double, s double")
    label, value = scores.sentiment(F.col("l"), F.col("v"), F.col("s"))
    assert [(r.l2, r.v2) for r in rows.select("n", label.alias("l2"), value.alias("v2")).orderBy("n").collect()] == [("POSITIVE", 0.0), ("NEUTRAL", 0.2), ("NEGATIVE", -0.3), ("POSITIVE", 0.21)]


def test_small_rules(spark):
    assert column(spark, ["US economy, 2024", "x", "<script>", None, "a" * 61], "string", text.is_topic_request) == [True, False, False, False, False]
    rows = spark.createDataFrame([("POSITIVE", 0.98765), ("NEGATIVE", 0.5), ("x", 0.5)], "l string, s double")
    assert [r.v for r in rows.select(scores.signed_sentiment(F.col("l"), F.col("s")).alias("v")).collect()] == [0.9877, -0.5, -0.5]
    assert column(spark, [[(True,), (False,), (None,)]], "array<struct<bodyAvailable: boolean>>", scores.headline_only) == [1]
    assert column(spark, ["https://consent.google.com/x", "https://x.com", None], "string", text.is_consent_url) == [True, False, False]
