from __future__ import annotations

import json

import duckdb
from pyspark.sql import functions as F

from sourceweave import hooks
from sourceweave.plans import ingest
from sourceweave.sources import feeds, html, tables

PAGE = """<html><head><title>Head</title><script>var a = "<p>no</p>";</script></head><body><nav>menu</nav><article><h1>Big</h1><p>First <b>bold</b> words.
<p>Second &amp; last</p></article><a href="/x?utm=1">x</a><a href="/x">again</a><a href='https://b.org/y#z'>y</a><footer>foot</footer></body>"""


def test_page_text():
    assert html.page_text(PAGE) == "Head\nBig\nFirst bold words.\nSecond & last\nxagainy"
    assert html.page_text(None) == "" and html.page_text("<p>open <nav> never closed") == "open"


def test_links():
    assert html.article_links(PAGE, "", "https://a.com/d/") == ["https://a.com/x", "https://b.org/y#z"]
    assert html.article_links(PAGE, "b.org", "https://a.com") == ["https://b.org/y#z"]


def test_claim_review():
    node = {"@type": "ClaimReview", "claimReviewed": "<b>The</b> moon", "reviewRating": {"alternateName": " False "}, "datePublished": "2024-05-06T01:02", "author": {"name": "N"}}
    wrap = lambda x: f'<script type="application/ld+json">{x}</script>'
    want = {"claim": "The moon", "rating": "False", "date": "2024-05-06", "url": "u", "author": "N"}
    assert html.claim_review(wrap("not json") + wrap(json.dumps([{}, node])), "u") == want
    assert html.claim_review(wrap(json.dumps({"@graph": [node]})), "u") == want
    assert html.claim_review(wrap("[1, 2]") + "<p>no</p>", "u") is None and html.claim_review(None, "u") is None


def test_bodies(spark):
    long = "<p>" + "The committee agreed on the rate. " * 20 + "</p>"
    pages = spark.createDataFrame([(0, "https://a.com", long), (1, "https://a.com", "<p>short</p>"), (2, "https://consent.google.com/x", long), (3, None, None), (4, "https://a.com", "<p>Before you continue to Google</p>" + long)], "page_id bigint, url string, html string")
    assert {r.page_id: r.body_available for r in html.extract_bodies(pages).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_feeds(spark):
    item = lambda t, d, s, link="https://x.com/a": f"<item><title><![CDATA[{t}]]></title><link>{link}</link><pubDate>{d}</pubDate><description>{s}</description><source url='' /><source url=\"https://www.cnn.com\">CNN</source></item>"
    xml = "<rss>" + item("Old", "Mon, 02 Jan 2023 00:00:00 GMT", "text") + item("New - CNN", "Tue, 02 Jan 2024 00:00:00 GMT", "&lt;a&gt;New&lt;/a&gt; CNN") + item("Undated", "soon", "More to say") + "</rss>"
    found = feeds.parse_feed(spark.createDataFrame([(xml,), (None,), ("",)], "xml string"), today=F.lit("2025-06-01 00:00:00")).orderBy("nth").collect()
    assert [(r.title, r.date, r.snippet, r.publisher, r.publisher_url) for r in found] == [("New - CNN", "2024-01-02", "", "CNN", "https://www.cnn.com"), ("Undated", "2025-06-01", "More to say", "CNN", "https://www.cnn.com")]


def test_tiers_and_hits(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 1, 3), ("b", 1, 4)], "topic string, tier int, n int")
    assert sorted(r.n for r in feeds.first_tier(rows).collect()) == [1, 3, 4]
    links = spark.createDataFrame([(0, "A title of some length", "https://x.com"), (1, "A title of some length", "https://x.com"), (2, "short", "https://y.com"), (3, "A title of some length", "https://r.search.yahoo.com/a")], "n int, title string, url string")
    assert [r.n for r in feeds.page_hits(links, "yahoo.com", 5, "n").collect()] == [0]
    hits = spark.createDataFrame([(0, "T", "u", "2024-01-01", "s" * 60, None), (1, "T", "u", "2023-01-01", "s" * 60, None), (2, "T", "", "2024-01-01", "s" * 60, None), (3, "T", "u", "2024-01-01", "s", "x")], "n int, title string, url string, date string, snippet string, body string")
    assert [r.n for r in feeds.search_hits(hits, 5, "n").collect()] == [0]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('a "q", b\nline\x01', "t", None, None, None, None, None, True, None)], tables.CORPUS)
    tables.write_csv(rows, str(tmp_path / "c"))
    tables.write_csv(rows, str(tmp_path / "c"))
    found = tables.read_csv(spark, str(tmp_path / "c")).collect()
    assert len(found) == 2 and found[0].title == 'a "q", b\nline' and found[0].url_resolved is True
    topics = spark.createDataFrame([("x",), (None,)], "topic_source string")
    assert [r.topic_source for r in tables.resume(topics, spark.createDataFrame([("x",)], "topic_source string")).collect()] == [None]


def test_bundles(spark, tmp_path):
    for k, n in enumerate((1, 2, 3)):
        (tmp_path / f"C{k}.json").write_text(json.dumps({"claim_id": f"C{k}", "n_articles": n, "summary": "s", "split": "calibration" if k == 1 else "evaluation", "pairwise": None}, indent=1))
    assert sorted(r.claim_id for r in tables.read_bundles(spark, str(tmp_path)).collect()) == ["C1", "C2"]
    assert [r.claim_id for r in tables.read_bundles(spark, str(tmp_path), "calibration").collect()] == ["C1"]


def test_exports(spark, tmp_path):
    article = {"title": "t", "source": "a.com", "similarityToSummary": 0.9, "coherenceScores": [0.5]}
    bare = [{"topic": "T", "summary": "S", "articles": [article, {**article, "source": "b.com"}]}, {"topic": "N", "articles": [{**article, "similarityToSummary": None}]}]
    rows = {r.topic: r for r in tables.read_export(spark.createDataFrame([(json.dumps(bare),)], "json string")).collect()}
    assert rows["T"].formulaBreakdown.nDomains == 2 and rows["T"].intelligenceSummary == "S" and rows["N"].formulaBreakdown is None
    full = {"schemaVersion": 2, "topics": [{"topic": "T", "articles": [], "formulaBreakdown": {"finalScore": 7}}]}
    assert tables.read_export(spark.createDataFrame([(json.dumps(full),)], "json string")).first().formulaBreakdown.finalScore == 7
    document = spark.createDataFrame([("{}",)], "json string")
    for text in ("{}", '{"a": 1}'):
        tables.write_document(document.select(F.lit(text).alias("json")), f"file://{tmp_path}/out.json")
        assert (tmp_path / "out.json").read_text() == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.json"]


def test_hooks(spark):
    docs = spark.createDataFrame([(0, "Big cat, big"), (1, "big CAT big!"), (2, None)], "id int, text string")
    rows = {r.id: r.embedding for r in hooks.encode_once(docs, "text", hooks.hash_words(64)).collect()}
    assert rows[0] == rows[1] and abs(sum(x * x for x in rows[0]) - 1) < 1e-9
    answer = {"status": True, "decoded_url": "https://x.com"}
    found = [r.u for r in spark.createDataFrame([("https://g/articles/1",), ("https://g/2",), (None,)], "u string").select(hooks.decoded(F.col("u"), lambda _: answer).alias("u")).collect()]
    assert found == ["https://x.com", "https://g/2", None]


def test_tables_out(spark):
    scored = spark.createDataFrame([("m", "C1", 1.0), ("m", "C2", 2.0), ("n", "C1", None)], "method string, claim_id string, score double")
    wide = tables.result_table(scored).orderBy("method")
    assert wide.columns == ["method", "C1", "C2"]
    assert tables.markdown(wide).splitlines()[2:] == ["| m | 1.0 | 2.0 |", "| n |  |  |"]


def test_references_without_a_semicolon(spark, tmp_path):
    """Titles that are cut off inside a reference, as those of some pages at sf0.1: text as the SQL has it."""
    assert html.page_text("<p>a&amp;b c&amp d&ampe &#65; &#65 &#x41; &notit; &quot f&</p>x &am") == "a&b c&amp d&ampe A &#65 A &notit; &quot f&\nx &am"
    assert html.article_links('<a href="/x?a=1&amp;b=2&copy=3">', "", "https://a.com") == ["https://a.com/x"]
    body = "<p>" + "Words of a story that goes on. " * 20 + "&amp; so on</p>"
    made = [(i, "https://a.com", f"<html><head><title>The title{cut}</title></head><body>{body}</body></html>") for i, cut in enumerate(["&amp", "&&&amp", "&quot", "&am", "&", "&amp;"])]
    spark.createDataFrame(made, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = ingest.html_text(spark, str(tmp_path)).select("page_id", "url", "body", "body_available").collect()
    assert sorted(map(tuple, found)) == sorted(duck.execute(ingest.SQL_HTML).fetchall())


def test_titled_links(spark):
    assert html.titled_links(PAGE, "https://a.com")[0] == ("x", "https://a.com/x?utm=1")
    pages = spark.createDataFrame([(0, "https://a.com", PAGE), (1, None, None)], "page_id bigint, url string, html string")
    assert [(r.title, r.url) for r in html.extract_titled_links(pages).where("nth = 2").collect()] == [("y", "https://b.org/y#z")]


def test_fetching(spark, tmp_path):
    calls = []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise hooks.Refused
        return "body"

    waits = []
    assert hooks.patiently(get, sleep=waits.append)("u") == "body" and waits == [2.0, 4.0]
    assert hooks.patiently(lambda _: (_ for _ in ()).throw(OSError()), tries=1, sleep=waits.append)("u") is None
    urls = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "url string, n int")
    assert sorted((r.n, r.html) for r in hooks.fetched(urls, lambda u: u * 2).collect()) == [(1, "aa"), (2, None), (3, "bb")]
    path = f"file://{tmp_path}/cache"
    first = {r.url: r.html for r in hooks.through_cache(urls, path, lambda u: u * 2).collect()}
    assert first == {"a": "aa", "b": "bb"} == {r.url: r.html for r in hooks.through_cache(urls, path, lambda u: "new").collect()}


def test_main_text(spark):
    """The article element is taken where it is long enough, the page where it isn't; a short body stays but isn't available."""
    long = "<p>" + "The committee agreed on the rate. " * 20 + "</p>"
    pages = [(0, f"<div>Teaser</div><article>{long}</article>"), (1, f"<article><p>Short</p></article>{long}"), (2, "<p>Only this</p>"), (3, f"<main>{long}<aside>skip</aside></main><p>after</p>")]
    found = {r.page_id: r for r in html.extract_bodies(spark.createDataFrame([(i, "https://a.com", h) for i, h in pages], "page_id bigint, url string, html string")).collect()}
    assert "Teaser" not in found[0].body and found[1].body.startswith("Short The committee") and (found[2].body, found[2].body_available) == ("Only this", False)
    assert "after" not in found[3].body and "skip" not in found[3].body and found[3].body_available


def test_standard_getter():
    """Busy servers are refusals that are tried again, missing pages are none, bodies come as text."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    codes = {"/busy": [503, 429, 200], "/gone": [404], "/ok": [200]}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            own = codes[self.path]
            self.send_response(own.pop(0) if len(own) > 1 else own[0])
            self.end_headers()
            self.wfile.write("été".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    waits = []
    get = hooks.patiently(hooks.standard_get(5), sleep=waits.append)
    assert (get(f"{at}/ok"), get(f"{at}/gone"), get(f"{at}/busy"), waits) == ("été", None, "été", [2.0, 4.0])
    server.shutdown()
    assert hooks.patiently(hooks.standard_get(1), tries=0)(f"{at}/ok") is None
    assert [hooks.is_worth_another_try(s) for s in (200, 404, 429, 500, 503)] == [False, False, True, True, True]
