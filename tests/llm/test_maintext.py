from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from sourceweave.llm import maintext
from sourceweave.llm.maintext import PRIOR, Page, learn, minimum_cut

SCHEMA = "page_id bigint, url string, html string, text string, n_chars string, _key string, label string"
PROSE = "The committee met on Tuesday, and after a long discussion the members agreed to publish the report."


def text(page):
    return Page(page).text(PRIOR)


@pytest.mark.parametrize("seed", range(60))
def test_cut_against_all_labellings(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    costs = [rng.choice([0, 0.5, 1, 1.5, 2, 4]) * rng.choice([-1, 1]) for _ in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.25, 0.5, 1, 2])) for _ in range(rng.randint(0, 14))]

    def cost(label):
        return sum(-c if on else 0 for c, on in zip(costs, label)) + sum(w for a, b, w in edges if label[a] != label[b])

    best = min(cost(x) for x in itertools.product([False, True], repeat=n))
    least = [all(x[i] for x in itertools.product([False, True], repeat=n) if cost(x) == best) for i in range(n)]
    found = minimum_cut(costs, edges)
    assert cost(found) == best and found == least


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><article>";</script></head><body class="has-sidebar">
      <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/x">Other</a></ul></nav>
      <div class="cookie-notice"><p>{PROSE}</p></div><main><article id=a1><header><h1>The  report &amp; more</h1></header>
      <p>{PROSE}<p>Be.</p><div class="ad">{PROSE}</div><ul><li>One<li>Two</ul><pre>a
      b</pre><table><tr><td>x<td>y</table><blockquote>Caf&eacute;&nbsp;&#8212; <b>bo</b>ld<br>line</blockquote>
      <form><label>Name</label><input><button>Send</button></form><noscript><p>No script</noscript><p hidden>gone<p>Last one.
      <section class="comments"><h2>Comments</h2><article><p>{PROSE}</p></article></section></article></main>
      <aside><p>{PROSE}</p></aside><footer>&copy; us</footer>"""
    assert text(page).split("\n") == ["The report & more", PROSE, "Be.", "One", "Two", "a b", "x", "y", "Café — bold line", "Last one."]


def test_pages_that_mark_nothing():
    page = f'<body><div class="menu"><a href=1>A</a> <a href=2>B</a></div><div><h1>Title of it</h1><p>{PROSE}</p><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><div><a href=3>More</a></div><div class="footer">{PROSE}</div>'
    assert text(page).split("\n") == ["Title of it", PROSE, PROSE, "Short one.", PROSE]
    named = f'<form id="aspnet"><div class="content-sidebar-wrap"><div class="sidebar">{PROSE}</div><div class="post"><p>Brief.</p><p>{PROSE}</p><div class="entry-footer">{PROSE}</div></div></div></form>'
    assert text(named).split("\n") == ["Brief.", PROSE]
    assert text("<p>" + PROSE) == PROSE and text(PROSE) == PROSE
    assert [text(x) for x in ("", " \n", "<p></p>", "<!-- only this", "<script>x", "<nav>Home</nav>")] == [""] * 6


def test_smoothness_settles_the_doubtful():
    """Few words between paragraphs are content; the same words between links are not."""
    doubtful = "<p>Of some note</p>"
    inside = f"<div>{f'<p>{PROSE}</p>' * 2}{doubtful}{f'<p>{PROSE}</p>' * 2}</div>"
    outside = f"<div>{'<p><a href=1>Go there</a></p>' * 2}{doubtful}{'<p><a href=1>Go there</a></p>' * 2}</div>"
    assert "Of some note" in text(inside) and "Of some note" not in text(outside)


def test_broken_markup():
    page = f'<ARTICLE><P CLASS="x>y">{PROSE}</span></div><p><b>2 < 3 & 4 <5 &am<br><p title=\'a"b\'>One &amp two &lt;p&gt; &#x41;&bogus;</p'
    assert text(page).split("\n") == [PROSE, "2 < 3 & 4 <5 &am", "One & two <p> A&bogus;"]
    assert text(f"<article><h1>T</h1><button>Unclosed</article><p>{PROSE}</p>").split("\n")[0] == "T"
    assert text(f"<article><p>{PROSE}<svg viewBox=1 /><p>{PROSE}").count(PROSE) == 2


@pytest.mark.parametrize("piece", ["<div>", "<li>", "<p>x", "<a href='", '="', "<", "<!--", "<script>", "&", "<article>x", "</div>", "<td>x<ul>", "<x y=z ", f"<p>{PROSE}</p><p><a>x</a></p>", "<noscript><div>"])
def test_long_and_hostile_pages(piece):
    def seconds(n):
        began = time.perf_counter()
        text("<article><p>Start here.</p>" + piece * n)
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(32_000) < 12 * max(seconds(8000), 0.05)


def test_learning():
    rng = random.Random(1)
    cells = []
    for _ in range(300):
        content = rng.random() < 0.5
        cells.append(((rng.randint(4, 8) if content else rng.randint(0, 3), 0 if content else rng.randint(0, 4), int(content), 0, 0, 0), int(content), rng.randint(1, 50)))
    weights = learn(cells)
    scores = maintext.vectors([c for c, _, _ in cells]) @ weights
    assert all((s > 0) == bool(label) for s, (_, label, _) in zip(scores, cells))
    assert np.array_equal(learn([]), PRIOR) and np.array_equal(learn(cells[:1]), PRIOR)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["c"] * 4) for r in rows], SCHEMA)


def test_extract(spark):
    page = f"<nav>Home</nav><article><h1>Über</h1><p>{PROSE}</p></article><footer>Bye</footer>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", ""), (4, "x", "<article>" + f"<p>{PROSE}</p>" * 30_000 + "</article>")]
    out = {(r.page_id, r.url): r for r in maintext.extract(table(spark, rows)).collect()}
    want = f"Über\n{PROSE}"
    assert maintext.extract(table(spark, rows)).count() == 6
    assert out[1, "u"].text == out[None, None].text == want and out[1, "u"].n_chars == len(want)
    assert out[2, "v"].text == out[3, "w"].text == "" and out[2, "v"].n_chars == 0
    assert out[4, "x"].text == "\n".join([PROSE] * 30_000)
    assert maintext.extract(table(spark, [])).count() == 0


def test_fit_is_bounded_and_separates(spark):
    """Weights from a sample of pages that mark their article find the same text where the marks are taken away."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]

    def page(i, marked):
        prose = [" ".join(rng.choices(vocabulary, k=rng.randint(12, 60))) + "." for _ in range(rng.randint(3, 8))]
        nav = "".join(f"<li><a href='{i}'>{rng.choice(vocabulary)}</a></li>" for _ in range(6))
        article, end = ("<article>", "</article>") if marked else ("<div>", "</div>")
        return f"<div><ul>{nav}</ul></div>{article}<h1>A title of some kind</h1>{''.join(f'<p>{p}</p>' for p in prose)}{end}<div>&copy; {rng.choice(vocabulary)}</div>", "\n".join(["A title of some kind", *prose])

    train = table(spark, [(i, f"u{i}", page(i, True)[0]) for i in range(200)])
    weights = maintext.fit(train, 50)
    assert np.abs(weights - PRIOR).max() > 0.1
    test = [page(i, False) for i in range(60)]
    out = maintext.extract(table(spark, [(i, "u", p) for i, (p, _) in enumerate(test)]), weights).collect()
    assert sum(r.text == test[r.page_id][1] for r in out) >= 58
