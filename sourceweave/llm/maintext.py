"""Main text of web pages by minimum cuts.

A page becomes blocks (stretches of text between borders of block elements) in a tree of elements. What the markup says of a block
and a classifier of its text together are the capacity of its edge to a terminal, content or boilerplate; blocks that follow one another
or lie in the same element are joined by edges, heavier the nearer they are in the tree. A minimum cut labels all blocks of a page at once.

The classifier is a logistic regression over a few features of a block's text. It learns from pages that mark their article
themselves, on a bounded sample, from counts of feature cells that the tasks sum up; so far as there is nothing to learn from, its weights stay at their prior.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import small_batches

#: Pages that the classifier learns from, at most: those with the smallest hashes of identifier and address.
FIT_PAGES = 2000

# Names of elements, roles, and words of classes and ids.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements whose text is never part of a page's text.
UNREAD = frozenset("applet audio button canvas datalist map noscript object option select svg template video".split()) | RAW
BESIDE = frozenset("aside dialog footer form menu nav search".split())
BESIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BESIDE_WORDS = frozenset(
    "ad ads adv adsense aside banner breadcrumb breadcrumbs colophon consent cookie copyright follow footer gdpr legal login masthead menu modal nav navbar navigation notice "
    "outbrain overlay pager pagination paywall popup promo promotion rail recommended recommendations related search share sharing sidebar signin signup skip social submenu "
    "subscribe taboola topbar trending widget widgets".split()
)
BESIDE_STEMS = ("advert", "cookie", "newsletter", "sidebar", "sponsor", "subscri")
REMARK_WORDS = frozenset("comment commentbox commentform commentlist comments disqus replies reply respond".split())
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post story".split())

#: What closes when an element opens, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}

# Capacities, in units of log-odds.
BESIDE_COST, MARKED_COST, NAMED_COST, OUTSIDE_COST, TEXT_MOST = -9.0, 4.0, 2.5, -2.0, 3.0
NEXT, SAME = 1.0, 0.5
#: Capacities are whole numbers of so many to the unit, so that a cut is exact.
GRAIN = 20

#: Features: one, doublings of words, share of words in links, ends like a sentence, heading, list item, copyright sign; and the prior of their weights.
PRIOR = np.array([-1.5, 0.6, -3.0, 0.8, 1.5, -0.5, -2.0])
PRIOR_ROWS = 20.0

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text" | "open" | "close", text or name, attributes) of a page, in time linear in its length.

    Comments and declarations go; a comment or raw element that never ends runs to the end of the page, as does a tag.
    """
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            yield "text", page[at:], ""
            return
        if begin > at:
            yield "text", page[at:begin], ""
        at = begin
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
        elif found := _TAG.match(page, at):
            closes, name, rest = found.group(1), found.group(2).lower(), found.group(3)
            at = found.end()
            yield "close" if closes else "open", name, rest
            if not closes and name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = n if end is None else end.start()
        elif re.match(r"</?[a-zA-Z]", page[at : at + 3]):
            return
        else:
            yield "text", "<", ""
            at += 1


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.IGNORECASE))


class Page:
    """The elements and blocks of a page. Elements are numbered in page order, a parent before its children."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.attributes = [-1], ["html"], [{}]
        #: text, element, words, words in links
        self.blocks: list[tuple[str, int, int, int]] = []
        self._parse(page)
        self._mark()

    def _parse(self, page: str) -> None:
        stack, opened = [0], Counter(["html"])
        unread, inner = [], Counter()  # elements that aren't read, and the blocks open in them
        pieces: list[tuple[str, bool]] = []
        link = None  # depth at which a link was opened

        def flush() -> None:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                self.blocks.append((text, stack[-1], len(text.split()), sum(len(p.split()) for p, linked in pieces if linked)))
            pieces.clear()

        def pop() -> None:
            nonlocal link
            opened[self.tag[stack.pop()]] -= 1
            if link is not None and link > len(stack):
                link = None

        for kind, name, rest in tokens(page):
            if kind == "text":
                if not unread:
                    pieces.append((html.unescape(name), link is not None))
                continue
            if unread:  # inside an element that isn't read, up to its end or to that of a block around it
                if name == unread[-1] and name not in RAW:
                    unread.append(name) if kind == "open" else unread.pop()
                    continue
                if name == unread[-1] and kind == "close":
                    unread.pop()
                    continue
                if name not in BLOCKS or kind == "open" or inner[name] or not opened[name] or name in ("html", "body"):
                    inner[name] += 1 if kind == "open" else -1
                    continue
                unread.clear()
            if kind == "open":
                attributes = {}
                for key, *values in _ATTRIBUTE.findall(rest) if rest.strip(" /") else ():
                    attributes.setdefault(key.lower(), html.unescape(next((v for v in values if v), "")))
                if name in UNREAD or name not in BLOCKS and name not in VOID and _hidden(attributes):
                    if not rest.endswith("/") or name != "svg":
                        unread.append(name)
                        inner.clear()
                elif name == "br":
                    pieces.append((" ", False))
                elif name == "a":
                    link = len(stack)
                elif name in BLOCKS:
                    flush()
                    if self.tag[stack[-1]] == "p":
                        pop()
                    ends, border = CLOSES.get(name, ((), ()))
                    if any(opened[e] for e in ends):
                        keep = len(stack)
                        for place in range(len(stack) - 1, 0, -1):
                            if self.tag[stack[place]] in border:
                                break
                            if self.tag[stack[place]] in ends:
                                keep = place
                                if len(border) != 1 or name in ("dt", "dd"):
                                    break
                        while len(stack) > keep:
                            pop()
                    if name in VOID:
                        continue
                    if name in ("html", "body") and opened[name]:
                        continue
                    self.parent.append(stack[-1])
                    self.tag.append(name)
                    self.attributes.append(attributes)
                    stack.append(len(self.tag) - 1)
                    opened[name] += 1
            elif name == "a":
                link = None
            elif name in BLOCKS and name not in VOID:
                flush()
                if name not in ("html", "body") and opened[name]:
                    while self.tag[stack[-1]] != name:
                        pop()
                    pop()
        flush()

    def _mark(self) -> None:
        """What the markup says of each element: beside the article, in it, or nothing."""
        n = len(self.tag)
        words = [0] * n
        for _, element, count, _ in self.blocks:
            words[element] += count
        for at in range(n - 1, 0, -1):
            words[self.parent[at]] += words[at]
        hard, soft, marked, named = [False] * n, [False] * n, [False] * n, [False] * n
        for at in range(1, n):
            attributes, tag = self.attributes[at], self.tag[at]
            role = attributes.get("role", "").lower()
            own = [w.lower() for w in _WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")] if tag not in ("html", "body") else []
            hard[at] = hard[self.parent[at]] or tag in BESIDE - {"form"} or role in BESIDE_ROLES or any(w in REMARK_WORDS for w in own) or _hidden(attributes)
            soft[at] = tag == "form" or any(w in BESIDE_WORDS or w.startswith(BESIDE_STEMS) for w in own)
            if not hard[at]:
                marked[at] = tag in ("article", "main") or role in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()
                named[at] = any(w in MAIN_WORDS for w in own) and not soft[at]
        self.marked = any(m and w for m, w in zip(marked, words))
        candidates = [at for at in range(1, n) if (marked if self.marked else named)[at] and words[at]]
        core = max(candidates, key=lambda at: (words[at], -at), default=None)
        if core is not None and self.marked:  # an article that holds most of the element is the article
            within = [False] * n
            for at in range(core, n):
                within[at] = at == core or within[self.parent[at]]
            inner = [at for at in candidates if self.tag[at] == "article" and 2 * words[at] >= words[core] and within[at]]
            core = min(inner, key=lambda at: (words[at], -at), default=core)
        self.core = core
        wraps = set()
        at = core if core is not None else 0
        while at > 0:
            wraps.add(at)
            at = self.parent[at]
        self.beside, self.inside = [False] * n, [False] * n
        for at in range(1, n):
            up = self.parent[at]
            self.inside[at] = at == core or self.inside[up]
            header = self.tag[at] == "header" and not self.inside[at] and at not in wraps
            self.beside[at] = self.beside[up] or hard[at] or header or soft[at] and at not in wraps

    def features(self) -> list[tuple[int, ...]]:
        """The cell of each block: see PRIOR; shares of links are in quarters."""
        out = []
        for text, element, words, linked in self.blocks:
            at, item = element, 0
            tag = self.tag[at]
            if tag == "li" or tag == "p" and self.tag[self.parent[at]] == "li":
                item = 1
            out.append((min(8, (words + 1).bit_length() - 1), -(-4 * linked // max(words, 1)) if linked < words else 4, int(bool(_SENTENCE.search(text[-8:]))), int(tag in HEADINGS), item, int("©" in text)))
        return out

    def costs(self, weights: np.ndarray) -> list[float]:
        """What it costs to call each block boilerplate, less what it costs to call it content."""
        out = []
        scores = np.clip(vectors(self.features()) @ weights, -TEXT_MOST, TEXT_MOST).tolist()
        for (_, element, _, _), score in zip(self.blocks, scores):
            if self.beside[element]:
                out.append(BESIDE_COST + score)
            elif self.core is None:
                out.append(score)
            elif self.inside[element]:
                out.append((MARKED_COST if self.marked else NAMED_COST) + score)
            else:
                out.append(OUTSIDE_COST * (1 if self.marked else 0.5) + score)
        return out

    def edges(self) -> list[tuple[int, int, float]]:
        """(block, block, capacity): neighbours, less the farther apart in the tree, and the blocks of one element, each with the one before."""
        depth = [0] * len(self.tag)
        for at in range(1, len(depth)):
            depth[at] = depth[self.parent[at]] + 1
        out, last = [], {}
        for at, (_, element, _, _) in enumerate(self.blocks):
            if at:
                a, b, steps = self.blocks[at - 1][1], element, 0
                while a != b and steps < 12:
                    if depth[a] >= depth[b]:
                        a = self.parent[a]
                    else:
                        b = self.parent[b]
                    steps += 1
                out.append((at - 1, at, NEXT / max(1, steps - 1)))
            home = self.parent[element]
            if home in last:
                out.append((last[home], at, SAME))
            last[home] = at
        return out

    def text(self, weights: np.ndarray) -> str:
        label = minimum_cut(self.costs(weights), self.edges())
        return "\n".join(block[0] for block, content in zip(self.blocks, label) if content)


def vectors(cells: list[tuple[int, ...]]) -> np.ndarray:
    out = np.array([(1, *cell) for cell in cells], dtype=float).reshape(-1, len(PRIOR))
    out[:, 2] /= 4
    return out


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels (True: content) of least total cost: what is paid for labels, and for each edge between different ones.

    Of several such labellings, that with the least content. A node whose own cost outweighs all its edges is settled at once and its
    edges become costs of its neighbours; what is left is cut, component by component, by maximum flow. Exact either way.
    """
    own = [round(c * GRAIN) for c in costs]
    near: list[dict[int, int]] = [{} for _ in own]
    for a, b, weight in edges:
        whole = round(weight * GRAIN)
        if a != b and whole:
            near[a][b] = near[a].get(b, 0) + whole
            near[b][a] = near[b].get(a, 0) + whole
    reach = [sum(e.values()) for e in near]
    label: list[bool | None] = [None] * len(own)
    waiting = deque(range(len(own)))
    while waiting:
        at = waiting.popleft()
        if label[at] is None and (own[at] > reach[at] or own[at] <= -reach[at]):
            label[at] = own[at] > reach[at]
            for other, weight in near[at].items():
                if label[other] is None:
                    reach[other] -= weight
                    own[other] += weight if label[at] else -weight
                    waiting.append(other)
    for at in range(len(own)):
        if label[at] is None:
            part, held = [at], {at}
            for node in part:
                for other in near[node]:
                    if label[other] is None and other not in held:
                        held.add(other)
                        part.append(other)
            content = _source_side(part, own, near, held)
            for node in part:
                label[node] = node in content
    return [bool(x) for x in label]


def _source_side(part: list[int], own: list[int], near: list[dict[int, int]], held: set[int]) -> set[int]:
    """The nodes of ``part`` that a maximum flow from content to boilerplate leaves reachable; level by level, blocking flows."""
    left = {a: {b: w for b, w in near[a].items() if b in held} for a in part}
    left["s"] = {a: own[a] for a in part if own[a] > 0}
    left["t"] = {}
    for a in part:
        left[a]["s"] = 0
        if own[a] < 0:
            left[a]["t"] = -own[a]
            left["t"][a] = 0
    while True:
        level, waiting = {"s": 0}, deque(["s"])
        while waiting:
            a = waiting.popleft()
            for b, room in left[a].items():
                if room > 0 and b not in level:
                    level[b] = level[a] + 1
                    waiting.append(b)
        if "t" not in level:
            return {a for a in part if a in level}
        out, tried = {a: list(left[a]) for a in level}, dict.fromkeys(level, 0)
        path = ["s"]
        while path:
            a = path[-1]
            if a == "t":
                steps = list(zip(path, path[1:]))
                flow = min(left[x][y] for x, y in steps)
                for x, y in steps:
                    left[x][y] -= flow
                    left[y][x] += flow
                del path[next(i for i, (x, y) in enumerate(steps) if not left[x][y]) + 1 :]
                continue
            while tried[a] < len(out[a]) and not (left[a][out[a][tried[a]]] > 0 and level.get(out[a][tried[a]]) == level[a] + 1):
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(out[a][tried[a]])
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def learn(cells: list[tuple[tuple[int, ...], int, int]]) -> np.ndarray:
    """Weights of the classifier from (cell, content 0 or 1, blocks): Newton's method on the penalised likelihood, both labels of equal weight."""
    totals = Counter()
    for _, label, count in cells:
        totals[label] += count
    weights = PRIOR.copy()
    if len(totals) < 2:
        return weights
    x = vectors([c for c, _, _ in cells])
    y = np.array([label for _, label, _ in cells], dtype=float)
    mass = np.array([count * sum(totals.values()) / (2 * totals[label]) for _, label, count in cells])
    mass *= min(1.0, 10_000 / mass.sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (mass * (y - p)) - PRIOR_ROWS * (weights - PRIOR)
        bend = (x * (mass * p * (1 - p))[:, None]).T @ x + PRIOR_ROWS * np.eye(len(PRIOR))
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


_CELL = "words int, links int, sentence int, heading int, item int, sign int"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _CELL.split(", ")]
    for batch in batches:
        found: Counter = Counter()
        for page in batch.column("html"):
            read = Page(page.as_py() or "")
            if read.marked:
                for (_, element, _, _), cell in zip(read.blocks, read.features()):
                    found[cell, int(read.inside[element] and not read.beside[element])] += 1
        rows = [(*cell, label, count) for (cell, label), count in found.items()]
        columns = [pa.array([r[i] for r in rows], pa.int32()) for i in range(7)] + [pa.array([r[7] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "label", "n"])


def fit(pages: DataFrame, most: int = FIT_PAGES) -> np.ndarray:
    """Weights learnt from at most ``most`` distinct (page_id, url) of ``pages`` (columns page_id, url, html: string).

    The driver gets one row for each cell of features and label, some hundreds at any size.
    """
    keyed = pages.withColumn("_key", F.xxhash64("page_id", "url"))
    last = keyed.select("_key").distinct().orderBy("_key").limit(most).agg(F.max("_key")).first()[0]
    if last is None:
        return PRIOR.copy()
    cells = keyed.where(F.col("_key") <= last).select("html").mapInArrow(_cells, f"{_CELL}, label int, n bigint")
    names = [c.split()[0] for c in _CELL.split(", ")]
    rows = cells.groupBy(*names, "label").agg(F.sum("n").alias("n")).orderBy(*names, "label").collect()
    return learn([(tuple(r[:6]), r["label"], r["n"]) for r in rows])


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row of ``pages``, blocks joined by a line feed.

    Character references are decoded, white space within a block is one space; ``br`` is white space. Null and empty html, and pages without
    main text, have an empty text. Html that breaks off or leaves elements open is read to its end; rows that repeat and null identifiers
    stay, each by itself; a long page is one value, read in time linear in its length. An empty table gives an empty result; other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = fit(rows) if weights is None else weights

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(page.as_py() or "").text(weights) for page in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(apply, "page_id bigint, url string, text string, n_chars bigint")
