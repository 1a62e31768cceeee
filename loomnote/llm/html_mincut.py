"""Main text of web pages by minimum-cut labelling.

A page is a sequence of text blocks. A classifier's costs of calling a block content or boilerplate are the
capacities of its links to the two terminals; blocks next to each other, and blocks that are near in the DOM,
are joined by smoothness edges. The minimum cut, found by max-flow, separates content from boilerplate.

The classifier's log-odds are the sum of two parts of like weight. What a block itself looks like (length, links, full
stops, kind and depth of element, position) gives what logistic regression learns from a bounded sample of pages,
taking for labels what containers say there; the blocks around it speak through the smoothness edges alone. What a block
stands in (article, nav, footer, an element of class "comments" ...) gives log-odds by the rules below. On a page
whose containers say nothing, looks and smoothness decide alone.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, table
from .textfeatures import fit_logistic

#: Pages that the classifier learns from, at most about, and blocks of each, evenly over the whole page: the bounds of the training sample.
TRAIN_PAGES, TRAIN_BLOCKS = 1500, 200
#: Log-odds of content: by container, and the bound of the learned part.
INSIDE, OUTSIDE, LEARNED = 3.0, -5.0, 3.0
#: Smoothness between neighbours in the page, by DOM distance, and between a block and the next of the same parent; and the part of it that stays where the containers of one say boilerplate and those of the other don't.
NEXT, SIBLING, MARKED = 2.0, 1.0, 0.2

# Elements of HTML by their role.
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas textarea select button title xmp noembed noframes".split())
BOILERPLATE_ELEMENTS = frozenset("nav footer aside form menu dialog header head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu footer header masthead sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login form search comment comments "
    "reply replies respond disqus share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager tags widget copyright "
    "legal disclaimer toolbar".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
#: Elements whose content an end tag from within does not leave, but for those of tables themselves.
SCOPES = frozenset("table td th caption".split())
TABLE = frozenset("table caption tbody td tfoot th thead tr".split())
CLOSED_BY = {"p": BREAKS - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}

TAG = re.compile(r"""<!--(?:.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def hint(tag: str, attributes: str) -> float:
    """Log-odds that an element gives to what it holds; zero if it says nothing."""
    if tag in BOILERPLATE_ELEMENTS:
        return OUTSIDE
    bad = good = False
    if attributes and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, text = name.lower(), "".join(values)
            if name == "role":
                bad, good = bad or text.lower() in BOILERPLATE_ROLES, good or text.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and text.lower() == "true" or name == "style" and "display:none" in text.replace(" ", "").lower():
                return OUTSIDE
            elif name in ("class", "id"):
                for token in text.split():
                    words = [w.lower() for w in WORDS.findall(token)]
                    if words[:1] in (["with"], ["has"], ["no"]):
                        continue
                    own = not BOILERPLATE_WORDS.isdisjoint(words)
                    bad, good = bad or own, good or not own and not CONTENT_WORDS.isdisjoint(words)
    if bad:
        return 0.0 if good else OUTSIDE
    return INSIDE if tag in ("article", "main") else INSIDE - 1 if good else 0.0


class Block(NamedTuple):
    """A text block: text, its element, log-odds of its containers, characters in links, number of the element's parent, its depth, and the depth up to which it shares its containers with the block before."""

    text: str
    tag: str
    odds: float
    linked: int
    parent: int
    depth: int
    common: int


class Stack:
    """The open elements from the outside in: tag, number, log-odds; with the places of each tag, of those that break text and of those that end tags do not leave."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, float]] = []
        self.places: dict[str, list[int]] = {}
        self.breaks: list[int] = []
        self.scopes: list[int] = []
        self.low = 0  # the fewest elements open since the last block

    def push(self, tag: str, number: int, odds: float) -> None:
        at = len(self.open)
        self.places.setdefault(tag, []).append(at)
        if tag in BREAKS:
            self.breaks.append(at)
        if tag in SCOPES:
            self.scopes.append(at)
        self.open.append((tag, number, odds))

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if tag in BREAKS:
                self.breaks.pop()
            if tag in SCOPES:
                self.scopes.pop()
        self.low = min(self.low, at)

    def close(self, tag: str) -> None:
        """An end tag: closes the innermost such element, at any depth, but an inline one only within its block and none from within a table's cell."""
        at = self.places[tag][-1] if self.places.get(tag) else -1
        bound = self.breaks[-1] if tag not in BREAKS and self.breaks else self.scopes[-1] if tag not in TABLE and self.scopes else -1
        if at > bound:
            self.cut(at)

    def implied(self, tag: str) -> None:
        """A start tag that closes the block it stands in (the next p, li, td ...)."""
        if self.breaks and tag in CLOSED_BY.get(self.open[self.breaks[-1]][0], ()):
            self.cut(self.breaks[-1])


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    linked = links = number = at = 0
    unclosed: set[str] = set()  # raw elements that no end tag follows any more: not searched for again

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            at = stack.breaks[-1] if stack.breaks else -1
            tag, _, odds = stack.open[at] if at >= 0 else ("", 0, 0.0)
            out.append(Block(text, tag, odds, min(linked, len(text)), stack.open[at - 1][1] if at > 0 else 0, at + 1, min(stack.low, at + 1)))
            stack.low = at + 1
        parts.clear()
        linked = 0

    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ")
        elif closing:
            if tag in BREAKS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            stack.close(tag)
        elif tag in RAW:
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not end:
                unclosed.add(tag)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
        else:
            if tag in BREAKS:
                flush()
                links = 0
                stack.implied(tag)
            if tag == "a":
                links += 1
            if tag not in VOID and not attributes.endswith("/"):
                number += 1
                outer = stack.open[-1][2] if stack.open else 0.0
                own = hint(tag, attributes)
                if tag == "header" and outer > 0:
                    own = 0.0  # of the article itself
                stack.push(tag, number, outer if outer < 0 or not own else own)
    flush()
    return out


def looks(found: list[Block]) -> np.ndarray:
    """What each block of a page looks like, a row of numbers of about 0 to 1."""
    n = np.array([len(x.text) for x in found], float)
    linked = np.array([x.linked for x in found], float)
    size, share = np.log1p(n) / 7, linked / n
    own = [
        size, share, n > 80, [x.text[-1] in '.!?…。！？"”' for x in found], [min(5, sum(map(x.text.count, ".!?,"))) / 5 for x in found],
        [x.tag == "p" for x in found], [x.tag == "li" for x in found], [x.tag[:1] == "h" and x.tag[1:].isdigit() for x in found],
        np.minimum(1, np.array([x.depth for x in found]) / 20), np.linspace(0, 1, len(found)) if len(found) > 1 else [0.5],
    ]
    return np.column_stack(own).astype(float)


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's (content's) side of a minimum cut: capacity odds to the source if positive, else -odds to the sink.

    Nodes whose terminal link outweighs all their edges are settled first; Dinic's algorithm finds the flow of the rest.
    """
    n = len(odds)
    weight = np.zeros(n)
    for a, b, w in edges:
        weight[a] += w
        weight[b] += w
    settled = np.abs(np.array(odds)) > weight
    side = [o > 0 for o in odds]
    if settled.all():
        return side
    cap = [0.0 if s else o for o, s in zip(odds, settled, strict=True)]
    s, t = n, n + 1
    to: list[list[list]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        x, y = [b, forth, None], [a, back, None]
        x[2], y[2] = y, x
        to[a].append(x)
        to[b].append(y)

    for a, b, w in edges:
        if settled[a] and settled[b]:
            continue
        if settled[a] or settled[b]:
            fixed, free = (a, b) if settled[a] else (b, a)
            cap[free] += w if side[fixed] else -w
        else:
            link(a, b, w, w)
    for i in range(n):
        if not settled[i] and cap[i]:
            link(s, i, cap[i], 0.0) if cap[i] > 0 else link(i, t, -cap[i], 0.0)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for b, c, _ in to[a]:
                if c > 1e-9 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[t] < 0:
            return [side[i] if settled[i] else level[i] >= 0 for i in range(n)]
        nxt, path = [0] * (n + 2), []
        a = s
        while True:
            if a == t:
                flow = min(e[1] for e in path)
                for e in path:
                    e[1] -= flow
                    e[2][1] += flow
                k = next(i for i, e in enumerate(path) if e[1] <= 1e-9)
                a = path[k][2][0]
                del path[k:]
            elif nxt[a] < len(to[a]):
                e = to[a][nxt[a]]
                if e[1] > 1e-9 and level[e[0]] == level[a] + 1:
                    path.append(e)
                    a = e[0]
                else:
                    nxt[a] += 1
            elif path:
                a = path.pop()[2][0]
                nxt[a] += 1
            else:
                break


def smooth(found: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}

    def link(a: int, b: int, weight: float) -> None:
        edges.append((a, b, weight if (found[a].odds < 0) == (found[b].odds < 0) else weight * MARKED))

    for i, x in enumerate(found):
        if i:
            steps = x.depth + found[i - 1].depth - 2 * x.common
            link(i - 1, i, NEXT / (1 + max(0, steps - 2)) ** 2)
        if last.get(x.parent, i - 1) != i - 1:
            link(last[x.parent], i, SIBLING)
        last[x.parent] = i
    return edges


def costs(found: list[Block], weights: list[float]) -> list[float]:
    """Log-odds of content of each block: containers and looks."""
    w = np.array(weights)
    learned = np.clip(looks(found) @ w[:-1] + w[-1], -LEARNED, LEARNED) if len(w) > 1 else np.zeros(len(found))
    return [x.odds + o for x, o in zip(found, learned.tolist(), strict=True)]


def extract(page: str | None, weights: list[float]) -> str:
    """The main text of one page, its blocks joined by one space; empty if there is none."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = min_cut(costs(found, weights), smooth(found))
    return " ".join(x.text for x, k in zip(found, keep, strict=True) if k)


def learn(pages: DataFrame, html_col: str = "html", key_col: str = "page_id", train_pages: int = TRAIN_PAGES, train_blocks: int = TRAIN_BLOCKS) -> list[float]:
    """Weights of a block's looks, from blocks of about train_pages pages whose containers say what they are (of each page train_blocks at most, evenly over it). Repeated pages count as often as they stand there; without blocks of both kinds nothing is learned."""
    n = pages.count()
    sample = pages.where(F.pmod(F.xxhash64(F.col(key_col).cast("string")), F.lit(1 << 30)) < int(min(1.0, train_pages / max(1, n)) * (1 << 30))).select(F.col(html_col).cast("string").alias("h"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page in f["h"]:
                found = blocks(page or "")
                if found:
                    x = looks(found).round(3).tolist()
                    sure = [i for i, b in enumerate(found) if b.odds]
                    rows += [(x[i], float(found[i].odds > 0)) for i in sure[:: max(1, -(-len(sure) // train_blocks))]]
            yield pd.DataFrame(rows, columns=["x", "y"])
        release()

    got = small_batches(sample).mapInPandas(run, "x array<double>, y double").toArrow()
    y = got.column("y").to_numpy()
    if not 0 < y.sum() < len(y):
        return []
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows come in
    return fit_logistic(x[order], y[order]).tolist()


def main_text(pages: DataFrame, weights: list[float], html_col: str = "html") -> DataFrame:
    """pages with text, the main text of html: character references decoded, white space inside a block made one space, blocks in page order.

    Null and empty pages give an empty text; repeated pages each give theirs; an empty table stays empty. A column
    named text is replaced, all others stay.
    """

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda page: extract(page, weights))
        release()

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return small_batches(pages).withColumn("text", F.pandas_udf(run, "string")(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))


def op7_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = main_text(pages, learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_mincut_html": op7_mincut_html}
ORACLES: dict[str, str] = {}
