"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block element and every text block of a page is a node with the state content or boilerplate. A node's
potential comes from its tag, the words of its class, id and role, and (for text) length, links and punctuation; a
parent-child potential, one 2 x 2 table per tag, carries the state down the tree. Sum-product messages go from the
leaves to the root and back (all pages of a batch together, one depth at a time), and a text block with a marginal of
at least one half is part of the main text.

The tables are counts over labelled nodes: pages that mark their article (<article> or <main>) label their own nodes.
The counts of all such pages are summed by Spark (a few hundred numbers) and added to the prior counts below, which
stand for tags that no labelled page uses.

Defined results: null and empty html, and pages without content, give an empty text; markup that is not closed is
closed by its parent; scripts, styles and comments are no text; repeated rows are extracted each; other columns are
ignored; an empty table gives no rows, and without labelled pages the prior counts decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

# Element names of HTML by their part in a page.
MAIN = ["article", "main"]
BOILERPLATE = ["nav", "header", "footer", "aside", "form", "head", "title", "menu", "dialog", "button", "label", "fieldset", "legend"]
BLOCKS = [
    "html", "body", "div", "section", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody",
    "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "details", "summary", "address", "center", "hgroup",
]
SILENT = ["script", "style", "noscript", "template", "textarea", "select", "svg", "iframe", "object", "video", "audio", "canvas", "option", "datalist"]
#: Elements that a start tag of the same group closes.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Words of class, id and role that mark what is not main text.
MARKS = [
    "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "sidebar", "side", "widget", "related", "recommended", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr",
    "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "social", "comment", "comments", "reply", "replies",
    "disqus", "search", "pagination", "pager", "tags", "toolbar", "complementary", "contentinfo", "copyright", "disclaimer", "alert", "skip",
]

#: Words of class, id and role that mark main text, if none of the others stands there.
CONTENT_MARKS = ["article", "content", "post", "entry", "story", "main", "text"]
#: Elements whose classes describe the page.
UNMARKED = ["html", "body", "main", "article"]

TAGS = ["#text", "other", *MAIN, *BOILERPLATE, *BLOCKS]
TAG = {t: k for k, t in enumerate(TAGS)}
#: Features of a node: its tag, a mark (none, boilerplate, content), then bins of a text's length, links and punctuation.
MARKED = len(TAGS)
LENGTH, LINKS, PUNCT = MARKED + 3, MARKED + 11, MARKED + 15
N_FEATURES = MARKED + 19

#: Prior odds of what a page says outright, and how many labelled nodes count in full: nodes of a page are no independent draws.
SURE, ENOUGH = 1e5, 20.0

#: Quotes hold a ">" only behind "="; elsewhere they are part of a name. Possessive, so that no page takes quadratic time.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_MARKS, _SILENT, _MAIN, _BOILER, _CONTENT = (frozenset(x) for x in (MARKS, SILENT, MAIN, BOILERPLATE, CONTENT_MARKS))
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in SILENT if t != "option"}


@dataclass
class Nodes:
    """The nodes of several pages in page order: parents come before their children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    marked: list[int] = field(default_factory=list)
    label: list[bool] = field(default_factory=list)
    page: list[int] = field(default_factory=list)
    texts: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links

    def add(self, parent: int, tag: int, marked: int, label: bool, page: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.marked.append(marked)
        self.label.append(label)
        self.page.append(page)
        return len(self.parent) - 1


def parse(page: int, source: str, nodes: Nodes) -> bool:
    """Adds a page's nodes; returns whether the page marks its article."""
    root = nodes.add(-1, TAG["other"], 0, False, page)
    stack: list[tuple[str, int]] = [("", root)]
    opened: Counter[str] = Counter()  # the elements of the stack by name, so that a stray end tag costs nothing
    held: list[str] = []
    links, in_link, labelled, at = 0, False, False, 0

    def say(raw: str) -> None:
        nonlocal links
        text = entities.unescape(raw) if "&" in raw else raw
        held.append(text)
        if in_link:
            links += len(text.strip())

    def close_block() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                node = stack[-1][1]
                nodes.texts.append((nodes.add(node, TAG["#text"], 0, nodes.label[node], page), text, links))
            held.clear()
        links = 0

    last = source.rfind(">") + 1  # no tag ends behind it
    while True:
        m = _TOKEN.search(source, at, last)
        if m is None:
            comment = source.find("<!--", last)
            say(source[at:] if comment < 0 else source[at:comment])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if at == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment that is never closed
            continue
        name = name.lower()
        if name in _SILENT:
            if not m[1] and not m[3].endswith("/") and name in _END:
                end = _END[name].search(source, at)
                at = end.end() if end else len(source)
            continue
        if name == "a":
            in_link = not m[1]
        elif name in ("br", "hr", "img", "input"):
            held.append(" ")
        elif name not in TAG:
            continue  # inline: part of the block around it
        elif m[1]:
            if opened[name]:
                close_block()
                while True:
                    closed = stack.pop()[0]
                    opened[closed] -= 1
                    if closed == name:
                        break
        else:
            close_block()
            ends = CLOSES.get(name, ("p",))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    opened.subtract(n for n, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] not in ("p", "td", "th", "dt", "dd", "li") or name not in CLOSES and stack[k][0] != "p":
                    break
            parent = stack[-1][1]
            words = {w for v in _NAMES.findall(m[3]) for w in _WORD.findall(v.lower())} if m[3] else ()
            marked = 0 if name in UNMARKED else 1 if not _MARKS.isdisjoint(words) else 2 * (not _CONTENT.isdisjoint(words))
            main = name in _MAIN
            labelled |= main
            label = (main or nodes.label[parent]) and marked != 1 and name not in _BOILER
            if not m[3].endswith("/"):
                stack.append((name, nodes.add(parent, TAG[name], marked, label, page)))
                opened[name] += 1
    close_block()
    return labelled


def features(nodes: Nodes) -> np.ndarray:
    """node x 4: feature numbers, -1: none."""
    out = np.full((len(nodes.tag), 4), -1, np.int64)
    out[:, 0] = nodes.tag
    is_text = out[:, 0] == TAG["#text"]
    out[~is_text, 1] = MARKED + np.asarray(nodes.marked, np.int64)[~is_text]
    for node, text, links in nodes.texts:
        n = len(text)
        ends = text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(";")
        out[node, 1:] = LENGTH + min(7, n.bit_length() // 2), LINKS + min(3, 4 * links // (n + 1)), PUNCT + min(3, 80 * ends // (n + 1))
    return out


def prior_counts() -> tuple[np.ndarray, np.ndarray]:
    """(feature x state, tag x parent's state x state) counts before any page is seen; state 1 is content."""
    single, pairs = np.full((N_FEATURES, 2), 2.0), np.ones((len(TAGS), 2, 2))
    single[TAG["#text"]] = 40, 40
    # long runs of sentences without links are rather content, wherever they stand: what decides if no page marks its article
    single[LENGTH : LENGTH + 3], single[LENGTH + 3 : LENGTH + 8] = (3, 2), (2, 4)
    single[LINKS], single[LINKS + 1 : LINKS + 4] = (2, 3), (4, 2)
    single[PUNCT], single[PUNCT + 1 : PUNCT + 4] = (3, 2), (2, 3)
    for t in BOILERPLATE:
        single[TAG[t]] = SURE, 1 / SURE
        pairs[TAG[t]] = (40, 0.1), (40, 0.1)
    for t in MAIN:
        single[TAG[t]] = 0.2, 40
        pairs[TAG[t]] = (1, 20), (0.1, 20)
    single[MARKED], single[MARKED + 1], single[MARKED + 2] = (10, 10), (SURE, 1 / SURE), (0.2, 20)
    for t in TAGS:
        if t not in MAIN and t not in BOILERPLATE:
            pairs[TAG[t]] = (60, 0.1), (0.1, 60)
    pairs[TAG["#text"]] = (40, 0.05), (0.05, 40)
    for t in ("div", "section"):
        pairs[TAG[t]] = (10, 1), (1, 10)
    return single, pairs


def _parsed(batch: pa.RecordBatch) -> tuple[Nodes, np.ndarray]:
    nodes, labelled = Nodes(), []
    for k, source in enumerate(batch.column("html").to_pylist()):
        labelled.append(parse(k, source or "", nodes))
    return nodes, np.asarray(labelled, bool)


def learn(pages: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all pages that mark their article, on top of the prior counts."""
    width = N_FEATURES * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + len(TAGS) * 4, np.int64)
        for batch in batches:
            for part in slices(batch, "html"):
                nodes, labelled = _parsed(part)
                state, parent, tag = np.asarray(nodes.label, np.int64), np.asarray(nodes.parent), np.asarray(nodes.tag)
                use = labelled[np.asarray(nodes.page)]
                for column in features(nodes).T:
                    ok = use & (column >= 0)
                    total[:width] += np.bincount(column[ok] * 2 + state[ok], minlength=width)
                ok = use & (parent >= 0)
                total[width:] += np.bincount(tag[ok] * 4 + state[parent[ok]] * 2 + state[ok], minlength=len(TAGS) * 4)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["k", "n"])

    counts = np.zeros(width + len(TAGS) * 4)
    for r in pages.select("html").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # a few hundred rows
        counts[r["k"]] = r["n"]
    return with_priors(counts)


def with_priors(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the counts, scaled down to ENOUGH where there are more, to the prior counts."""
    single, pairs = prior_counts()
    seen = counts[: N_FEATURES * 2].reshape(-1, 2), counts[N_FEATURES * 2 :].reshape(-1, 2, 2)
    scaled = [c / np.maximum(1.0, c.sum(-1, keepdims=True) / ENOUGH) for c in seen]
    return single + scaled[0], pairs + scaled[1]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(parent: np.ndarray, depth: np.ndarray, tag: np.ndarray, feats: np.ndarray, single: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Probability of content of every node by sum-product on the forest."""
    weights = np.log(single / single.sum(1, keepdims=True))  # a feature seen alike in both states says nothing
    tables = np.log(pairs / pairs.sum(2, keepdims=True))
    known = feats >= 0
    own = (weights[np.where(known, feats, 0)] * known[:, :, None]).sum(1)
    up = own.copy()
    message = np.zeros_like(own)
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
    for level in reversed(levels[1:]):
        message[level] = _log_sum(tables[tag[level]] + up[level][:, None, :], 2)
        np.add.at(up, parent[level], message[level])
    belief = up.copy()
    for level in levels[1:]:
        above = belief[parent[level]] - message[level]
        down = _log_sum(above[:, :, None] + tables[tag[level]], 1)
        belief[level] = up[level] + down
        belief[level] -= belief[level].max(1, keepdims=True)
    share = np.exp(belief - belief.max(1, keepdims=True))
    return share[:, 1] / share.sum(1)


def main_texts(batch: pa.RecordBatch, single: np.ndarray, pairs: np.ndarray) -> list[str]:
    nodes, _ = _parsed(batch)
    content = marginals(np.asarray(nodes.parent), np.asarray(nodes.depth), np.asarray(nodes.tag), features(nodes), single, pairs)
    kept: list[list[str]] = [[] for _ in range(batch.num_rows)]
    for node, text, _ in nodes.texts:
        if content[node] >= 0.5:
            kept[nodes.page[node]].append(text)
    return [" ".join(x) for x in kept]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    single, pairs = learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(main_texts(part, single, pairs), pa.string())], ["page_id", "url", "text"])

    sent = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return sent.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
