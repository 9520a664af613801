"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

Every element is a node with features of its subtree (text, tags, links, density, punctuation),
its attribute tokens, depth, place and siblings. The trees give the probability that the text of
a node is content. Decoding picks one of three states for each node, content, boilerplate or
mixed, where all below content is content and all below boilerplate is boilerplate, so no choice
contradicts that of an ancestor; the best assignment by log-likelihood, weighted by text and less
``SWITCH`` for each subtree that departs from its parent, is found exactly in one pass up and one
down the tree.

The trees are fitted on at most ``MAX_PAGES`` pages (those of the least hash). What
counts as content there is told by the author's own markup: text in ``article`` or ``main``,
outside ``nav``, ``aside``, ``header`` and ``footer``. For the features all of these are plain
divisions, so what is learned holds for pages without them. Extraction is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 1500
SWITCH = 1.0
TREES, DEPTH, RATE, BINS = 40, 4, 0.25, 32
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<!--|<[!?/][^<>]*>")
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg title".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_CONTENT, _OTHER = frozenset(["article", "main"]), frozenset(["nav", "aside", "header", "footer"])
_KINDS = {t: k for k, t in enumerate(["p", "div", "li", "ul", "a", "h1", "h2", "h3", "td", "tr", "table", "span", "b", "pre", "blockquote", "section", "form", "img"], 1)}
_KINDS |= {t: _KINDS["div"] for t in ("article", "main", "nav", "aside", "header", "footer", "section", "body")}
_HASHED = 32
_ITEMS = frozenset("li td th tr dt dd option".split())
_PUNCT = re.compile(r"[.,;:!?]")


@dataclass
class Dom:
    """Nodes in document order. ``end[i]`` is one past the last node below i."""

    tag: list[str]
    parent: list[int]
    end: list[int]
    depth: list[int]
    attrs: list[str]
    text: list[list[tuple[int, str]]]  # direct text of each node, with its place among all
    marked: list[int]  # 1 in content markup, 0 not
    whole: int


def parse(html: str) -> Dom:
    """A forgiving parse: unknown ends are ignored, open elements end with what holds them."""
    tag, parent, end, depth, attrs, text, marked = ["#root"], [-1], [0], [0], [""], [[]], [0]
    stack = [0]
    at = order = 0
    size = len(html)

    open_tags: Counter = Counter()  # a tag that isn't open is never looked for, so each step down the stack closes an element

    def close(upto: int) -> None:
        while len(stack) > upto:
            k = stack.pop()
            end[k] = len(tag)
            open_tags[tag[k]] -= 1

    while at < size:
        m = _TAG.search(html, at)
        upto = m.start() if m else size
        if upto > at and (piece := html[at:upto]).strip():
            text[stack[-1]].append((order, piece))
            order += 1
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            at = html.find("-->", at) + 3
            at = size if at < 3 else at
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(0) if not open_tags[name] else range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == name:
                    close(k)
                    break
            continue
        if name in _RAW:
            stop = re.compile(f"</{name}", re.I).search(html, at)
            at = stop.start() if stop else size
            continue
        if name in _BLOCK and (open_tags["p"] or (name in _ITEMS and open_tags[name])):  # a block ends an open paragraph; an item ends its earlier sibling
            for k in range(len(stack) - 1, 0, -1):
                t = tag[stack[k]]
                if t == "p" or (t == name and name in _ITEMS):
                    close(k)
                    break
                if t in _BLOCK:
                    break
        up = stack[-1]
        tag.append(name)
        parent.append(up)
        depth.append(depth[up] + 1)
        attrs.append(m[3])
        text.append([])
        marked.append(1 if name in _CONTENT else 0 if name in _OTHER else marked[up])
        end.append(len(tag))
        if name not in _VOID and not m[3].endswith("/"):
            stack.append(len(tag) - 1)
            open_tags[name] += 1
    close(0)
    end[0] = len(tag)
    return Dom(tag, parent, end, depth, attrs, text, marked, size)


FEATURES = 22 + _HASHED


def features(dom: Dom) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each node, and the length of its direct text."""
    n = len(dom.tag)
    parent, end = np.array(dom.parent), np.array(dom.end)
    own = np.array([sum(len(t) for _, t in x) for x in dom.text], np.float64)
    words = np.array([sum(t.count(" ") + 1 for _, t in x) for x in dom.text], np.float64)
    marks = np.array([sum(len(_PUNCT.findall(t)) for _, t in x) for x in dom.text], np.float64)
    kind = np.array([_KINDS.get(t, 0) for t in dom.tag])
    link = kind == _KINDS["a"]
    inside = np.zeros(n + 1)
    for i in np.flatnonzero(link):
        inside[i] += 1
        inside[end[i]] -= 1
    linked = np.where(np.cumsum(inside[:-1]) > 0, own, 0.0)

    def below(x):
        c = np.concatenate([[0.0], np.cumsum(x)])
        return c[end] - c[np.arange(n)]

    text, tags, links, word, mark, under = below(own), (end - np.arange(n)).astype(float), below(link), below(words), below(marks), below(linked)
    kids = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
    up = np.maximum(parent, 0)
    order = np.zeros(n)
    first = np.zeros(n, int)
    same: dict[tuple[int, int], int] = {}
    for i in range(1, n):
        p = dom.parent[i]
        order[i] = first[p]
        first[p] += 1
        same[p, kind[i]] = same.get((p, kind[i]), 0) + 1
    alike = np.array([0.0] + [same[dom.parent[i], kind[i]] / kids[dom.parent[i]] for i in range(1, n)])
    before = np.concatenate([[0.0], np.cumsum(own)[:-1]])
    total = max(1.0, own.sum())
    density = text / tags
    hashed = np.zeros((n, _HASHED))
    for i, a in enumerate(dom.attrs):
        if a:
            for v in _ATTR.findall(a):
                for t in _TOKEN.findall(v):
                    hashed[i, zlib.crc32(t.lower().encode()) % _HASHED] += 1
    cols = [
        kind, dom.depth, np.log1p(own), np.log1p(text), np.log1p(tags), np.log1p(density), under / np.maximum(text, 1), np.log1p(links),
        np.log1p(word), text / np.maximum(word, 1), mark / np.maximum(word, 1), kids, order, kids[up], order / np.maximum(kids[up], 1), alike,
        before / total, text / total, np.log1p(density[up]), under[up] / np.maximum(text[up], 1), text / np.maximum(text[up], 1), kind[up],
    ]
    return np.column_stack([*(np.asarray(c, np.float64) for c in cols), hashed]), own


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: feature and threshold by node, value by leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
    """Histogram gradient boosting of the weighted logistic loss."""
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]).astype(np.int64) if len(x) else np.zeros((0, d), np.int64)
    wide = [j for j in range(d) if len(cuts[j])]
    rate = (w @ y) / w.sum() if w.sum() else 0.5
    base = float(np.log(np.clip(rate, 1e-3, 1 - 1e-3) / (1 - np.clip(rate, 1e-3, 1 - 1e-3))))
    margin = np.full(len(x), base)
    feature, threshold, value = [], [], []
    for _ in range(TREES if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p) + 1e-9
        f, t = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        at = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            lo, many = 2**level - 1, 2**level
            best = np.zeros(many)
            for j in wide:
                key = (at - lo) * BINS + binned[:, j]
                G = np.bincount(key, g, many * BINS).reshape(many, BINS).cumsum(1)
                H = np.bincount(key, h, many * BINS).reshape(many, BINS).cumsum(1)
                gain = G**2 / (H + 1) + (G[:, -1:] - G) ** 2 / (H[:, -1:] - H + 1) - G[:, -1:] ** 2 / (H[:, -1:] + 1)
                gain = gain[:, : len(cuts[j])]
                k = gain.argmax(1)
                top = gain[np.arange(many), k]
                new = top > best + 1e-9
                best[new] = top[new]
                f[lo : lo + many][new] = j
                t[lo : lo + many][new] = cuts[j][k[new]]
            at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
        leaf = at - (2**DEPTH - 1)
        v = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        margin += v[leaf]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Trees(np.array(feature).reshape(-1, 2**DEPTH - 1), np.array(threshold).reshape(-1, 2**DEPTH - 1), np.array(value).reshape(-1, 2**DEPTH), base)


def decode(dom: Dom, margin: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether the direct text of each node is content, under the best consistent assignment."""
    n = len(dom.tag)
    p = np.clip(1 / (1 + np.exp(-margin)), 1e-6, 1 - 1e-6)
    weight = np.log1p(own)
    yes, no = weight * np.log(p), weight * np.log(1 - p)
    end = np.array(dom.end)
    sums = [np.concatenate([[0.0], np.cumsum(s)]) for s in (yes, no)]
    pure_yes, pure_no = (s[end] - s[np.arange(n)] for s in sums)
    mixed = np.maximum(yes, no)  # a mixed node's own text goes by itself
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        best[i] = max(pure_yes[i] - SWITCH, pure_no[i] - SWITCH, mixed[i])
        if i:
            mixed[dom.parent[i]] += best[i]
    out = yes > no
    i = 0
    while i < n:
        if mixed[i] < best[i] or (i + 1 == end[i] and own[i] > 0):
            out[i : end[i]] = pure_yes[i] > pure_no[i]
            i = end[i]
        else:
            i += 1
    return out & (own > 0)


def assemble(dom: Dom, chosen: np.ndarray) -> str:
    """The chosen text in document order, a line for each block."""
    parts = []
    block = [0]
    for i in range(1, len(dom.tag)):
        block.append(i if dom.tag[i] in _BLOCK else block[dom.parent[i]])
    for i in np.flatnonzero(chosen):
        parts += [(order, block[i], t) for order, t in dom.text[i]]
    parts.sort()
    lines: list[list[str]] = []
    last = None
    for _, block, t in parts:
        if block != last:
            lines.append([])
            last = block
        lines[-1].append(t)
    return "\n".join(x for x in (" ".join(unescape(" ".join(line)).split()) for line in lines) if x)


def train(pages: DataFrame, most: int = MAX_PAGES) -> Trees:
    """Fits the trees on pages that have content markup. Without any such page all text is content.

    Pages of a null id or html take no part. The ``most`` pages of the least hash of id and html
    are taken: about twice as many pass a bound on the hash in the scan, so neither pages nor
    candidates are gathered in a task.
    """
    marked = pages.filter("page_id is not null and html is not null and (html ilike '%<article%' or html ilike '%<main%')")
    count = marked.count()
    h = F.shiftrightunsigned(F.xxhash64(F.col("page_id").cast("long"), "html"), 11)
    bound = int(min(1.0, (2 * most + 50) / max(1, count)) * 2**53)
    picked = marked.filter(h <= bound).select(h.alias("h"), "html")

    def run(batches):
        for batch in batches:
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                dom = parse(html)
                x, own = features(dom)
                some = own > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h], pa.int64()), pa.array([x[some].astype(np.float32).tobytes()], pa.binary()), pa.array([np.array(dom.marked, np.int8)[some].tobytes()], pa.binary()), pa.array([own[some].astype(np.float32).tobytes()], pa.binary())],
                    names=["h", "x", "y", "own"],
                )

    got = picked.mapInArrow(run, "h long, x binary, y binary, own binary").toArrow().sort_by("h").slice(0, most)
    x, y, own = (b"".join(got[c].to_pylist()) for c in ("x", "y", "own"))
    y = np.frombuffer(y, np.int8).astype(np.float64)
    if not len(y):
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 40.0)
    return boost(np.frombuffer(x, np.float32).reshape(-1, FEATURES).astype(np.float64), y, np.log1p(np.frombuffer(own, np.float32).astype(np.float64)))


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """``(page_id, url, text, nodes, content_nodes)`` for each row, repeated ones and null ids and urls too.

    Text is null for a null html and empty where nothing is content, as for an empty html. Markup
    that doesn't close and text without markup are taken as they are. Very long pages are parsed
    whole, in time that grows with their size. Equal pages have equal texts. An empty table gives an
    empty result; other columns, of whatever names, are ignored; page_id is a whole number.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                doms = [None if h is None else parse(h) for h in part.column(2).to_pylist()]
                made = [features(d) for d in doms if d]
                margin = shared.value.margin(np.concatenate([x for x, _ in made])) if made else np.zeros(0)
                text, nodes, content = [], [], []
                at = k = 0
                for d in doms:
                    if d is None:
                        text.append(None), nodes.append(0), content.append(0)
                        continue
                    own = made[k][1]
                    chosen = decode(d, margin[at : at + len(own)], own)
                    at, k = at + len(own), k + 1
                    text.append(assemble(d, chosen)), nodes.append(len(own) - 1), content.append(int(chosen.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(nodes, pa.int64()), pa.array(content, pa.int64())],
                    names=["page_id", "url", "text", "nodes", "content_nodes"],
                )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, nodes long, content_nodes long")
