"""A small element tree over HTML and the features of its nodes."""

from __future__ import annotations

import re

import numpy as np

from ..functions.html import TolerantParser, open_buttons

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What they hold is not the page's text: its name, code, or controls of a form.
SILENT = frozenset("title desc metadata script style template iframe button select option textarea".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that are nodes although they don't break lines.
OWN_NODE = frozenset(["noscript"])
#: A start tag ends an open element of the set, unless one of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
STOPS_P = frozenset("article aside blockquote body div footer form header li main nav section table td th".split())

_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TAG_KINDS = ["nav menu", "header", "footer", "aside", "form fieldset", "article main", "p blockquote pre", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl", "li dt dd", "div section", "table tbody thead tr td th", "figure figcaption", "noscript"]
_KIND_OF = {t: k for k, names in enumerate(TAG_KINDS) for t in names.split()}


class Page(TolerantParser):
    """Nodes: block elements and elements with a class, id or role. Pieces of text: (block, node, text).

    A head holds a silent title and no other text; where it isn't closed, what follows it is text as anywhere.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.attrs, self.pieces = ["#root"], [-1], [{}], []
        self.inputs, self.links = [0], []
        self.open: list[tuple[str, int]] = [("#root", 0)]
        self.block = self.silent = self.anchor = 0
        self.loose, self.buttons = open_buttons(html), 0
        self.feed(html)
        self.close()

    def _pop(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.silent -= tag in SILENT
            self.anchor -= tag == "a"
            self.block += tag in BLOCK
        del self.open[at:]

    def _end_open(self, names: frozenset | set, stops: frozenset | set) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in names:
                self._pop(k)
                return
            if self.open[k][0] in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "button":
            self.buttons += 1
            if self.buttons - 1 in self.loose:  # never closed: a line break in place of what would hold the rest
                self.block += 1
                return
        if self.silent and tag != "body":
            if tag not in VOID:
                self.open.append((tag, self.open[-1][1]))
                self.silent += tag in SILENT
                self.anchor += tag == "a"
            return
        if tag == "body":  # also where the head, or something in it, was not closed
            self._end_open({"head"}, set())
        if tag in ENDS_P:
            self._end_open({"p"}, STOPS_P)
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        node = self.open[-1][1]
        self.block += tag in BLOCK
        if tag == "input":
            self.inputs[node] += 1
        if tag == "br":
            self.pieces.append((self.block, node, " ", self.anchor > 0))
        if tag in VOID:
            return
        if tag in BLOCK or tag in OWN_NODE or any(k in ("class", "id", "role") for k, _ in attrs):
            self.tags.append(tag)
            self.parents.append(node)
            self.attrs.append(dict(attrs))
            self.inputs.append(0)
            node = len(self.tags) - 1
        self.open.append((tag, node))
        self.silent += tag in SILENT
        self.anchor += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if tag not in BLOCK and self.open[k][0] in ("td", "th", "table", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append((self.block, self.open[-1][1], data, self.anchor > 0))


def tokens_of(attrs: dict) -> list[str]:
    text = " ".join(str(attrs.get(k) or "") for k in ("class", "id", "role"))
    return [w.lower() for w in _TOKEN.findall(text)] + [w.lower() for w in text.split()] if text.strip() else []


#: Elements whose text is not the page's own.
ASIDE = frozenset("nav menu header footer aside form fieldset".split())


def own_text(page: Page) -> np.ndarray:
    """Which nodes have text of their own, not all of it in links and none of it within menus and the like."""
    n = len(page.tags)
    own, linked = np.zeros(n), np.zeros(n)
    for _, node, text, link in page.pieces:
        own[node] += len(text.strip())
        linked[node] += len(text.strip()) * link
    apart = np.zeros(n, dtype=bool)
    for k in range(1, n):
        apart[k] = apart[page.parents[k]] or page.tags[k] in ASIDE
    return (own > linked) & ~apart


def node_features(page: Page, scores: dict[str, float]) -> np.ndarray:
    """One row a node: depth, siblings and its share of the longest, sums over the subtree and densities, headings, element kinds, and what the tokens of its
    attributes and of its ancestors' say for or against it by ``scores`` (log-odds; an unknown token says nothing)."""
    n = len(page.tags)
    parent = np.array(page.parents)
    own, linked, marks, start = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
    at = 0
    for _, node, text, link in page.pieces:
        k = len(text.strip())
        if k:
            own[node] += k
            linked[node] += k * link
            marks[node] += text.count(".") + text.count(",") + text.count(";")
            if start[node] < 0:
                start[node] = at
            at += k
    total = own.copy()
    sums = np.stack([total, linked, marks, np.ones(n), np.array([t in ("p", "blockquote") for t in page.tags], float), np.array(page.inputs, float), np.array([t in ("li", "dd") for t in page.tags], float), np.array([t == "h1" for t in page.tags], float), np.array([t in ("h2", "h3", "h4", "h5", "h6") for t in page.tags], float)])
    said = np.zeros((n, 2))  # the least and the greatest score of the node's own tokens
    for k, attrs in enumerate(page.attrs):
        own_scores = [scores[w] for w in tokens_of(attrs) if w in scores] if attrs else []
        if own_scores:
            said[k] = min(0.0, *own_scores), max(0.0, *own_scores)
    named = np.array([any(a.get(k) for k in ("class", "id", "role")) for a in page.attrs], dtype=float)
    above, depth, index, children = np.zeros_like(said), np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        index[k] = children[p]
        children[p] += 1
        above[k] = min(above[p][0], said[p][0]), max(above[p][1], said[p][1])
    first = start.copy()
    for k in range(n - 1, 0, -1):
        p = parent[k]
        sums[:, p] += sums[:, k]
        if first[k] >= 0 and (first[p] < 0 or first[k] < first[p]):
            first[p] = first[k]
    text, links, dots, nodes, paragraphs, inputs, items, titles, heads = sums
    widest = np.zeros(n)  # the longest text among a node's children
    np.maximum.at(widest, parent[1:], text[1:])
    safe, whole = np.maximum(text, 1), max(text[0], 1)
    up = np.maximum(parent, 0)
    kinds = np.zeros((n, len(TAG_KINDS)))
    for k, t in enumerate(page.tags):
        if t in _KIND_OF:
            kinds[k, _KIND_OF[t]] = 1
    numbers = [depth, children[up], index / np.maximum(children[up], 1), np.log1p(text), np.log1p(own), links / safe, np.log1p(nodes) - np.log1p(text), np.log1p(paragraphs), text / whole, np.maximum(first, 0) / whole, text / np.maximum(text[up], 1), dots / safe * 100, inputs, items / nodes, named, titles > 0, np.log1p(heads), text / np.maximum(widest[up], 1), titles[up] > 0]
    return np.concatenate([np.stack(numbers, axis=1), kinds, said, above], axis=1).astype(np.float32)
