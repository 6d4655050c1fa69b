"""Main text of web pages: boosted trees over element features, decoded so that ancestors and descendants agree."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import read_table
from .dom import Page, node_features, own_text, tokens_of

#: Bounds of the fit: pages that lend their words, and teaching pages that are composed of them.
SAMPLE_PAGES, TEACHING_PAGES = 60, 400
#: Share of the teaching pages' parts that carry a made-up name: structure must do without known tokens.
UNKNOWN_NAMES = 0.35
#: A token of the table gets a score if at least so many sampled pages decide alike on its nodes.
TOKEN_PAGES = 3

# Words in class and id that pages use for their parts; teaching pages draw from them.
GROUPS = {
    "body": "article articlebody content contents entry post posts story text body main maincontent prose copy markdown paper page-content".split(),
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs toolbar skip".split(),
    "frame": "header masthead topbar footer foot bottom copyright legal colophon branding logo".split(),
    "side": "sidebar aside side rail widget widgets related recommended recommendations popular trending share sharing social tags more teaser".split(),
    "advert": "ad ads adv advert advertisement advertisements adslot adsense banner sponsor sponsored promo promotion promoted dfp taboola outbrain".split(),
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay paywall disclaimer announcement".split(),
    "reader": "comment comments commentlist reply replies respond discussion disqus reviews responses thread reader".split(),
    "form": "form search searchbox newsletter subscribe subscription signup login register contact poll".split(),
}
_FALLBACK = "the word of a page and its text go on in a row of lines, so that one may read it.".split()


def teaching_page(words: list[str], rng: random.Random) -> str:
    """A page of known structure: its parts have data-y 1 (article) or 0 (anything else), their words are given ones."""

    def say(low: int, high: int) -> str:
        return escape(" ".join(rng.choice(words) for _ in range(rng.randint(low, high))))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{say(1, 4)}</a></li>' for k in range(n)) + "</ul>"

    def name_of(group: str) -> str:
        if rng.random() < UNKNOWN_NAMES:
            return "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
        return rng.choice(GROUPS[group])

    def named(group: str, tag: str | None, inner: str, always: bool = False) -> str:
        tag, name = (tag, name_of(group)) if tag and rng.random() < 0.7 else ("div", name_of(group))
        name = name + rng.choice(["", "-wrap", "-box", " block", "_1", "-area"])
        key = rng.choice(["class", "class", "id"])
        mark = f' {key}="{name}"' if tag == "div" or always or rng.random() < 0.4 else ""
        return f'<{tag}{mark} data-y="0">{inner}</{tag}>'

    def link_list(n: int) -> str:
        item = rng.choice([lambda: f'<a href="/z">{say(2, 9)}</a>', lambda: f'<a href="/z">{say(1, 6)}</a> {say(1, 8)}'])
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"

    def code() -> str:
        lines = f"<pre>{say(1, 6)} = {say(1, 3)}\n{say(1, 8)}</pre>"
        wrapped = rng.choice(["highlight", "code", "codehilite", "listing", "example", name_of("body"), *("".join(rng.choice("bcdfghk") + rng.choice("aeiou") for _ in range(3)) for _ in range(2))])
        return rng.choice([lines, f'<div class="{wrapped}">{lines}</div>', f'<div class="{wrapped}"><div>{lines}</div></div>', f"<div>{lines}</div>"])

    def extra() -> str:
        """What articles hold besides paragraphs."""
        kind = rng.random()
        if kind < 0.35:
            return link_list(rng.choice([3, 5, 8, 8, 14, 30]))
        if kind < 0.65:
            return code()
        if kind < 0.8:
            return rng.choice([f"<figure><img src=i><figcaption>{say(2, 14)}</figcaption></figure>", f'<div class="{rng.choice(["figure", "image", "photo", name_of("body")])}"><img src=i><p>{say(2, 12)}</p></div>'])
        return "<dl>" + "".join(f"<dt>{say(1, 3)}</dt><dd>{say(2, 12)}.</dd>" for _ in range(rng.randint(1, 6))) + "</dl>"

    def advert() -> str:
        return named("advert", None, rng.choice([say(3, 14) + ".", f"<p>{say(3, 20)}</p>", f'<a href="/x">{say(2, 8)}</a>', f"<h3>{say(1, 4)}</h3><p>{say(4, 12)}.</p>"]))

    def paragraph() -> str:
        text = ", ".join(say(1, 12) for _ in range(rng.randint(1, 9))) + "."
        kind = rng.random()
        if kind < 0.1:
            return f"<p><b>{text}<br>"
        if kind < 0.2:
            return f'<p>{text} <a href="/y">{say(1, 3)}</a> {say(2, 9)}</p>'
        if kind < 0.26:
            return f"<h{rng.choice('23')}>{say(1, 7)}</h{rng.choice('23')}>"
        if kind < 0.32:
            return "<ul>" + "".join(f"<li>{say(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.36:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.4:
            return "<table>" + "".join(f"<tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.43:
            return f"<div>{text}</div>"
        if kind < 0.46:
            return rng.choice([f"<noscript>{text}</noscript>", f"<noscript><p>{text}</p></noscript>", f"<p>{say(1, 5)} <math><mi>{say(1, 1)}</mi></math> {text}</p>"])
        return f"<p>{text}</p>" if kind < 0.9 else f"<p>{text}"

    def comments() -> str:
        one = lambda: rng.choice([f"<p>{say(3, 40)}.</p>", f"<div><p>{say(3, 60)}.</p></div>", f"<li>{say(3, 30)}</li>"])
        return named("reader", "section", f"<h3>{say(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 9))), always=True)

    form = rng.random()
    parts = [f"<h1>{say(2, 12)}</h1>"] if rng.random() < 0.9 else []
    if form < 0.45 and rng.random() < 0.1:  # an article of links, which only its element tells from a menu
        parts += [link_list(rng.choice([3, 8, 20, 30]))]
    else:
        parts += [extra() if rng.random() < 0.1 else paragraph() for _ in range(rng.choice([1, 1, 2, 3, 4, 8, 16, 25]))]
    for _ in range(rng.choice([0, 0, 1, 2])):
        parts.insert(rng.randint(0, len(parts)), rng.choice([advert, lambda: named("side", "aside", links(3)), lambda: named("notice", None, say(5, 25)), lambda: named("form", "form", f"<label>{say(1, 3)}</label><input>")])())
    if form < 0.45:
        tag = rng.choice(["article", "article", "main"])
        article = f'<{tag} data-y="1">' + "".join(parts) + f"</{tag}>"
    elif form < 0.85:
        article = f'<div class="{name_of("body")}{rng.choice(["", "-inner", " column"])}" data-y="1">' + "".join(parts) + "</div>"
    else:
        article = '<section data-y="1">' + "".join(parts) + "</section>" if rng.random() < 0.5 else "".join(parts)
    around = [named("menu", "nav", links(rng.randint(2, 12)))] if rng.random() < 0.9 else []
    if rng.random() < 0.6:
        around.insert(0, named("frame", "header", rng.choice([f"<p>{say(1, 6)}</p>", f"<div>{say(1, 5)}</div>", say(1, 6)]) + (links(4) if rng.random() < 0.4 else "")))
    if rng.random() < 0.5:
        around.append(named("notice", None, rng.choice([say(4, 30) + ".", f"<p>{say(4, 40)}.</p>"])))
    if rng.random() < 0.15:
        around.insert(0, f'<noscript data-y="0">{say(3, 14)}.</noscript>')
    around += [advert() for _ in range(rng.choice([0, 1, 1, 2]))]
    if rng.random() < 0.4:
        around.append(named("side", "aside", rng.choice([links(5), f"<h4>{say(1, 3)}</h4><p>{say(5, 30)}.</p>"])))
    after = []
    if rng.random() < 0.45:
        after.append(comments())
    if rng.random() < 0.4:
        after.append(named("side", "aside", f"<h3>{say(1, 3)}</h3>" + rng.choice([links(5), f"<p>{say(4, 30)}.</p>"])))
    if rng.random() < 0.4:
        after.append(named("form", "form", f"<p>{say(2, 9)}</p><label>{say(1, 2)}</label><input><button>{say(1, 1)}</button>"))
    if rng.random() < 0.3:
        after.append(advert())
    if rng.random() < 0.9:
        after.append(named("frame", "footer", rng.choice([f"&copy; {say(2, 18)}.", f"<p>{say(2, 25)}</p>", links(4) + say(2, 8)])))
    if rng.random() < 0.1:
        around = after = []
    inner = "".join(around) + article + "".join(after)
    for _ in range(rng.choice([0, 0, 1, 2])):
        inner = f'<div{rng.choice(["", " class=wrap", " id=page", " class=container", " class=layout"])}>{inner}</div>'
    return f"<html><head><title>{say(2, 8)}</title></head><body>{inner}</body></html>"


def teaching_labels(page: Page) -> np.ndarray:
    """A node inside a marked part has the nearest mark; another one is kept, as its ancestors are."""
    y = np.ones(len(page.tags))
    for k in range(1, len(y)):
        mark = page.attrs[k].get("data-y")
        y[k] = float(mark) if mark else y[page.parents[k]]
    return y


@dataclass
class Model:
    """Trees over node features, and the log-odds that a node with a token in its attributes is kept."""

    trees: BoostedTrees
    scores: dict[str, float]

    def keep(self, pages: list[Page]) -> list[np.ndarray]:
        """Which nodes stay; the nodes of all pages go through the trees together."""
        x = [node_features(p, self.scores) for p in pages]
        odds = np.split(self.trees.log_odds(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1]) if pages else []
        return [decode(p.parents, o, own_text(p)) for p, o in zip(pages, odds)]


def token_counts(pages: list[Page], kept: list[np.ndarray]) -> dict[str, Counter]:
    """On how many pages a token's nodes are kept (1) and dropped (0), among children of kept nodes."""
    out: dict[str, Counter] = {}
    for page, y in zip(pages, kept):
        for t, v in {(t, int(y[k])) for k in range(1, len(y)) if y[page.parents[k]] and page.attrs[k] for t in tokens_of(page.attrs[k])}:
            out.setdefault(t, Counter())[v] += 1
    return out


def token_scores(pages: list[Page], kept: list[np.ndarray]) -> dict[str, float]:
    return {t: float(np.log((c[1] + 1) / (c[0] + 1))) for t, c in token_counts(pages, kept).items()}


def mined_scores(pages: list[Page], kept: list[np.ndarray], known: dict[str, float], least: int = TOKEN_PAGES) -> dict[str, float]:
    """Scores, half as strong, of the table's own tokens that no teaching page has, from what the trees decide without
    them; a token on which pages differ says nothing."""
    new = {t: c for t, c in token_counts(pages, kept).items() if t not in known and max(c.values()) >= least and max(c.values()) > 9 * min(c[0], c[1])}
    return {t: 0.5 * float(np.log((c[1] + 1) / (c[0] + 1))) for t, c in new.items()}


def fit_rows(pages: list[str], teaching: int = TEACHING_PAGES, seed: int = 5) -> Model:
    rng = random.Random(seed)
    table = [Page(html) for html in pages]
    words = sorted({w for page in table for _, _, text, _ in page.pieces for w in text.split()}) or _FALLBACK
    taught = [Page(teaching_page(words, rng)) for _ in range(teaching)]
    labels = [teaching_labels(page) for page in taught]
    half = teaching // 2
    # Each half sees the scores that the other half gives, as the trees will see tokens that they weren't taught with.
    given = [token_scores(taught[half:], labels[half:]), token_scores(taught[:half], labels[:half])]
    xs, ys = [], []
    for k, (page, y) in enumerate(zip(taught, labels)):
        asked = y[np.maximum(page.parents, 0)] > 0  # the model answers for children of kept nodes only
        asked[0] = False
        xs.append(node_features(page, given[k >= half])[asked])
        ys.append(y[asked])
    model = Model(BoostedTrees.fit(np.concatenate(xs), np.concatenate(ys)), token_scores(taught, labels))
    model.scores |= mined_scores(table, model.keep(table), model.scores)
    return model


def fit(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    """Fits on teaching pages whose words come from about ``sample`` pages, chosen by a hash of their content; these pages
    also show what the table's own attribute tokens stand for."""
    rows = pages.where(F.col(html_col).isNotNull())
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.col(url_col), F.length(html_col)), F.lit(1 << 40)) / float(1 << 40)
    return fit_rows(sorted(r[0] for r in rows.where(draw < min(1.0, sample / max(1, n))).select(html_col).collect()))


def decode(parents: list[int], odds: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The likeliest set of kept nodes that holds every kept node's parent.

    ``odds`` are log-odds that a node is kept given that its parent is. A kept node counts log p and the better of both
    choices for each child; a dropped one counts log(1 - p), and so do all below it nothing: they go with it. Of the nodes
    ``wanted``, if there are any, at least one is kept: where the likeliest set has none, the likeliest with one is taken.
    """
    keep_it, drop_it = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best = keep_it.tolist()
    lost = drop_it.tolist()
    for k in range(len(parents) - 1, 0, -1):
        best[parents[k]] += max(best[k], lost[k])
    keep = np.ones(len(parents), dtype=bool)
    for k in range(1, len(parents)):
        keep[k] = keep[parents[k]] and best[k] > lost[k]
    if wanted is None or not wanted.any() or (keep & wanted).any():
        return keep
    loss = np.zeros(len(parents))  # of keeping a node and all above it
    for k in range(1, len(parents)):
        loss[k] = loss[parents[k]] + max(0.0, lost[k] - best[k])
    k = int(np.flatnonzero(wanted)[np.argmin(loss[wanted])])
    forced = np.zeros(len(parents), dtype=bool)
    while k > 0:
        forced[k] = True
        k = parents[k]
    for k in range(1, len(parents)):
        keep[k] = keep[parents[k]] and (forced[k] or best[k] > lost[k])
    return keep


def main_texts(htmls: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    pages, out = [Page(h) for h in htmls], []
    for page, keep in zip(pages, model.keep(pages)):
        blocks: dict[int, list[str]] = {}
        for block, node, text, _ in page.pieces:
            if keep[node]:
                blocks.setdefault(block, []).append(text)
        out.append("\n".join(t for b in blocks.values() if (t := " ".join("".join(b).split()))))
    return out


def extract(pages: DataFrame, model: Model, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, from the whole html.

    Defined cases: null html counts as empty and gives an empty text, as does a page without text; tags that are not
    closed end where HTML ends them, and what a declaration that HTML doesn't know is followed by is kept; pages of any
    length are read to their end; fallbacks of objects, videos and formulas are text, contents of buttons, selections,
    text areas and inner frames are not; a tie between keeping and dropping a part drops it; null and repeated ids and
    repeated pages give a row each; an empty table gives an empty result; other columns are ignored.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            htmls = pdf["_html"].tolist()
            texts = [t for k in range(0, len(htmls), 100) for t in main_texts(htmls[k : k + 100], held.value)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
