"""HTML to Markdown for stored pages: code wrappers, links and tables are kept, menus and adverts are not."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_markdown, clean_title, extraction_error, strip, title_from_url, word_count

# Names of the HTML standard, and the code wrapper of the crawled site.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form iframe button svg select".split())
HEAD = frozenset("base link meta title style script noscript template".split())
BLOCKS = frozenset("html body article main section header div p h1 h2 h3 h4 h5 h6 ul ol li pre blockquote table tr dl dt dd figure figcaption hr".split())
WRAPPER = "codeblock-wrapper"
#: Names of parts that are not the page's text, and words that such names are lengthened by.
NOISE = frozenset("ad ads advert adverts advertisement advertisements banner promo promos sponsor sponsors sponsored sidebar cookie cookies comment comments breadcrumb breadcrumbs share sharing social related newsletter".split())
JOINTS = frozenset("area bar block box button buttons container content group holder inner item left right top bottom list link links main media module notice outer panel region section slot unit widget wrap wrapper zone".split())
#: Elements that hold the page's text, whatever their name.
KEPT = frozenset("html body main article".split())
_BUTTONS = re.compile(r"<!--.*?-->|<script\b.*?</script\s*>|<(/?)button\b", re.I | re.S)


def is_noise(names: str) -> bool:
    """Whether a class or id among the names says that a part isn't the page's text: a whole name, not a word within it.

    ``ad-box`` and ``sidebar_left`` do; ``with-sidebar``, ``has-comments`` and ``social-sciences`` say something else.
    """
    for name in names.lower().split():
        words = [w.rstrip("0123456789") for w in re.split(r"[-_]+", name)]
        words = [w for w in words if w]
        if any(w in NOISE for w in words) and all(w in NOISE or w in JOINTS for w in words):
            return True
    return False


def open_buttons(html: str) -> set[int]:
    """Which start tags of buttons, counted from 0, have no end tag before the next one or the page's end."""
    found = [m[1] for m in _BUTTONS.finditer(html) if m[1] is not None] if "<button" in html.lower() else []
    starts = [k for k, end in enumerate(found) if not end]
    return {n for n, k in enumerate(starts) if k + 1 == len(found) or not found[k + 1]}


def needs_code_pass(html: Column) -> Column:
    return html.contains(WRAPPER) | html.contains("<wbr")


class TolerantParser(HTMLParser):
    """Reads a marked section that the parser refuses as HTML does: as a comment that ends at the next ``>``."""

    def parse_html_declaration(self, i: int) -> int:
        at = self.lineno, self.offset
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # it has moved the position to where it gave up
            self.lineno, self.offset = at
            return self.parse_bogus_comment(i)


class _Wrappers(TolerantParser):
    """Finds code wrappers: (start, end, text of its first pre, or None)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.starts = [0]
        for line in html.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.depth, self.began, self.pre, self.text, self.found = 0, 0, 0, None, []
        self.feed(html)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.depth:
            if tag == "div":
                self.depth += 1
            if tag == "pre" and (self.text is None or self.pre):
                self.pre += 1
                self.text = self.text or []
        elif tag == "div" and WRAPPER in (dict(attrs).get("class") or "").split():
            self.depth, self.began, self.pre, self.text = 1, self._at(), 0, None

    def handle_endtag(self, tag: str) -> None:
        if self.pre and tag == "pre":
            self.pre -= 1
        if self.depth and tag == "div":
            self.depth -= 1
            if not self.depth:
                self.found.append((self.began, self._at() + len("</div>"), None if self.text is None else "".join(self.text)))

    def handle_data(self, data: str) -> None:
        if self.pre and self.text is not None:
            self.text.append(data)


def clean_code(html: str) -> str:
    """Soft breaks go; a code wrapper with a ``pre`` becomes a plain one with the same characters."""
    html = re.sub(r"</?wbr\s*/?>", "", html)
    if WRAPPER not in html:
        return html
    out, last = [], 0
    for start, end, text in _Wrappers(html).found:
        if text is not None:
            safe = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            out += [html[last:start], f"<pre>{safe}</pre>"]
            last = end
    return "".join(out) + html[last:]


def strip_code_wrappers(html: Column | str) -> Column:
    """Pages without wrapper stay in the JVM: Spark sends a Python function's argument whatever the branch around it, so that
    theirs is null."""
    c = F.col(html) if isinstance(html, str) else html

    @F.pandas_udf("string")
    def clean(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda x: clean_code(x) if isinstance(x, str) and (WRAPPER in x or "<wbr" in x) else x)

    return F.when(needs_code_pass(c), F.when(c.contains(WRAPPER), clean(F.when(c.contains(WRAPPER), c))).otherwise(F.regexp_replace(c, r"</?wbr\s*/?>", ""))).otherwise(c)


class _Markdown(TolerantParser):
    def __init__(self, html: str, within: str | None):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.skip, self.pre, self.href, self.lists, self.cells = [], [], 0, 0, [], [], None
        self.within, self.inside = within, int(within is None)  # how many elements of that name are open
        self.head = False
        self.loose, self.buttons = open_buttons(html), 0
        self.feed(html)
        self.close()

    def _put(self, text: str) -> None:
        if self.inside and not self.skip:
            (self.cells[-1] if self.cells else self.out).append(text)

    def _end_head(self) -> None:
        """A head that was left open ends at the first element, or text, that it can't hold."""
        self.head = False
        self.handle_endtag("head")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        names = " ".join(filter(None, (dict(attrs).get("class"), dict(attrs).get("id"))))
        noise = tag in DROPPED or tag not in KEPT and is_noise(names)
        if tag == "button":
            self.buttons += 1
            noise = noise and self.buttons - 1 not in self.loose  # one that is never closed doesn't hold what follows
        if self.head and tag not in HEAD:
            self._end_head()
        if tag == "body":  # so does what was left open in a head
            self.skip, self.stack = 0, []
        self.head |= tag == "head"
        if tag in VOID:
            if tag == "br":
                self._put(" \n" if not self.cells else " ")
            return
        if tag in BLOCKS and self.stack and any(t == "p" for t, _ in self.stack) and tag not in ("tr", "li"):
            while self.stack:
                t, n = self.stack.pop()
                self.skip -= n
                self.inside -= t == self.within
                if t in ("b", "strong"):
                    self._put("**")
                if t == "p":
                    break
        self.stack.append((tag, noise))
        self.skip += noise
        self.inside += tag == self.within
        if tag == "table":
            self._put("\n\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append([])
        elif tag in ("ul", "ol"):
            self.lists.append(tag)
            self._put("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            self._put("\n" + "  " * (len(self.lists) - 1) + ("1. " if self.lists[-1:] == ["ol"] else "- "))
        elif tag == "pre":
            self.pre += 1
            self._put("\n\n```\n")
        elif tag in BLOCKS:
            self._put("\n\n" + "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "\n\n")
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self._put("[")

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, n = self.stack.pop()
            if t in ("b", "strong"):
                self._put("**")
            elif t in ("i", "em"):
                self._put("*")
            elif t == "code" and not self.pre:
                self._put("`")
            elif t == "a" and self.href:
                self._put(f"]({self.href.pop()})")
            elif t == "pre":
                self._put("\n```\n\n")
                self.pre -= 1
            elif t in ("ul", "ol") and self.lists:
                self.lists.pop()
                self._put("\n\n" if not self.lists else "")
            elif t == "tr" and self.cells is not None:
                cells, self.cells = self.cells, None
                if cells:
                    self._put("| " + " | ".join(" ".join("".join(c).split()) for c in cells) + " |\n")
            elif t in BLOCKS and t not in ("li",):
                self._put("\n\n")
            self.skip -= n
            self.inside -= t == self.within
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.head and data.strip() and self.stack and self.stack[-1][0] == "head":
            self._end_head()
        self._put(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(html: str) -> str:
    """Markdown of a page's main part: its article or main element, else its body without menus and the like.

    A name that stands in a comment or script only, or an element without text, isn't that part.
    """
    if not html or not html.strip():
        return ""
    html, text = clean_code(html), ""
    for within in [*(t for t in ("article", "main") if re.search(f"<{t}[\\s>]", html, re.I)), None]:
        text = "".join(_Markdown(html, within).out)
        if text.strip():
            break
    blocks, fenced = [], False
    for line in text.split("\n"):
        if line.strip() == "```":
            fenced = not fenced
        blocks.append(line.rstrip() if fenced else re.sub(r" {2,}", " ", line).rstrip() if not line.startswith("  ") else line.rstrip())
    return "\n".join(blocks).strip()


#: Character references that a title is freed of; the ampersand's last.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def title_element(html: Column | str, references: dict[str, str] = REFERENCES) -> Column:
    """The page's title element in plain text, empty without one; of its character references, those given are decoded."""
    c = F.col(html) if isinstance(html, str) else html
    raw = F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, sign in references.items():
        raw = F.replace(raw, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(raw, r"[ \t\n\f\r]+", " "))


def page_title(html: Column | str, url: Column | str) -> Column:
    """The page's title element in plain text, without pilcrows, else the last part of its address; never empty."""
    return F.coalesce(F.nullif(clean_title(title_element(html)), F.lit("")), title_from_url(url))


def extract_pages(pages: DataFrame, *, html: str = "html", url: str = "url") -> DataFrame:
    """Adds markdown, title, words and error (null: usable) to each page; only the conversion runs in Python."""

    @F.pandas_udf("string")
    def _convert(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda x: to_markdown(x) if isinstance(x, str) else "")

    rows = pages.withColumn("_md", F.when(F.coalesce(F.col(html), F.lit("")) == "", "").otherwise(_convert(F.col(html))))
    rows = rows.withColumn("markdown", F.when(F.col("_md") == "", "").otherwise(clean_markdown("_md"))).drop("_md")
    rows = rows.withColumn("error", extraction_error("markdown"))
    return rows.withColumn("title", page_title(html, url)).withColumn("words", word_count("markdown"))
