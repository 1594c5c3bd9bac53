"""Main text of web pages from a streaming parse, text-to-tag ratios, smoothing and clustering.

Standard-library parser events cut a page into lines at block elements. Each line has its region
(the innermost sectioning container), its text and its text-to-tag ratio: code points of text over
tags met. Ratios are smoothed along the page with a Gaussian, and a two-cluster threshold on the
smoothed ratios marks content lines; where the ratios' clusters are less than three times apart, all are. A region whose text lies mostly on content lines is content,
and content regions are taken whole, so short paragraphs of an article stay. Menus and link lists are
told by their ratios alone, whatever their elements are called; a page that has nothing else has no
main text.

A line counts as content only if its region's own ratio, all its text over all its tags, is also at
least a third of that of the main region, the one with the most text; a region with less than a fifth
of the main one's text needs a ratio as high as that, or must lie between larger ones.

Names and marks are evidence, never a verdict on text by themselves. A header, footer or aside, by
element or role, and an element whose class or id has a whole token made of names of adverts,
notices, comments or menus is a region that speaks against itself: it counts only if it is content by
its ratios and has more text than all other regions together, for then the name is wrong. A token
that prose may bear too (related, social, share) speaks against its element if that also looks so:
text in links for a third or more, or form fields. An element article or main, or such a role, speaks
for its own lines and sections, which are one region; containers inside it (div, table, td) stay only
as their ratios say, and a content region outside it counts only if it has more text than all that is
marked. Scripts, styles, forms and what is hidden are no text of a page.

Defined cases: null and empty pages give the empty text; markup that is never closed ends with the
page or with its container; unknown declarations are comments; repeated rows are read each; the
result takes the place of an own column of its name; an empty table gives an empty result. A page is
read in time proportional to its length, however many elements stay open."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SILENT = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "form", "dialog"}
ASIDE = {"header", "footer", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4",
    "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "nav", "menu", "form", "dialog",
} | ASIDE
REGION = {"article", "body", "div", "main", "section", "table", "td", "html", "nav", "menu"} | ASIDE
SCOPE_ENDS = {"article", "body", "div", "main", "section", "table", "td", "html"}
ENDS_P = BLOCK - {"br", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "html", "body"}
#: Inside a marked article these are parts of it.
PARTS = {"article", "main", "section"}
#: Elements that end an open one of their own kind, but not beyond these.
OWN_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
SCOPES = {"p": SCOPE_ENDS, **OWN_ENDS}
NOISE = re.compile(
    r"(?:ads?|adv|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscri\w*|signup|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|masthead|comments?|commentlist|respond|disqus|replies|pagination|pager)"
)
DOUBTFUL = re.compile(r"(?:alert|widget|header|reply|share|sharing|social|related|recommend\w*)")
#: What else a noisy token may hold.
NEUTRAL = re.compile(
    r"(?:area|bar|block|bottom|box|button|buttons|center|col|column|container|content|footer|form|group|holder|icons?|inner|item|items|left|link|links|list|main|outer|page|"
    r"panel|post|posts|right|row|section|side|site|slot|text|thread|top|unit|wrap|wrapper|\d+)"
)
FIELDS = {"input", "select", "textarea", "button"}
NOISE_ROLES = {"banner", "contentinfo", "complementary", "alert"}
MENUS, MENU_ROLES = {"nav", "menu"}, {"navigation", "menu", "menubar"}
#: What speaks against a line: nothing, a name, or that it is in a menu, which counts beside a marked article alone.
NONE, NAMED, MENU = range(3)
SILENT_ROLES = {"search", "form", "dialog"}
MAIN_ROLES = {"main", "article"}


def noise(value: str) -> int:
    """2 if a token of this class or id is made of names of noise, 1 if of such as prose may bear, else 0."""
    found = 0
    for token in value.lower().split():
        bits = [x for x in re.split(r"[_-]+", token) if x]
        sure, maybe = (any(r.fullmatch(x) for x in bits) for r in (NOISE, DOUBTFUL))
        if (sure or maybe) and all(NOISE.fullmatch(x) or DOUBTFUL.fullmatch(x) or NEUTRAL.fullmatch(x) for x in bits):
            found = max(found, 2 if sure else 1)
    return found


class Lines(HTMLParser):
    """Collects lines: [region, region of the mark around or 0, text, tags, innermost doubtful element or -1, what speaks against it]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # tag, silent, region, marked, scopes, doubtful, against
        self.number: dict[str, int] = {}  # open elements of a tag
        self.lines: list[list] = []
        self.text: list[str] = []
        self.tags, self.regions, self.links = 0, 0, 0
        self.suspects: list[list[int]] = []  # of each doubtful element: the one around, characters, those in links, form fields

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find("]]>" if self.rawdata.startswith("<![CDATA[", i) else ">", i)
        return len(self.rawdata) if end < 0 else self.rawdata.index(">", end) + 1

    def _top(self):
        return self.open[-1] if self.open else ("", False, 0, 0, dict.fromkeys(SCOPES, -1), -1, NONE)

    def _flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            _, _, region, marked, _, doubtful, against = self._top()
            self.lines.append([region, marked, text, self.tags, doubtful, against])
            self.tags = 0
        self.text = []

    def _cut(self, i):
        """Ends the elements from the ith on."""
        for x in self.open[i:]:
            self.number[x[0]] -= 1
            self.links -= x[0] == "a"
        del self.open[i:]

    def _close(self, tag):
        if self.number.get(tag):
            i, block = len(self.open) - 1, False
            while self.open[i][0] != tag:
                block |= self.open[i][0] in BLOCK
                i -= 1
            if block or tag in BLOCK:
                self._flush()
            self._cut(i)

    def handle_starttag(self, tag, attrs):
        self.tags += not self._top()[1]  # a silent element counts once, whatever is in it
        if tag in BLOCK:
            self._flush()
        if tag in ENDS_P and (i := self._top()[4]["p"]) >= 0:
            self._cut(i)
        if tag in OWN_ENDS and (i := self._top()[4][tag]) >= 0:
            self._cut(i)
        _, silent, region, marked, scopes, doubtful, against = self._top()
        if tag in FIELDS and doubtful >= 0:
            self.suspects[doubtful][3] += 1
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        role = a.get("role", "").lower()
        prose = tag in ("html", "body", "main") or tag == "article" and not marked
        noisy = 0 if prose else max(noise(a.get("class", "")), noise(a.get("id", "")))
        mark = tag in ("article", "main") or role in MAIN_ROLES
        named = noisy == 2 or tag in ASIDE or role in NOISE_ROLES
        menu = tag in MENUS or role in MENU_ROLES
        if (tag in REGION or mark or menu or named and against != NAMED) and not (marked and tag in PARTS and not named and not menu):
            self.regions += 1
            region = self.regions
        against = NAMED if named or against == NAMED else MENU if menu else against
        marked = marked or (region if mark else 0)
        if noisy == 1 and not silent:
            self.suspects.append([doubtful, 0, 0, 0])
            doubtful = len(self.suspects) - 1
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
        silent = bool(silent or tag in SILENT or role in SILENT_ROLES or hidden)
        if changed := {t: len(self.open) if t == tag else -1 for t, ends in SCOPES.items() if t == tag or tag in ends}:
            scopes = scopes | changed
        self.links += tag == "a"
        self.number[tag] = self.number.get(tag, 0) + 1
        self.open.append((tag, silent, region, marked, scopes, doubtful, against))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self._close(tag)

    def handle_endtag(self, tag):
        self.tags += not self._top()[1]
        if tag in BLOCK:
            self._flush()
        self._close(tag)

    def handle_data(self, data):
        _, silent, _, _, _, doubtful, _ = self._top()
        if not silent:
            self.text.append(data)
            if doubtful >= 0:
                n = len("".join(data.split()))
                self.suspects[doubtful][1] += n
                self.suspects[doubtful][2] += n * (self.links > 0)

    def read(self, html: str) -> list[list]:
        """The lines of a page; those in doubtful elements that look like noise have a name against them."""
        self.feed(html)
        self.close()
        self._flush()
        for around, *own in reversed(self.suspects):  # an element's text counts for those around it
            if around >= 0:
                self.suspects[around][1:] = [a + b for a, b in zip(self.suspects[around][1:], own, strict=True)]
        out = [False]  # the last one stands for no doubtful element
        for k, (around, n, linked, fields) in enumerate(self.suspects):
            out.insert(k, bool(fields or 3 * linked >= n or around >= 0 and out[around]))
        return [[*x[:5], NAMED if out[x[4]] else x[5]] for x in self.lines]


def smooth(x: list[float], sigma: float = 1.5) -> list[float]:
    """x under a Gaussian of this deviation, renormalised at the ends."""
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-4, 5)]
    out = []
    for i in range(len(x)):
        w = [(k[j - i + 4], x[j]) for j in range(max(0, i - 4), min(len(x), i + 5))]
        out.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
    return out


def clusters(x: list[float]) -> tuple[float, float]:
    """The means of the two clusters of x."""
    lo, hi = min(x), max(x)
    for _ in range(20):
        at = (lo + hi) / 2
        a, b = [v for v in x if v <= at], [v for v in x if v > at]
        new = (sum(a) / len(a) if a else lo, sum(b) / len(b) if b else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return lo, hi


def on_content(lines: list[list], apart: float = 3.0, part: float = 1 / 3, small: float = 0.2) -> list[bool]:
    """Which lines are content by their ratios: above the middle between the two clusters of the smoothed ratios (all, if the ratios' own
    clusters are less than so many times apart), in a region whose own ratio stands beside that of the region with the most text."""
    text, tags = {}, {}
    for x in lines:
        text[x[0]], tags[x[0]] = text.get(x[0], 0) + len(x[2]), tags.get(x[0], 0) + max(1, x[3])
    main = max(text, key=lambda g: (text[g], -g))
    beside = lambda g: text[g] * tags[main] / (text[main] * tags[g])
    large = {g for g in text if beside(g) >= part and (text[g] >= small * text[main] or beside(g) >= 1)}
    places = [k for k, x in enumerate(lines) if x[0] in large]
    good = large | {x[0] for x in lines[places[0] : places[-1]] if beside(x[0]) >= part}
    ratios = [len(x[2]) / max(1, x[3]) for x in lines]
    lo, hi = clusters(ratios)
    if hi < apart * lo:
        return [x[0] in good for x in lines]
    flat = smooth(ratios)
    at = sum(clusters(flat)) / 2
    return [r > at and x[0] in good for x, r in zip(lines, flat, strict=True)]


def content(lines: list[list]) -> list[list]:
    """The lines of the content regions of a page."""
    lines = [[-1 - x[0] if x[5] == NAMED and x[4] >= 0 else x[0], *x[1:]] for x in lines]  # a doubtful element's lines stand apart from the region around them
    if all(x[5] != NONE for x in lines):
        return []  # nothing stands beside the menus and notices that their ratios could be held against
    size, on, marks, against = {}, {}, {}, {}
    for x, r in zip(lines, on_content(lines), strict=True):
        size[x[0]] = size.get(x[0], 0) + len(x[2])
        on[x[0]] = on.get(x[0], 0) + len(x[2]) * r
        marks[x[0]], against[x[0]] = x[1], x[5]
    whole, free = sum(size.values()), [g for g in size if against[g] != NAMED]
    chosen = {g for g in size if 2 * on[g] >= size[g] and (against[g] != NAMED or 2 * size[g] > whole)}
    if any(marks[g] for g in free):
        chosen |= {m for m in marks.values() if m in free}
        inside = {g for g in chosen if marks[g]} or {max((g for g in free if marks[g]), key=lambda g: (size[g], -g))}
        marked = sum(size[g] for g in inside)
        chosen = inside | {g for g in chosen if size[g] > marked and against[g] == NONE}
    chosen = chosen or {max(size, key=lambda g: (against[g] != NAMED, on[g], size[g], -g))}
    return [x for x in lines if x[0] in chosen]


def main_text(html: str | None) -> str:
    """The text of the content regions of a page: blocks in page order, joined by one space."""
    lines = Lines().read(html) if html else []
    return " ".join(x[2] for x in content(lines)) if lines else ""


def extract(pages: DataFrame, out: str = "text") -> DataFrame:
    """pages with the main text of their column html in the column out."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(h) for h in part], dtype=object)

    return pages.withColumn(out, run(pages["html"]))


def op9(spark, pages: DataFrame) -> DataFrame:
    got = extract(pages.select("page_id", "url", "html"), "text")
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
