"""Main text of web pages from text-to-tag ratios over streaming parser events.

The standard library's parser sends events; block tags cut the text into blocks, the lines of the
method. A line's ratio is its characters over the tags within it. The logarithms of the ratios are
smoothed with a Gaussian along the page, and two means cut them into two clusters: a line's evidence
is its distance from the cut, above 0 for content, in half distances of the means, squeezed into
(-1, 1). The region is the container whose lines have the greatest sum of evidence, so a short
paragraph between long ones, which the smoothing lifts, stays, and what stands beside the region goes
whatever its class. All lines of the region are the text, short ones too.

Tags and classes are features. Elements that HTML itself sets apart from the text (menus, footers,
headers outside an article, asides, scripts, hidden ones and the like) take no part. Below 0, a line
that is all link speaks against what holds it in full, other lines QUIET as much, and lines of an
article or main element not at all; an article's or main element's sum counts ARTICLE times, and a tie goes to it. A line in a
form or in an element whose class or id is a junk word has HINT less; a class counts as a whole, so
share-price is none. Such a mark is void on an element that holds over half of the page's evidence
above 0, one of readers' comments only on an element that holds all of it, and all are void where
nothing else is left. Within the region, marked elements below 0, and elements below 0 whose text is
all in links, are left out.

Defined cases: null, empty or tagless html gives its text or the empty string; unclosed and stray
tags are tolerated; repeated rows are extracted each; an empty table gives an empty result; only
id, url and html are read; nesting may be as deep as it will.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources.tables import table

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article aside blockquote body dd details dialog div dl fieldset figure footer form header html main menu nav noscript object ol search section select svg table tbody td template textarea tfoot thead tr ul li head title button iframe canvas audio video script style".split())
NEVER = frozenset("aside button canvas dialog footer head iframe menu nav noscript object script search select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that can be the region; lists, quotes and the like are parts of one.
REGIONS = frozenset("article body div html main section table tbody td tr".split())
ARTICLES = frozenset(("article", "main"))
JUNK = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
#: Readers' words, which may well be longer than the article.
REPLIES = frozenset("comment comments disqus replies reply".split())
#: Words that only say where an element stands or what shape it has: with junk words alone they leave the mark whole.
SHAPES = frozenset("area bar block bottom box container content form global inner item items layout left link links list main outer page panel post posts primary region right row section secondary site slot text thread top unit wrap wrapper".split())
JUNK_ROLES = frozenset("banner navigation complementary contentinfo search form alert dialog alertdialog menu menubar".split())
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
SIGMA, REACH = 2.0, 4
HINT, QUIET, ARTICLE = 1.0, 0.03, 2.0


def marked(tag: str, named: dict, within: bool) -> set[str]:
    """Junk words of the classes and ids that consist of such and of shapes alone. Within an article a header is the article's own, and a heading is never a page header."""
    found: set[str] = set()
    if tag in ("body", "html") or tag in ARTICLES:
        return found
    for token in f"{named.get('class') or ''} {named.get('id') or ''}".lower().split():
        words = set(WORDS.findall(token.partition("--")[0]))
        if words <= JUNK | SHAPES:
            found |= words & JUNK
    if within or tag not in CONTAINERS:
        found.discard("header")
    return found


def barred(tag: str, named: dict) -> bool:
    """Junk by role or hiding. A page that scripts show is no hidden one."""
    return tag not in ("body", "html") and ((named.get("role") or "").lower() in JUNK_ROLES or "hidden" in named or "display:none" in (named.get("style") or "").replace(" ", "").lower())


class Lines(HTMLParser):
    """Collects the page's lines and the tree of its elements, as lists by number; an element's number is larger than its parent's. Element 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.kind, self.never, self.hint, self.inside = [0], ["html"], [False], [0], [False]
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.holder: list[int] = []
        self.linked: list[bool] = []
        self.parts: list[str] = []
        self.count = 0
        self.plain = self.link = False  # text outside links since the last cut; within a link
        self.stack: list[tuple[str, int]] = []
        self.opened: Counter = Counter()
        self.own = 0  # the element of a paragraph or heading that bears marks itself

    @property
    def at(self) -> int:
        return self.own or (self.stack[-1][1] if self.stack else 0)

    def cut(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.texts.append(text)
            self.tags.append(self.count)
            self.holder.append(self.at)
            self.linked.append(not self.plain)
            self.count = 0
        self.parts.clear()
        self.plain = False

    def _element(self, tag: str, named: dict) -> int:
        """A new element below the open one."""
        up = self.at
        within = self.inside[up]
        words = marked(tag, named, within) if named else set()
        self.parent.append(up)
        self.kind.append(tag)
        self.never.append(self.never[up] or tag in NEVER or tag == "header" and not within or bool(named) and barred(tag, named))
        self.hint.append(2 if words & REPLIES else 1 if words or tag == "form" else 0)
        self.inside.append(within or tag in ARTICLES)
        return len(self.parent) - 1

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag in BLOCKS or tag in CONTAINERS:
            self.cut()
            self.own = 0
            if tag not in CONTAINERS and named and (barred(tag, named) or marked(tag, named, True)):
                self.own = self._element(tag, named)
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.link = True
        self.count += 1
        if tag in CONTAINERS and tag not in VOID:
            if tag in ("li", "td", "tr", "dd") and self.opened[tag]:
                self._close_open(tag)
            number = self._element(tag, named)
            self.stack.append((tag, number))
            self.opened[tag] += 1

    def _close_open(self, tag):
        """An item ends the item before it in the same list or row."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                self._pop(i)
                return
            if name in ("ul", "ol", "menu", "table", "dl", "tbody", "thead", "tfoot") or tag in ("td", "dd") and name == "tr":
                return

    def _pop(self, i):
        for name, _ in self.stack[i:]:
            self.opened[name] -= 1
        del self.stack[i:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # "<div/>" opens a div in html

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in CONTAINERS:
            self.cut()
            self.own = 0
        elif tag == "a":
            self.link = False
        self.count += 1
        if tag in CONTAINERS and self.opened[tag]:
            self._pop(max(i for i, (name, _) in enumerate(self.stack) if name == tag) if self.stack[-1][0] != tag else len(self.stack) - 1)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.parts.append(data)
        self.plain = self.plain or not self.link and not data.isspace()

    def unknown_decl(self, data):
        pass

    def finish(self) -> Lines:
        self.close()
        self.cut()
        return self


def smoothed(x: np.ndarray) -> np.ndarray:
    """Gaussian means along the lines; at the ends over the lines that there are."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    over = lambda v: np.convolve(v, kernel, "full")[REACH : REACH + len(v)]
    return over(x) / over(np.ones(len(x)))


def evidence(ratios: np.ndarray) -> np.ndarray:
    """Each line's evidence of content, in (-1, 1): by the cut between two means of the smoothed ratios. A line counts by the larger of its smoothed and its own value: a paragraph between links is text."""
    x = np.log1p(ratios)
    s = smoothed(x)
    low, high = s.min(), s.max()
    for _ in range(30):
        upper = s >= (low + high) / 2
        if upper.all() or not upper.any():
            break
        low, high = s[~upper].mean(), s[upper].mean()
    d = (np.maximum(s, x) - (low + high) / 2) / max(1e-9, (high - low) / 2)
    return d / (1 + np.abs(d)) if high > low else np.zeros(len(x))


def _sums(page: Lines, values: np.ndarray) -> np.ndarray:
    """Sums of the lines' values over each element and all below it."""
    out = np.bincount(page.holder, values, len(page.parent)).tolist()
    parent = page.parent
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return np.array(out)


def _below(page: Lines, own: np.ndarray) -> np.ndarray:
    """True for the elements that are marked in ``own`` and all below them."""
    out = own.tolist()
    for i, up in enumerate(page.parent[1:], 1):
        out[i] = out[i] or out[up]
    return np.array(out)


def main_text(html: str | None) -> str:
    """The lines of the content region."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    if not page.texts:
        return ""
    holder, never, hint = np.array(page.holder), np.array(page.never), np.array(page.hint)
    ratios = np.array([len(t) / max(1, n) for t, n in zip(page.texts, page.tags)])
    clean = ~never[holder]
    if not clean.any():
        return ""
    e = evidence(ratios)

    def of(lines: np.ndarray) -> np.ndarray:
        """The evidence, or that of these lines among themselves where they have none above 0."""
        if (e[lines] > 0).any():
            return e
        own = np.zeros(len(e))
        own[lines] = evidence(ratios[lines])
        return own

    share = _sums(page, np.where(clean, np.maximum(of(clean), 0), 0))
    hint = (hint > 0) & np.where(hint == 2, share < share[0] - 1e-9, 2 * share <= share[0])
    under = _below(page, hint)
    if not (clean & ~under[holder]).any():
        hint[:] = under[:] = False
    marks, linked, inside = under[holder], np.array(page.linked), np.array(page.inside)[holder]
    e = of(clean & ~marks)
    against = np.minimum(e, 0) * np.where(inside, 0, np.where(linked, 1, QUIET))
    score = np.where(marks, e - HINT, np.maximum(e, 0) + against)
    total = np.round(_sums(page, np.where(clean, score, 0)) * np.where(np.isin(page.kind, list(ARTICLES)), ARTICLE, 1), 9).tolist()
    region = max((i for i, k in enumerate(page.kind) if k in REGIONS), key=lambda i: (total[i], page.kind[i] == "article", page.kind[i] == "main", -i))
    # what the region leaves out; nothing around it counts
    links = _sums(page, np.where(clean & ~linked, 1, 0)) == 0
    out = (hint | links) & (_sums(page, np.where(clean, e - HINT * marks, 0)) < 0)
    around = region
    while around:
        out[around] = False
        around = page.parent[around]
    out[0] = False
    chosen = np.zeros(len(out), bool)
    chosen[region] = True
    keep = clean & _below(page, chosen)[holder] & ~_below(page, out)[holder]
    return "\n".join(t for t, k in zip(page.texts, keep) if k)


def _extracted(batches):
    for batch in batches:
        texts, size = [], 0
        for i in range(batch.num_rows):
            texts.append(main_text(batch.column(2)[i].as_py()))
            size += len(texts[-1])
            if size > 4_000_000 or i == batch.num_rows - 1:
                a = i + 1 - len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), batch.column(1).slice(a, len(texts)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])
                texts, size = [], 0


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row of pages."""
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return pages.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))
