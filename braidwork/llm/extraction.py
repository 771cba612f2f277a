"""Main text of web pages: a page becomes a flat list of text blocks, and a decision tree over each block's words and link
density, those of its neighbours and what it stands in keeps the article's.

The tree is trained on the table BLOCKS of labelled blocks of invented pages and applied as one expression of built-in
functions; only the cutting of markup into blocks is Python.

Edge cases: a null, empty or textless page gives an empty text; tags left open or cut off at the end of a page end there, and
scripts, styles and comments without an end go on to the end; stray end tags are passed over; `<br>` and all white space in a
block, also from character references, become one space; a text of any length stays whole; rows equal in id are rows of their
own; other columns, whatever their names, are kept by main_text() and not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import fresh

#: A comment, declaration, end or start tag, or text.
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
#: Elements that are no text of the page, up to their end tags; the first ones hold no markup.
RAW = frozenset("script style noscript template iframe title textarea xmp noembed noframes".split())
MUTE = frozenset("select button svg math object canvas audio video datalist".split())
#: Elements that begin and end a block; those of them that have no end tag.
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("hr br img input link meta area base col embed source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends where it stands directly in it.
ENDED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
#: Elements, roles and words of class and id that say what an element is: an article, the main part, or something apart.
ARTICLE_TAGS, MAIN_TAGS, APART_TAGS = {"article"}, {"main"}, {"nav", "aside", "footer", "form", "menu", "dialog", "search"}
ARTICLE_WORDS = frozenset("article articlebody post entry story".split())
MAIN_WORDS = frozenset("main content".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus disclaimer footer footnav form gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification alert overlay pager pagination popup promo promoted promotion recommended related "
    "reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words beside which a cue only describes a layout: class="with-sidebar".
LAYOUT = frozenset("has with without no not is wrapper layout page site container".split())
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS_OF = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    """text; words, and those of them in links; heading; what it stands in: nothing known 0, the main part 1, an article 2;
    apart, where something around it is a menu, footer, form, advert and the like."""

    text: str
    words: int
    linked: int
    heading: int
    inside: int
    apart: int


@cache
def _cues(named: str) -> tuple[int, int]:
    """What a class or id says: inside, apart."""
    inside = apart = 0
    for name in named.split():
        words = [w.lower() for w in WORDS_OF.findall(name)]
        if LAYOUT.isdisjoint(words):
            apart |= not APART_WORDS.isdisjoint(words)
            inside = max(inside, 2 * (not ARTICLE_WORDS.isdisjoint(words)), 1 * (not MAIN_WORDS.isdisjoint(words)))
    return (0, 1) if apart else (inside, 0)


def _standing(tag: str, attributes: str, around: tuple[int, int, str]) -> tuple[int, int, str]:
    """inside, apart and the last element that made it apart, for what an element holds."""
    inside, apart, by = around
    cue = (0, 0)
    if attributes:
        has = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        named, role = f"{has.get('class', '')} {has.get('id', '')} {has.get('itemprop', '')}", has.get("role", "").lower()
        cue = _cues(named) if tag not in ("html", "body") and named.strip() else cue
        hidden = "hidden" in has or "display:none" in has.get("style", "").replace(" ", "").lower()
        if role in APART_ROLES or hidden:
            cue = (0, 1)
        elif role in ("main", "article") and not cue[1]:
            cue = (max(cue[0], 1 + (role == "article")), 0)
    if tag in ARTICLE_TAGS or tag in MAIN_TAGS:
        if not cue[1] and by == "form":  # a form around the whole page
            apart, by = 0, ""
        cue = cue if cue[1] else (2 if tag in ARTICLE_TAGS else max(1, cue[0]), 0)
    elif tag in APART_TAGS or tag == "header" and not inside:
        cue = (0, 1)
    elif tag == "header":  # an article's own, with its headline
        cue = (0, 0)
    if cue[1] and not apart:
        apart, by = 1, tag
    return max(inside, cue[0]), apart, by


def blocks(page: str) -> list[Block]:
    """The page's blocks in order: what stands between two tags that break lines, with character references decoded, white
    space turned into single spaces, and empty blocks left out."""
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    link = mute = 0
    heading = ""
    open_: list[tuple[str, tuple[int, int, str]]] = [("", (0, 0, ""))]

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            inside, apart, _ = open_[-1][1]
            found.append(Block(text, text.count(" ") + 1, min(linked, text.count(" ") + 1), int(bool(heading)), inside, apart))
        parts.clear()
        linked = 0

    def close(tag: str) -> None:
        """Ends the innermost `tag` and all in it, where one is open."""
        for at in range(len(open_) - 1, 0, -1):
            if open_[at][0] == tag:
                del open_[at:]
                return

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if mute or text.startswith(("<!", "<?")):
                continue
            text = markup.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked += len(text.split())
            continue
        tag, end, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not end:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
                if tag == "title":
                    flush()
        elif tag in MUTE:
            mute = max(0, mute + (-1 if end else 1)) if not attributes.endswith("/") else mute
        elif tag == "a":
            link = int(not end)
        elif tag == "br":
            parts.append(" ")
        elif tag in BREAKS:
            flush()
            link, mute = (0, 0) if tag in ("article", "main", "body", "section", "footer", "nav") else (link, mute)
            heading = (tag if not end else "") if tag in HEADINGS else heading if tag not in ("p", "div", "section", "ul", "table") else ""
            if end:
                close(tag)
            elif tag not in VOID:
                while open_[-1][0] == "p" or open_[-1][0] in ENDED_BY.get(tag, ()):
                    open_.pop()
                open_.append((tag, _standing(tag, attributes, open_[-1][1])))
        elif tag in ("img", "input", "wbr", "embed") and tag != "wbr":
            parts.append(" ")
    flush()
    return found


#: A labelled block of an invented page: (inside, apart, heading, words, words in links, 1 if it is the article's).
#: Blocks of one page stand in their order. Own observations, not fixed values.
BLOCKS: tuple[tuple[tuple[int, int, int, int, int, int], ...], ...] = (
    # A menu, an advert, an article of paragraphs of any length, a footer.
    ((0, 1, 0, 1, 1, 0), (0, 1, 0, 1, 1, 0), (0, 1, 0, 2, 2, 0), (0, 1, 0, 8, 0, 0), (2, 0, 1, 9, 0, 1), (2, 0, 0, 60, 0, 1), (2, 0, 0, 1, 0, 1), (2, 0, 0, 2, 0, 1), (2, 0, 0, 35, 2, 1), (0, 1, 0, 12, 0, 0)),
    ((0, 1, 0, 1, 1, 0), (0, 1, 0, 30, 0, 0), (2, 0, 1, 3, 0, 1), (2, 0, 0, 3, 0, 1), (0, 1, 0, 5, 0, 0)),
    # A sidebar, a notice and readers' comments as long as an article; a link by itself in the text, a list of links after it.
    ((0, 1, 0, 40, 1, 0), (2, 0, 1, 5, 0, 1), (2, 0, 0, 45, 1, 1), (2, 0, 0, 4, 4, 1), (2, 0, 0, 50, 0, 1), (2, 1, 0, 55, 0, 0), (2, 1, 0, 20, 0, 0), (0, 1, 0, 70, 3, 0)),
    ((2, 0, 1, 6, 6, 1), (2, 0, 0, 30, 0, 1), (2, 0, 0, 25, 3, 1), (2, 0, 0, 6, 6, 0), (2, 0, 0, 7, 7, 0), (2, 0, 0, 5, 5, 0), (2, 0, 0, 6, 6, 0)),
    ((2, 0, 0, 2, 2, 0), (2, 0, 0, 1, 1, 0), (2, 0, 0, 3, 3, 0), (2, 0, 1, 7, 0, 1), (2, 0, 0, 22, 0, 1), (2, 1, 0, 4, 4, 0), (2, 1, 0, 9, 0, 0)),
    # Something before and after an article that says nothing of itself.
    ((0, 0, 0, 3, 3, 0), (0, 0, 0, 25, 0, 0), (2, 0, 1, 8, 0, 1), (2, 0, 0, 80, 0, 1), (2, 0, 0, 6, 0, 1), (0, 0, 0, 30, 0, 0), (0, 0, 0, 4, 0, 0)),
    ((0, 0, 1, 2, 0, 0), (0, 0, 0, 14, 0, 0), (2, 0, 0, 33, 0, 1), (2, 0, 0, 12, 0, 1), (0, 0, 0, 50, 2, 0)),
    # A main part without an article.
    ((0, 1, 0, 1, 1, 0), (1, 0, 1, 4, 0, 1), (1, 0, 0, 28, 2, 1), (1, 0, 0, 3, 0, 1), (1, 1, 0, 12, 0, 0), (0, 0, 0, 9, 0, 0), (0, 1, 0, 3, 3, 0)),
    ((0, 0, 0, 2, 2, 0), (1, 0, 1, 6, 0, 1), (1, 0, 0, 2, 0, 1), (1, 0, 0, 5, 0, 1), (1, 0, 0, 44, 5, 1), (0, 0, 0, 20, 1, 0)),
    # Pages that say nothing of their parts.
    ((0, 0, 0, 1, 1, 0), (0, 0, 0, 1, 1, 0), (0, 0, 0, 2, 2, 0), (0, 0, 1, 6, 0, 1), (0, 0, 0, 48, 2, 1), (0, 0, 0, 62, 0, 1), (0, 0, 0, 7, 0, 1), (0, 0, 0, 38, 1, 1), (0, 0, 0, 3, 3, 0), (0, 0, 0, 5, 2, 0)),
    ((0, 0, 0, 4, 4, 0), (0, 0, 0, 3, 3, 0), (0, 0, 1, 5, 0, 1), (0, 0, 0, 24, 0, 1), (0, 0, 0, 18, 1, 1), (0, 0, 0, 90, 4, 1), (0, 0, 0, 2, 2, 0), (0, 0, 0, 6, 0, 0)),
    ((0, 0, 0, 9, 9, 0), (0, 0, 0, 12, 8, 0), (0, 0, 0, 31, 0, 1), (0, 0, 0, 27, 0, 1), (0, 0, 0, 4, 0, 1), (0, 0, 0, 40, 0, 1), (0, 0, 0, 10, 10, 0), (0, 0, 0, 14, 12, 0)),
    ((0, 0, 0, 60, 0, 1),),
    ((0, 0, 1, 5, 0, 1), (0, 0, 0, 30, 0, 1), (0, 0, 0, 45, 1, 1)),
    ((0, 0, 0, 14, 14, 0), (0, 0, 0, 8, 7, 0), (0, 0, 0, 20, 0, 1), (0, 0, 0, 55, 2, 1), (0, 0, 0, 33, 0, 1), (0, 0, 0, 9, 8, 0), (0, 0, 0, 4, 4, 0), (0, 0, 0, 8, 2, 0)),
    ((0, 0, 0, 2, 2, 0), (0, 0, 1, 9, 0, 1), (0, 0, 0, 81, 4, 1), (0, 0, 0, 66, 2, 1), (0, 0, 0, 5, 0, 1), (0, 0, 0, 74, 0, 1), (0, 0, 0, 6, 6, 0), (0, 0, 0, 7, 1, 0)),
    ((0, 0, 0, 26, 1, 1), (0, 0, 0, 73, 3, 1), (0, 0, 0, 3, 3, 0)),
    ((0, 0, 1, 3, 0, 1), (0, 0, 0, 92, 0, 1)),
    ((0, 0, 0, 64, 2, 1), (0, 0, 0, 50, 1, 1)),
    # Only menus; only an article.
    ((0, 1, 0, 2, 2, 0), (0, 1, 0, 1, 1, 0), (0, 1, 0, 16, 0, 0), (0, 1, 0, 6, 6, 0)),
    ((2, 0, 1, 4, 0, 1), (2, 0, 0, 70, 0, 1), (2, 0, 0, 1, 0, 1)),
    ((2, 0, 0, 5, 0, 1), (2, 0, 0, 8, 1, 1), (2, 0, 0, 120, 2, 1), (2, 0, 0, 15, 14, 1), (2, 0, 0, 66, 0, 1)),
    ((2, 0, 0, 5, 0, 1), (2, 0, 0, 3, 0, 1)),
    ((2, 0, 1, 3, 0, 1), (2, 0, 0, 2, 0, 1), (2, 0, 0, 1, 0, 1)),
    ((1, 0, 0, 4, 0, 1), (1, 0, 0, 9, 0, 1), (1, 0, 0, 2, 0, 1)),
    ((2, 0, 0, 1, 0, 1),),
    ((1, 0, 0, 3, 0, 1),),
    # Menus, adverts and notices right beside long paragraphs.
    ((0, 1, 0, 1, 1, 0), (0, 1, 0, 7, 0, 0), (2, 0, 0, 60, 0, 1), (2, 0, 0, 41, 0, 1), (0, 1, 0, 45, 1, 0), (0, 1, 0, 3, 3, 0), (0, 1, 0, 80, 0, 0), (0, 1, 0, 90, 2, 0)),
    ((0, 1, 0, 1, 1, 0), (0, 1, 0, 2, 2, 0), (0, 0, 0, 70, 1, 1), (0, 0, 0, 52, 0, 1), (0, 1, 0, 64, 0, 0), (0, 1, 0, 44, 0, 0), (0, 1, 0, 6, 0, 0)),
    ((0, 0, 0, 5, 5, 0), (0, 0, 0, 16, 0, 0), (0, 0, 1, 4, 0, 0), (2, 0, 0, 75, 0, 1), (2, 0, 0, 48, 1, 1), (0, 0, 0, 38, 0, 0), (0, 0, 0, 55, 0, 0), (0, 1, 1, 2, 0, 0), (0, 1, 0, 50, 0, 0), (0, 1, 0, 40, 0, 0)),
    ((0, 1, 1, 3, 0, 0), (0, 1, 0, 20, 2, 0), (0, 1, 0, 36, 2, 0), (0, 0, 1, 5, 0, 1), (0, 0, 0, 39, 0, 1), (0, 0, 0, 8, 0, 1), (0, 0, 0, 71, 3, 1), (0, 1, 1, 1, 0, 0), (0, 1, 0, 33, 0, 0), (0, 1, 0, 47, 0, 0)),
    ((0, 1, 0, 1, 1, 0), (2, 0, 1, 5, 5, 1), (2, 0, 0, 36, 1, 1), (2, 0, 0, 4, 4, 0), (2, 0, 0, 9, 9, 0), (2, 0, 0, 6, 6, 0), (0, 1, 0, 6, 0, 0)),
    ((1, 0, 1, 7, 0, 1), (1, 0, 0, 24, 0, 1), (1, 0, 0, 5, 5, 0), (1, 0, 0, 7, 7, 0), (1, 0, 0, 4, 4, 0), (1, 0, 0, 8, 8, 0), (0, 1, 0, 11, 1, 0)),
    ((2, 0, 1, 7, 7, 1), (2, 0, 0, 9, 5, 1), (2, 0, 0, 16, 8, 1), (2, 0, 0, 40, 30, 1), (2, 0, 0, 12, 0, 1), (2, 0, 0, 4, 4, 1)),
    ((2, 0, 1, 4, 0, 1), (2, 0, 0, 20, 0, 1), (2, 0, 0, 3, 3, 1), (2, 0, 0, 30, 0, 1)),
    ((1, 0, 0, 40, 1, 1), (1, 0, 0, 4, 4, 1), (1, 0, 0, 2, 0, 1)),
    # Half of the words linked, in the text and at its ends.
    ((0, 1, 0, 2, 2, 0), (2, 0, 0, 6, 3, 1), (2, 0, 0, 20, 9, 1), (2, 0, 0, 10, 5, 1), (2, 0, 0, 3, 3, 1), (0, 1, 0, 9, 0, 0)),
    ((0, 1, 0, 2, 2, 0), (2, 0, 1, 8, 8, 1), (2, 0, 0, 12, 0, 1), (2, 0, 0, 2, 2, 1), (2, 0, 0, 30, 20, 1), (2, 0, 0, 5, 5, 1)),
)
#: What the tree may ask of a block; density is the share of words in links, lacks how far the page's article is further inside.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "inside", "lacks", "apart")
DEPTH = 7


def lacks(page: list[Block]) -> list[int]:
    """For each block how much further inside the article is: the innermost kind of place that holds at least a fourth of
    the page's words outside links and parts that stand apart."""
    plain = [(b.inside, b.words - b.linked) for b in page if not b.apart]
    total = sum(n for _, n in plain)
    best = max((level for level in (0, 1, 2) if 4 * sum(n for inside, n in plain if inside >= level) >= total), default=0) if total else 0
    return [max(0, best - b.inside) for b in page]


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of BLOCKS."""
    rows, labels = [], []
    for page in BLOCKS:
        own = [Block("", words, linked, heading, inside, apart) for inside, apart, heading, words, linked, _ in page]
        size = [(0.0, 0.0), *[(float(b.words), b.linked / b.words) for b in own], (0.0, 0.0)]
        rows += [(*size[i + 1], *size[i], *size[i + 2], b.heading, b.inside, short, b.apart) for i, (b, short) in enumerate(zip(own, lacks(own), strict=True))]
        labels += [b[-1] for b in page]
    return np.array(rows, float), np.array(labels)


class Split(NamedTuple):
    """A block whose `feature` is at most `at` goes `low`, others go `high`."""

    feature: str
    at: float
    low: Split | int
    high: Split | int


def trained(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Split | int:
    """A tree of splits of least Gini impurity; equal ones go to the earlier feature and lower value. Leaves are labels."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() > len(y))

    def impurity(part: np.ndarray) -> float:
        return len(part) * (p := part.mean()) * (1 - p) if len(part) else 0.0

    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            cost = impurity(y[low]) + impurity(y[~low])
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(at)
    if best is None:
        return int(2 * y.sum() > len(y))
    low = x[:, best[1]] <= best[2]
    return Split(FEATURES[best[1]], best[2], trained(x[low], y[low], depth - 1), trained(x[~low], y[~low], depth - 1))


def verdict(tree: Split | int, of: dict[str, Column]) -> Column:
    """The tree as an expression over a block's features."""
    if isinstance(tree, int):
        return F.lit(bool(tree))
    return F.when(of[tree.feature] <= tree.at, verdict(tree.low, of)).otherwise(verdict(tree.high, of))


BLOCK = "array<struct<text: string, words: int, linked: int, heading: int, inside: int, apart: int, lacks: int>>"


def cut(html: Column) -> Column:
    """The blocks of a page as an array of structs; none for null."""

    @F.pandas_udf(BLOCK)
    def of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in pages:
            found = (blocks(p) if p else [] for p in series)
            yield pd.Series([[{"text": b.text, "words": b.words, "linked": b.linked, "heading": b.heading, "inside": b.inside, "apart": b.apart, "lacks": short} for b, short in zip(page, lacks(page), strict=True)] for page in found], dtype=object)

    return of(html)


def judged(page: Column, tree: Split | int | None = None) -> Column:
    """The blocks of the array `page` that the tree keeps."""
    tree = trained(*labelled()) if tree is None else tree

    def keep(b: Column, i: Column) -> Column:
        before, after = F.get(page, i - 1), F.get(page, i + 1)
        density = lambda x: F.coalesce(x["linked"] / x["words"], F.lit(0.0))
        words = lambda x: F.coalesce(x["words"], F.lit(0))
        of = {"words": b["words"], "density": density(b), "words_before": words(before), "density_before": density(before), "words_after": words(after), "density_after": density(after)}
        return verdict(tree, of | {f: b[f] for f in ("heading", "inside", "lacks", "apart")})

    return F.filter(page, keep)


def main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` with a column `out`: the kept blocks of `html`, one to a line."""
    page = fresh(pages, "_page")
    cut_up = pages.withColumn(page, cut(F.col(html)))
    return cut_up.withColumn(out, F.array_join(F.transform(judged(F.col(page)), lambda b: b["text"]), "\n")).drop(page)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    own = main_text(pages.select("page_id", "url", "html"))
    return own.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
