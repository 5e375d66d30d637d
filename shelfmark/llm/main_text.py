"""Main text of a web page: flat text blocks classified by a decision tree.

A page is read as a row of text blocks: block-level tags end a block, other tags do not, and
scripts, styles, comments and markup are no text. Each block is described by its words and link
density and those of the blocks before and after it, and by what encloses it: an article (an
element or a name like ``post-body``, or where a page has neither, one like ``main`` or ``content``), or
parts that surround one (menus, headers, footers, sidebars, notices, adverts, forms, comments) by
their element or by a class or id that names them as a whole. What holds the first article of a page
does not surround it by its name.
A small decision tree, trained here on the labelled blocks below, says which blocks are main text.

Defined cases: null or empty html, and pages without main text, give an empty text; cut pages
end where they end (an unfinished tag is markup); elements that are not ended end with their parent,
paragraphs at the next block, and buttons, drawings and the like at an article; pages of any length are read whole; repeated
rows are read each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names as HTML defines them, and the words that pages use in class and id.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = ("script", "style", "noscript", "template", "svg", "math", "iframe", "textarea", "head", "title", "select", "button", "object", "canvas")
MAIN_TAGS = frozenset(("article", "main"))
AROUND_TAGS = frozenset("nav header footer aside form menu dialog".split())
AROUND_WORDS = frozenset(
    "ad ads adsense adslot adunit advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies copyright "
    "disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted related reply replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split())
#: What may stand beside them in a name: ``comment-list`` names comments, ``no-sidebar`` no sidebar.
BESIDE_WORDS = frozenset(
    "area author bar block body box button buttons container entry inner item items link links list message post "
    "posts section site text top bottom wrap wrapper".split())
MAIN_WORDS = frozenset(("article", "articlebody", "entry", "post", "story"))
#: Names that mark the article where nothing above does: ``id=main``, ``class="main-content"``.
WEAK_WORDS = frozenset(("main", "content", "maincontent", "primary", "bodytext"))
FOREIGN = frozenset(("svg", "math"))
#: Opening tags that end an open paragraph; elements that may stand in a head; elements without
#: text that can't hold an article, so that one ends them where their own end is missing.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
IN_HEAD = frozenset("base link meta noscript object template".split())
NO_ARTICLE = frozenset("svg math iframe select button object canvas head".split())

# content of the first elements is no markup; the others without text are open elements
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)", re.S | re.I)
CLOSED = re.compile(r"(?:^|[\s\"'])/$")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")

#: Features of a block, in the order of the labelled table.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "around", "page_has_main", "points")

#: Labelled blocks (a bounded table, written by hand): words, link density of the block, of the one before, of the one after (words and
#: density each); inside an article; inside surrounding parts; page marks its article; ends in a
#: full stop; main text or not.
LABELLED = np.array([
    # menus and lists of links
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 0), (2, 1.0, 1, 1.0, 4, 0.0, 0, 1, 1, 1, 0),
    (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (5, 0.8, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (12, 0.9, 4, 1.0, 8, 1.0, 0, 0, 0, 0, 0), (8, 1.0, 6, 0.9, 9, 1.0, 0, 0, 1, 0, 0), (20, 0.7, 9, 1.0, 4, 0.5, 0, 0, 0, 0, 0),
    # adverts and notices
    (4, 0.0, 1, 1.0, 8, 0.0, 0, 1, 1, 1, 0), (12, 0.0, 1, 1.0, 10, 0.0, 0, 1, 1, 1, 0), (9, 0.3, 2, 1.0, 10, 0.0, 0, 1, 1, 0, 0),
    (25, 0.1, 0, 0.0, 12, 0.0, 0, 1, 1, 1, 0), (40, 0.05, 3, 1.0, 60, 0.0, 0, 1, 0, 1, 0), (14, 0.0, 80, 0.0, 70, 0.0, 1, 1, 1, 1, 0),
    # footers, copyright, reader comments, forms
    (11, 0.0, 90, 0.0, 0, 0.0, 0, 1, 1, 1, 0), (18, 0.0, 40, 0.0, 0, 0.0, 0, 1, 1, 1, 0), (30, 0.0, 22, 0.0, 0, 0.0, 0, 1, 1, 1, 0),
    (45, 0.0, 30, 0.0, 20, 0.0, 0, 1, 1, 1, 0), (60, 0.0, 10, 0.2, 35, 0.0, 0, 1, 0, 1, 0), (22, 0.0, 60, 0.0, 15, 0.0, 1, 1, 1, 1, 0),
    (3, 0.0, 2, 0.0, 2, 0.0, 0, 1, 0, 0, 0), (6, 0.0, 70, 0.0, 3, 0.0, 1, 1, 1, 0, 0),
    # text beside a marked article
    (15, 0.0, 2, 1.0, 6, 0.0, 0, 0, 1, 1, 0), (6, 0.0, 40, 0.0, 4, 1.0, 0, 0, 1, 0, 0), (50, 0.1, 60, 0.0, 0, 0.0, 0, 0, 1, 1, 0),
    (30, 0.0, 3, 1.0, 45, 0.0, 0, 0, 1, 1, 0), (18, 0.0, 50, 0.0, 30, 0.0, 0, 0, 1, 1, 0), (70, 0.0, 25, 0.0, 12, 0.0, 0, 0, 1, 1, 0),
    (9, 0.0, 10, 0.0, 80, 0.0, 0, 0, 1, 0, 0),
    # short crumbs of pages that mark no article
    (2, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (5, 0.2, 3, 0.6, 4, 1.0, 0, 0, 0, 0, 0),
    (7, 0.0, 5, 0.9, 0, 0.0, 0, 0, 0, 1, 0), (6, 0.0, 8, 0.7, 1, 1.0, 0, 0, 0, 0, 0),
    # menus, footers, notices and reader comments of pages that mark no article, long ones too
    (90, 0.0, 3, 1.0, 60, 0.0, 0, 1, 0, 1, 0), (95, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0, 1, 0), (70, 0.1, 40, 0.0, 55, 0.0, 0, 1, 0, 1, 0),
    (120, 0.0, 90, 0.0, 80, 0.0, 0, 1, 0, 1, 0), (30, 0.0, 20, 0.0, 25, 0.0, 0, 1, 0, 0, 0), (16, 0.2, 50, 0.0, 18, 0.1, 0, 1, 0, 1, 0),
    (9, 0.0, 60, 0.0, 12, 0.0, 0, 1, 0, 0, 0), (40, 0.0, 35, 0.0, 30, 0.0, 0, 1, 0, 1, 0),
    # long lists of links where no article is marked
    (90, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1, 0), (60, 0.9, 70, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (45, 0.75, 20, 1.0, 80, 0.0, 0, 0, 0, 1, 0),
    (120, 0.95, 90, 0.0, 50, 0.0, 0, 0, 0, 0, 0), (25, 1.0, 60, 0.0, 30, 1.0, 0, 0, 0, 0, 0),
    # lists of links inside a marked article: long, or beside other linked blocks
    (90, 1.0, 60, 0.0, 40, 0.0, 1, 0, 1, 0, 0), (60, 0.95, 80, 0.0, 0, 0.0, 1, 0, 1, 1, 0), (40, 0.9, 30, 0.0, 50, 0.0, 1, 0, 1, 0, 0),
    (12, 1.0, 10, 1.0, 15, 1.0, 1, 0, 1, 0, 0), (6, 1.0, 12, 1.0, 8, 1.0, 1, 0, 1, 0, 0), (9, 1.0, 7, 1.0, 30, 0.0, 1, 0, 1, 0, 0),
    (5, 1.0, 50, 0.0, 6, 1.0, 1, 0, 1, 0, 0), (8, 0.9, 9, 1.0, 5, 0.9, 1, 0, 1, 1, 0), (30, 1.0, 25, 1.0, 20, 1.0, 1, 0, 1, 0, 0),
    # headings and paragraphs of marked articles; a heading or a short line may be one link
    (6, 1.0, 0, 0.0, 60, 0.0, 1, 0, 1, 0, 1), (9, 1.0, 5, 0.0, 80, 0.0, 1, 0, 1, 0, 1), (12, 1.0, 4, 0.0, 35, 0.0, 1, 0, 1, 0, 1),
    (4, 1.0, 40, 0.0, 50, 0.0, 1, 0, 1, 1, 1), (35, 0.5, 60, 0.0, 40, 0.0, 1, 0, 1, 1, 1), (80, 0.3, 70, 0.0, 60, 0.1, 1, 0, 1, 1, 1),
    (50, 0.0, 9, 1.0, 70, 0.0, 1, 0, 1, 1, 1), (28, 0.0, 40, 0.0, 12, 1.0, 1, 0, 1, 1, 1), (14, 0.0, 6, 1.0, 8, 1.0, 1, 0, 1, 1, 1),
    (8, 0.0, 12, 0.0, 40, 0.0, 1, 0, 1, 0, 1), (10, 0.0, 6, 0.0, 20, 0.0, 1, 0, 1, 0, 1), (1, 0.0, 10, 0.0, 60, 0.0, 1, 0, 1, 1, 1),
    (3, 0.0, 80, 0.0, 11, 0.0, 1, 0, 1, 1, 1), (40, 0.0, 10, 0.0, 90, 0.0, 1, 0, 1, 1, 1), (120, 0.05, 40, 0.0, 80, 0.1, 1, 0, 1, 1, 1),
    (200, 0.0, 120, 0.0, 12, 0.0, 1, 0, 1, 1, 1), (15, 0.4, 90, 0.0, 40, 0.0, 1, 0, 1, 1, 1), (2, 1.0, 60, 0.0, 30, 0.0, 1, 0, 1, 1, 1),
    (25, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 1, 1), (5, 0.0, 30, 0.0, 0, 0.0, 1, 0, 1, 1, 1), (9, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1, 0, 1),
    (30, 0.0, 50, 0.0, 2, 1.0, 1, 0, 1, 1, 1), (45, 0.1, 8, 0.0, 1, 1.0, 1, 0, 1, 1, 1), (4, 0.0, 2, 1.0, 3, 1.0, 1, 0, 1, 1, 1),
    (12, 0.0, 4, 1.0, 5, 0.9, 1, 0, 1, 0, 1), (2, 0.0, 90, 0.0, 4, 0.0, 1, 0, 1, 0, 1), (6, 0.2, 3, 0.0, 5, 0.0, 1, 0, 1, 1, 1),
    # paragraphs and headings of pages that mark no article
    (60, 0.0, 3, 1.0, 70, 0.0, 0, 0, 0, 1, 1), (35, 0.05, 60, 0.0, 50, 0.0, 0, 0, 0, 1, 1), (90, 0.1, 8, 0.0, 40, 0.0, 0, 0, 0, 1, 1),
    (22, 0.0, 50, 0.0, 6, 0.5, 0, 0, 0, 1, 1), (18, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0, 1, 1), (9, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 0, 1),
    (10, 0.0, 3, 1.0, 65, 0.0, 0, 0, 0, 0, 1), (150, 0.02, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (16, 0.1, 70, 0.1, 45, 0.0, 0, 0, 0, 1, 1),
])


def combinations() -> np.ndarray:
    """Further labelled blocks, by rule: the same kinds at many lengths and beside many neighbours."""
    rows = []
    for words, before, after in product((1, 6, 18, 40, 90, 160), (0, 9, 30, 80), (0, 9, 30, 80)):
        point = words > 10
        for in_main, marks in ((0, 0), (0, 1), (1, 1)):
            # surrounding parts, whatever their length and their links
            rows += [(words, links, before, 0.0, after, 0.0, in_main, 1, marks, point, 0) for links in (0.0, 0.3, 1.0)]
        # beside a marked article, and in it: text, lists of links
        rows.append((words, 0.0, before, 0.0, after, 0.0, 0, 0, 1, point, 0))
        rows.append((words, 0.1, before, 0.0, after, 0.0, 1, 0, 1, point, 1))
        if before and after:
            rows.append((words, 1.0, before, 1.0, after, 1.0, 1, 0, 1, 0, 0))
            rows.append((words, 1.0, before, 1.0, after, 1.0, 0, 0, 0, 0, 0))
        if words > 30:
            rows += [(words, 1.0, before, 0.0, after, 0.0, x, 0, x, point, 0) for x in (0, 1)]
        else:
            # the first and the last of such a list; a single link is text of an article only
            rows += [(words, 1.0, before, x, after, 1.0 - x, 1, 0, 1, 0, 0) for x in (0.0, 1.0) if before and after]
            rows.append((words, 1.0, before, 0.0, after, 0.0, 0, 0, 0, 0, 0))
            if 2 < words < 10 and after:
                rows.append((words, 1.0, before, 0.0, after, 0.0, 1, 0, 1, 0, 1))
        # sentences where no article is marked
        if point:
            rows += [(words, x, before, y, after, 0.0, 0, 0, 0, 1, 1) for x in (0.0, 0.15) for y in (0.0, 1.0)]
    return np.array(rows, dtype=float)


@dataclass
class Node:
    """A leaf has no feature; ``value`` is its share of main text."""

    value: float
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def grow(rows: np.ndarray, depth: int = 8, least: int = 2) -> Node:
    """A classification tree by Gini impurity; rows hold features and, last, the label."""
    y = rows[:, -1]
    node = Node(float(y.mean()))
    if depth == 0 or node.value in (0.0, 1.0):
        return node
    best = (node.value * (1 - node.value) * len(y) - 1e-9, -1, 0.0)
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            side = rows[:, f] < cut
            if min(side.sum(), (~side).sum()) >= least:
                loss = sum(y[s].mean() * (1 - y[s].mean()) * s.sum() for s in (side, ~side))
                best = min(best, (loss, f, cut))
    if best[1] >= 0:
        _, node.feature, node.cut = best
        side = rows[:, node.feature] < node.cut
        node.low, node.high = grow(rows[side], depth - 1, least), grow(rows[~side], depth - 1, least)
    return node


def decide(node: Node, row: tuple) -> float:
    while node.feature >= 0:
        node = node.low if row[node.feature] < node.cut else node.high
    return node.value


@lru_cache(maxsize=1)
def default_tree() -> Node:
    return grow(np.vstack([LABELLED, combinations()]))


@dataclass
class Block:
    text: str
    words: int
    links: float
    in_main: bool
    in_weak: bool
    around: bool


def _names(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    return {w for m in NAMED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}


@lru_cache(maxsize=4096)
def _parts(name: str) -> frozenset[str]:
    return frozenset(w for w in SPLIT.split(name) if w)


@lru_cache(maxsize=4096)
def _names_around(name: str) -> bool:
    """The name as a whole says surrounding: all its parts are such words or stand beside them."""
    parts = _parts(name)
    return bool(parts & AROUND_WORDS) and all(w in AROUND_WORDS or w in BESIDE_WORDS or w.isdigit() for w in parts)


@lru_cache(maxsize=4096)
def _names_weakly(name: str) -> bool:
    """The name as a whole says main part, as ``main``, ``content`` and ``main-content`` do."""
    parts = _parts(name)
    return bool(parts & WEAK_WORDS) and all(w in WEAK_WORDS or w in BESIDE_WORDS or w == "page" or w.isdigit() for w in parts)


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page, in order."""
    found: list[Block] = []
    stack: list[list] = []  # open elements: name, main, around, around unless an article is inside, weakly main
    text: list[str] = []
    linked = 0
    links = hidden = main = weak = around = 0
    article = False

    def close() -> None:
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                words = joined.count(" ") + 1
                found.append(Block(joined, words, min(1.0, linked / words), main > 0, weak > 0, around > 0))
            text.clear()
        linked = 0

    def chunk(a: int, b: int) -> None:
        nonlocal linked
        if b > a and not hidden:
            text.append(html[a:b])
            if links:
                linked += len(html[a:b].split())

    def end(depth: int) -> None:
        """End the open elements from ``depth`` on."""
        nonlocal links, hidden, main, weak, around
        while len(stack) > depth:
            gone, was_main, was_around, _, was_weak = stack.pop()
            main, weak, around = main - was_main, weak - was_weak, around - was_around
            links, hidden = links - (gone == "a"), hidden - (gone in NO_TEXT)

    at = 0
    for m in TOKEN.finditer(html):
        chunk(at, m.start())
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[2] or m[5]), m[4] or ""
        if name in BLOCK_TAGS:
            close()
        elif name == "br":
            text.append(" ")
        if not closing:
            if stack and stack[-1][0] == "head" and name not in IN_HEAD:
                end(len(stack) - 1)
            if name in ENDS_P:
                # a paragraph ends where the next block begins, with what is open inside it
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] not in BLOCK_TAGS and stack[depth][0] not in NO_TEXT:
                    depth -= 1
                if depth >= 0 and stack[depth][0] == "p":
                    end(depth)
            if name in MAIN_TAGS and hidden:
                without = [i for i, x in enumerate(stack) if x[0] in NO_TEXT]
                if all(stack[i][0] in NO_ARTICLE for i in without):
                    end(without[0])
        # a slash ends drawings and formulas only, and not as the end of an unquoted value
        if name in VOID_TAGS or CLOSED.search(attributes) and (name in FOREIGN or hidden and any(x[0] in FOREIGN for x in stack)):
            continue
        if not closing:
            names = _names(attributes)
            is_main = name != "p" and (name in MAIN_TAGS or any(_parts(x) & MAIN_WORDS for x in names))
            named = name not in ("html", "body") and any(map(_names_around, names))
            is_around = named or name in AROUND_TAGS and not (name == "header" and main)
            if name in MAIN_TAGS and not is_around and not article:
                # what holds the article is not beside it, whatever its name
                for x in stack:
                    if x[3]:
                        x[2], x[3], around = False, False, around - 1
                article = around == 0
            is_weak = not is_around and name not in ("html", "body", "p") and any(map(_names_weakly, names))
            stack.append([name, is_main, is_around, is_around and (name == "form" or name not in AROUND_TAGS), is_weak])
            main, weak, around = main + is_main, weak + is_weak, around + is_around
            links, hidden = links + (name == "a"), hidden + (name in NO_TEXT)
        elif any(x[0] == name for x in stack):
            end(max(i for i, x in enumerate(stack) if x[0] == name))
    rest = html[at:]
    cut = re.search(r"<(?:[a-zA-Z/!?]|\Z)", rest)
    chunk(at, at + cut.start() if cut else len(html))
    close()
    return found


def main_text(html: str | None, tree: Node | None = None) -> str:
    """The main text of a page: its blocks joined by line feeds."""
    if not html:
        return ""
    tree = tree or default_tree()
    blocks = blocks_of(html)
    marked = any(b.in_main for b in blocks)
    has_main = marked or any(b.in_weak for b in blocks)
    kept = []
    for i, b in enumerate(blocks):
        before = blocks[i - 1] if i else None
        after = blocks[i + 1] if i + 1 < len(blocks) else None
        row = (
            b.words, b.links, before.words if before else 0, before.links if before else 0.0,
            after.words if after else 0, after.links if after else 0.0, b.in_main if marked else b.in_weak, b.around, has_main, b.text[-1] in ".!?")
        if decide(tree, row) >= 0.5:
            kept.append(b.text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` for each page."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = default_tree()
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    schema = f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long"
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
