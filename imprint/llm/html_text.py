"""Main text of web pages from flat text blocks (operator 3).

A page is cut into flat blocks: the text between block-level tags, white space as one space.  A
block has its words and link density, those of its neighbours, whether it is a heading, and the
zone its tags put it in.  A class, id or role name marks a zone only by all of its words, an
article or main undoes the mark of a mere wrapper around it (a main even that of a related list),
and a page has an article only if its blocks hold half of the unlinked words outside menus and the
like.  A form is one by its controls: one that holds more text than FORM_WORDS for each control is
a wrapper, whose blocks are judged like any other.  A head ends at the first element or text that
can't stand in it.  Open elements are found by positions kept for each tag, so time grows with the
length of a page, however deep it nests.  A decision tree, trained here on the small labelled table of
``html_labels``, decides which blocks are main text; these are joined in page order by newlines.

What a zone vetoes: menus, footers, asides, hidden parts, comments, related lists and real forms
are never main text, nor what a name marks as such unless an article or main stands in it.

Defined results: a null or empty page has an empty text; character references are decoded;
scripts, styles, the head and form controls never give text; broken and cut-off markup is read as
far as it goes; a very long page is read whole; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint._ship import ship_with_tasks
from imprint.llm.html_labels import ROWS

ship_with_tasks(__name__)

#: Elements without text of the page.
SILENT = frozenset(
    "head title script style noscript template svg math iframe object select option textarea button canvas audio "
    "video".split()
)
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand in a head.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that a slash at the end of their tag closes.
FOREIGN = frozenset("svg math".split())
#: Elements a visitor fills in or presses.
CONTROLS = frozenset("input select textarea button".split())
FORM_WORDS, FORM_LEAST = 20, 60  # most words of a form for each control, and in any form
#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements and class or id words that mark what is not main text.
OUTSIDE = frozenset("nav footer aside menu dialog".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert alerts announcement banner breadcrumb breadcrumbs comment "
    "comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer form gdpr header "
    "legal login masthead menu modal nav navbar navigation newsletter notice notices paywall popup privacy promo "
    "promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar topbar widget widgets".split()
)
#: Elements, roles and class or id words that mark main text.
INSIDE = frozenset("article main".split())
INSIDE_WORDS = frozenset("article articlebody content entry main post postbody story".split())
#: Words that a class or id name may have besides, without losing its mark.
FILLER_WORDS = frozenset("area bar block body bottom box buttons items left links list page posts right section site text top".split())
#: Class or id words that stay outside even around an article: lists of comments and of other pages.
FIRM_WORDS = frozenset("comment comments disqus promo promotion related replies reply sponsor sponsored".split())
FIRM = -2  # zone of what no article inside it can undo, but a main
HARD = -3  # zone of what nothing inside it can undo
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of these kinds.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_LISTS = frozenset("ul ol dl table body html article main section div nav aside footer header form".split())
_CUT_OFF = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")  # a tag that the page ends in
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _mark(name: str) -> tuple[int, set[str]]:
    """1, -1 or 0 for a class, id or role name, by all of its words, and its outside words."""
    words = [name.lower()] if name.lower() in OUTSIDE_WORDS | INSIDE_WORDS else list(map(str.lower, _WORDS.findall(name)))
    bad = OUTSIDE_WORDS.intersection(words)
    if not words or not set(words) <= OUTSIDE_WORDS | INSIDE_WORDS | FILLER_WORDS:
        return 0, set()
    if bad:
        last = next(w for w in reversed(words) if w not in FILLER_WORDS)
        return (-1, set(bad)) if last in OUTSIDE_WORDS else (0, set())
    return int(bool(INSIDE_WORDS.intersection(words))), set()


class Block:
    """Text of one flat block with its link words, zone, heading mark and the form around it."""

    __slots__ = ("text", "words", "link", "zone", "heading", "form")

    def __init__(self, text: str, linked: str, zone: int, heading: bool, form: int | None) -> None:
        self.text, self.zone, self.heading, self.form = text, zone, heading, form
        self.words = text.count(" ") + 1
        self.link = min(1.0, len(linked.split()) / self.words)


class _Reader(HTMLParser):
    """Collects the flat blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int]] = []  # element, zone inside it
        self.at: dict[str, list[int]] = {}  # element: where it is open, outermost first
        self.blocked: list[int] = []  # where elements that end a block are open
        self.lists: list[int] = []  # where elements of _LISTS are open
        self.silent = self.headings = self.good = 0  # open elements of these kinds
        self.controls: list[int] = []  # of each form met
        self.forms: list[tuple[int, int]] = []  # open forms: number, depth of article and main around
        self.parts: list[str] = []
        self.linked: list[str] = []

    def _zone(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _inside(self) -> int:
        return sum(len(self.at.get(tag, ())) for tag in INSIDE)

    def _undone(self, tag: str) -> bool:
        """Whether only a wrapper's name is against text here, outside of any article."""
        return not self.good and (self._zone() == -1 or (tag == "main" and self._zone() == FIRM))

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            form = None
            if self.forms and self.forms[-1][1] == self._inside():  # no article or main between
                form = self.forms[-1][0]
            self.blocks.append(Block(text, "".join(self.linked), max(-1, self._zone()), self.headings > 0, form))
        self.parts, self.linked = [], []

    def _push(self, tag: str, zone: int) -> None:
        at = len(self.open)
        self.at.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocked.append(at)
        if tag in _LISTS:
            self.lists.append(at)
        if tag == "form":
            self.forms.append((len(self.controls), self._inside()))
            self.controls.append(0)
        self.open.append((tag, zone))
        self.silent += tag in SILENT
        self.headings += tag in HEADINGS
        self.good += zone > 0

    def _pop(self, at: int) -> None:
        while len(self.open) > at:
            tag, zone = self.open.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocked.pop()
            if tag in _LISTS:
                self.lists.pop()
            if tag == "form":
                self.forms.pop()
            self.silent -= tag in SILENT
            self.headings -= tag in HEADINGS
            self.good -= zone > 0

    def _end_head(self) -> None:
        """Close a head, and what is open in it, at what can't stand in a head."""
        for tag in ("head", "title"):
            if self.at.get(tag) and not any(self.at.get(t) for t in ("noscript", "template", *FOREIGN)):
                self._pop(self.at[tag][0])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent and tag not in HEAD:
            self._end_head()
        if tag not in INLINE:
            self._flush()
            self._close_for(tag)
        elif tag == "br":
            self.parts.append(" ")
        if self.forms and tag in CONTROLS and (dict(attrs).get("type") or "").lower() != "hidden":
            self.controls[self.forms[-1][0]] += 1
        if tag in VOID:
            return
        self._push(tag, self._zone_of(tag, dict(attrs)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        foreign = tag in FOREIGN or any(self.at.get(t) for t in FOREIGN)
        self.handle_starttag(tag, attrs)
        if foreign and tag not in VOID:
            self._pop(self.at[tag][-1])

    def _close_for(self, tag: str) -> None:
        if tag == "body" and self.silent:  # a silent element that was never closed
            self._pop(min(self.at[t][0] for t in SILENT if self.at.get(t)))
        ends = ("p", *HEADINGS) if tag not in CLOSES else CLOSES[tag]
        last = max((self.at[t][-1] for t in ends if self.at.get(t)), default=-1)
        if last > (self.lists[-1] if self.lists else -1):
            self._pop(last)

    def _zone_of(self, tag: str, attrs: dict[str, str | None]) -> int:
        zone = self._zone()
        if zone < 0 and not (tag in INSIDE and self._undone(tag)):
            return zone
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style:
            return HARD
        if tag in OUTSIDE or (tag == "header" and zone < 1):
            return HARD
        if tag not in ("body", "html"):
            named = f"{attrs.get('class') or ''} {attrs.get('id') or ''} {attrs.get('role') or ''}"
            marks = [_mark(name) for name in named.split()]
            bad = set().union(*(words for mark, words in marks if mark < 0))
            good = any(mark > 0 for mark, _ in marks)
            if zone > 0 or good:  # an article's own header
                bad -= {"header"}
            if bad and tag not in ("h1", "header"):
                return FIRM if bad & FIRM_WORDS else -1
            if good and not bad:
                return 1
        return 1 if tag in INSIDE else zone

    def handle_endtag(self, tag: str) -> None:
        inline = tag in INLINE
        if not inline:
            self._flush()
        where = self.at.get(tag)
        if where and not (inline and self.blocked and self.blocked[-1] > where[-1]):
            self._pop(where[-1])

    def handle_data(self, data: str) -> None:
        if self.silent and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        if self.silent:
            return
        self.parts.append(data)
        if self.at.get("a"):
            self.linked.append(data + " ")

    def finish(self) -> list[Block]:
        """All blocks; those of a form that is no wrapper are outside."""
        self._flush()
        words = [0.0] * len(self.controls)
        for b in self.blocks:
            if b.form is not None:
                words[b.form] += b.words * (1 - b.link)
        for b in self.blocks:
            if b.form is not None and words[b.form] <= max(FORM_LEAST, FORM_WORDS * self.controls[b.form]):
                b.zone = -1
        return self.blocks


def text_blocks(html: str | None) -> list[Block]:
    """The flat blocks of a page in order."""
    reader = _Reader()
    reader.feed(_CUT_OFF.sub("", html or ""))
    reader.close()
    return reader.finish()


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """A row of the labelled table's columns, but the label, for each block."""
    plain = [(b.zone, b.words * (1 - b.link)) for b in blocks if b.zone >= 0]
    inside = sum(n for zone, n in plain if zone == 1)
    main = float(any(zone == 1 for zone, _ in plain) and 2 * inside >= sum(n for _, n in plain))
    sizes = [(0, 0.0), *((b.words, b.link) for b in blocks), (0, 0.0)]
    return [
        (b.zone, main, b.words, b.link, *sizes[i], *sizes[i + 2], float(b.heading)) for i, b in enumerate(blocks)
    ]


# ---------------------------------------------------------------- decision tree

Tree = tuple[int, float, "Tree", "Tree"] | bool  # column, threshold, tree up to it, tree above it


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p) * len(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, leaf: int = 3) -> Tree:
    """A binary tree by falling Gini impurity, at least ``leaf`` rows on either side; the first
    best split in column order wins."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() >= len(y))
    best = (_gini(y) - 1e-9, None)
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, column] <= cut
            if min(low.sum(), (~low).sum()) < leaf:
                continue
            impurity = _gini(y[low]) + _gini(y[~low])
            if impurity < best[0] - 1e-9:
                best = (impurity, (column, float(cut), low))
    if best[1] is None:
        return bool(2 * y.sum() >= len(y))
    column, cut, low = best[1]
    return column, cut, grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf)


def train(rows: str = ROWS) -> Tree:
    """The tree of a labelled table in text form, header line first."""
    table = np.array([[float(v) for v in line.split()] for line in rows.strip().splitlines()[1:]])
    return grow(table[:, :-1], table[:, -1] == 1)


def decide(tree: Tree, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        column, cut, low, high = tree
        tree = low if row[column] <= cut else high
    return tree


def main_text(html: str | None, tree: Tree) -> str:
    """The blocks that the tree takes for main text, joined by newlines."""
    blocks = text_blocks(html)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks)) if decide(tree, row))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of every row's whole page."""
    src = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("h")
    )
    id_type = src.schema["id"].dataType.simpleString()
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes],
                names=["id", "url", "text", "n_chars"],
            )

    out = src.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
