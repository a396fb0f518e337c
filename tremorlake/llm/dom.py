"""A page's block elements with their text and the inputs of the content model."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np

_TEXT_TAGS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption")
_BOXES = ("html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "fieldset", "ul", "ol", "dl",
          "table", "thead", "tbody", "tfoot", "tr", "figure", "details", "summary", "address", "dialog", "menu", "center", "head", "hgroup", "search")
BLOCKS = frozenset(_TEXT_TAGS + _BOXES)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no part of a page's prose.
_SILENT = frozenset("script style noscript template title textarea select option button svg iframe canvas head datalist".split())
#: A start tag of the second kind ends an open element of the first.
_ENDS = {"p": BLOCKS - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
         "tr": {"tr"}, "head": {"body", *BLOCKS} - {"head"}}
#: An end tag or a closing rule doesn't reach beyond these.
_SCOPE = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
_WALLS = ("table", "article", "body", "div", "section", "aside", "nav")
#: By start tag: the open elements it ends, and those it doesn't see beyond.
_ENDED = {tag: [name for name, by in _ENDS.items() if tag in by] for tag in BLOCKS}
_BORDERS = {tag: [*_WALLS, *_SCOPE.get(tag, ())] for tag in BLOCKS}

#: Words of class, id and role that tell what a box is for.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager tabs tablist menubar topbar",
    "side": "side sidebar aside related widget widgets rail recommended recommendations trending popular complementary teaser more",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adsense",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay subscribe newsletter signup paywall message hint warning dialog hidden toast privacy",
    "foot": "foot footer copyright legal bottom colophon contentinfo imprint",
    "head": "header masthead top logo brand head site",
    "comment": "comment comments commenting disqus reply replies respond response responses discussion reader readers feedback thread",
    "form": "form search login input register signin contact",
    "share": "share sharing social follow tags meta byline author",
    "good": "article content post entry story text main body blog news page copy prose paragraph articlebody",
}
_HINT = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
_TAGS = [("p",), ("li",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("td", "th", "tr", "table", "tbody", "thead", "dl", "dt", "dd"), ("blockquote", "pre"),
         ("ul", "ol", "menu"), ("div", "center"), ("section",), ("article",), ("main",), ("nav",), ("header", "hgroup"), ("footer",), ("aside",),
         ("form", "fieldset", "search"), ("figure", "figcaption"), ("head", "dialog", "details", "summary", "address"), ("body", "html")]
_TAG = {tag: i for i, tags in enumerate(_TAGS) for tag in tags}
N_INPUTS = 1 + len(_TAGS) + len(HINTS) + 9
#: Kinds of children, each with potentials of its own.
KINDS = 3
_KIND = {**dict.fromkeys(_TEXT_TAGS, 0), **dict.fromkeys(("nav", "header", "footer", "aside", "form", "dialog", "head", "menu", "search", "fieldset"), 2)}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page(NamedTuple):
    """Block elements in page order. ``parent`` is -1 for the root; ``pieces``: (element, text) in page order."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    inputs: np.ndarray
    pieces: list[tuple[int, str]]
    marks: list[str | None]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.depths, self.hints, self.marks = ["html"], [-1], [0], [set()], [None]
        self.open: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones with the number of their block
        # Where they stand in ``open``, so that no tag has to look through it: by tag, silent ones, and each block's place.
        self.places: dict[str, list[int]] = defaultdict(list, html=[0])
        self.silent: list[int] = []
        self.blocks = [0]
        self.pieces: list[tuple[int, str]] = []
        self.buffer: list[str] = []
        self.counts = [[0, 0, 0, 0]]  # per block: letters of links, controls, images, inline elements

    def flush(self) -> None:
        if self.buffer:
            if text := " ".join("".join(self.buffer).split()):
                self.pieces.append((self.open[-1][1], text))
            self.buffer.clear()

    def _pop(self, to: int) -> None:
        """Close the open elements from place ``to`` on."""
        while len(self.open) > to:
            tag = self.open[-1][0]
            if tag in BLOCKS:
                self.flush()
                self.blocks.pop()
            if tag in _SILENT:
                self.silent.pop()
            self.places[tag].pop()
            self.open.pop()

    def _place(self, tags: Iterable[str]) -> int:
        """The last place of an open element with one of the tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.places[tag]:
            return
        if tag == "br":
            self.buffer.append(" ")
        if tag == "a" and self.places["a"]:  # links don't nest
            self.handle_endtag("a")
        if tag in BLOCKS:
            while (at := self._place(_ENDED[tag])) > self._place(_BORDERS[tag]):
                ended = self.open[at][0]
                self._pop(at)
                if ended != "p":
                    break
            if self.open[-1][0] in _SILENT - {"head"}:  # an unclosed silent element ends where a block begins
                self._pop(self.silent[0])
        block = self.open[-1][1]
        if tag in ("input", "button", "select", "textarea"):
            self.counts[block][1] += 1
        elif tag in ("img", "video", "iframe"):
            self.counts[block][2] += 1
        if tag in _VOID:
            return
        if tag in BLOCKS:
            self.flush()
            self.tags.append(tag)
            self.parents.append(block)
            self.depths.append(self.depths[block] + 1)
            self.counts.append([0, 0, 0, 0])
            given = dict(attrs)
            names = " ".join(given.get(k) or "" for k in ("class", "id", "role", "itemprop"))
            hints = {_HINT[w] for w in (m.lower() for m in _WORD.findall(names)) if w in _HINT}
            if "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", "") or given.get("aria-hidden") == "true":
                hints.add(_HINT["hidden"])
            self.hints.append(hints)
            self.marks.append(given.get("data-label"))
            block = len(self.tags) - 1
        else:
            self.counts[block][3] += 1
        place = len(self.open)
        self.open.append((tag, block))
        self.places[tag].append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
        if tag in _SILENT:
            self.silent.append(place)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in BLOCKS and self.open[-1][0] == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = self._place((tag,))
        # An inline element doesn't end beyond its block. The root stays open.
        border = self._place(_SCOPE.get(tag, ())) if tag in BLOCKS else self.blocks[-1]
        if at > max(border, 0):
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buffer.append(data)
            if self.places["a"]:
                self.counts[self.open[-1][1]][0] += len(data)


def parse(html: str) -> Page:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._pop(0)
    n = len(builder.tags)
    parent, depth = np.array(builder.parents), np.array(builder.depths)
    own, stops, capital = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, text in builder.pieces:
        own[i] += len(text)
        stops[i] += text.count(".") + text.count("?") + text.count("。")
    counts = np.array(builder.counts, float)
    below, links, controls = own.copy(), counts[:, 0].copy(), counts[:, 1].copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        below[p] += below[i]
        links[p] += links[i]
        controls[p] += controls[i]
    total = max(below[0], 1.0)
    inputs = np.zeros((n, N_INPUTS))
    inputs[:, 0] = 1
    inputs[np.arange(n), [1 + _TAG.get(t, len(_TAGS) - 2) for t in builder.tags]] = 1
    for i, hints in enumerate(builder.hints):
        for h in hints:
            inputs[i, 1 + len(_TAGS) + h] = 1
    rest = inputs[:, 1 + len(_TAGS) + len(HINTS):]
    rest[:, 0] = np.log1p(own) / 4
    rest[:, 1] = np.log1p(below) / 6
    rest[:, 2] = np.minimum(1, links / np.maximum(below, 1))
    rest[:, 3] = np.minimum(1, counts[:, 0] / np.maximum(own, 1))
    rest[:, 4] = np.minimum(2, stops)
    rest[:, 5] = np.minimum(2, controls)
    rest[:, 6] = below / total
    rest[:, 7] = below == 0
    rest[:, 8] = np.minimum(3, counts[:, 2])
    kind = np.array([_KIND.get(t, 1) for t in builder.tags])
    return Page(parent, depth, kind, inputs, builder.pieces, builder.marks)
