"""Main text of HTML pages by text-to-tag ratios of lines.

The events of the standard library's parser, fed piece by piece, make lines: the text
between two block boundaries, white space as one space. As in Weninger et al., "CETR:
Content Extraction via Tag Ratios" (WWW 2010), each line has the ratio of its
characters to the tags in it; the ratios are smoothed with a Gaussian over neighbouring
lines, and two clusters of the smoothed ratios part content lines from others.

A ratio can't tell a short paragraph from an advert of the same length, so the
parser also notes where a line stands. Lines in elements that never hold the main
text (navigation, footers, forms, scripts and so on, or what calls itself so by class,
id or role) have a ratio of 0 and fall out. The content lines then choose the region:
the article elements that hold them, the main element, or else the smallest element
that holds most of their text. In an article or main element every other line stays,
however short; elsewhere a line stays if a content line stands in the same element, or
before it and behind it, and few of its letters are links.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import with_fields

#: Characters fed to the parser at once; rows of one output batch; the Gaussian's width in lines and how far it reaches.
PIECE, BATCH_ROWS, WIDTH, REACH = 1 << 16, 64, 1.0, 3
#: Another article counts as content from this share of the largest one's text on, below this share of link text.
SHARE, LINKED = 0.2, 0.6

_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
#: Elements whose text is never the main text, wherever they stand.
_OUT = frozenset("script style noscript template title head nav footer aside button select option textarea input label fieldset iframe object canvas svg math audio video dialog menu datalist applet".split())
#: Elements that group lines, and those that may hold a paragraph of their own within one.
_GROUPS = frozenset("article main section div body td blockquote center figure".split())
_HOLDS_P = _GROUPS | {"table", "li", "button"}
#: Elements that close an open one of their kind, or of these kinds, up to the nearest of the second.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "a": ({"a"}, {"td", "th", "div", "section", "article"}),
}
#: Words of a class or id by which an element says that it isn't main text; of the first kind, an article in it isn't either.
_APART = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion related recommended recommendations trending popular"
    " comment comments commentlist disqus reply replies respond discussion sidebar footer nav menu cookie cookies consent".split()
)
_SAYS = frozenset(
    "banner navbar navigation menubar breadcrumb breadcrumbs toc pager pagination toolbar skip contentinfo copyright colophon aside complementary rail"
    " gdpr notice notices alert notification popup modal overlay dialog paywall reactions form search searchbox login signin signup register"
    " subscribe subscription newsletter share sharing social recirc tagcloud hidden".split()
)
_FIRST = _APART | _SAYS
#: These only outside of an article or main element, where they may hold its title.
_HEADS = frozenset("header masthead topbar head".split())
#: Before such a word they describe the page (has-sidebar), after such a one an element of the text; at the end the former, too.
_ABOUT = frozenset("has have with without no not is show hide".split())
_STATES = frozenset("open opened closed enabled disabled".split())
_TEXT_WORDS = frozenset("content text article body story post entry main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG = re.compile("<[A-Za-z/!?]")


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    out: bool
    heading: bool
    place: int  # the element it stands in, of those that group lines
    article: int  # the innermost article, and main element, or -1
    main: int


class _Open(NamedTuple):
    name: str
    out: int  # 1: by what it calls itself, which an article or main element within undoes; 2: for good
    dropped: bool  # an element within a line whose text isn't the line's
    place: int
    article: int
    main: int


def _out_by_name(attrs: list[tuple[str, str | None]], tag: str, inside: bool) -> int:
    """Whether an element says that it isn't main text: 0, 1 or 2 as in _Open."""
    for name, value in attrs:
        value = (value or "").strip()
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                if not words or words[-1] in _STATES or (words[-1] in _TEXT_WORDS and len(words) > 1 and words[0] not in _FIRST):
                    continue
                if words[0] in ("widget", "widgets") and tag != "article":
                    return 1
                for k, word in enumerate(words):
                    if (k and words[k - 1] in _ABOUT) or (tag == "article" and word not in _APART):
                        continue
                    if word in _APART:
                        return 2
                    if word in _SAYS or (word in _HEADS and not inside and _TEXT_WORDS.isdisjoint(words[:k])):
                        return 1
        elif name == "role" and value.lower() in _ROLES and not (inside and value.lower() == "banner"):
            return 2
        elif name == "hidden" or (name in ("aria-hidden", "aria-modal") and value.lower() == "true"):
            return 2
        elif name == "style" and _UNSEEN.search(value):
            return 2
    return 0


class Lines(HTMLParser):
    """The lines of a page from the parser's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[_Open] = [_Open("", 0, False, 0, -1, -1)]
        self.named: dict[str, int] = {}
        self.places = [-1]  # the parent of each place
        self.pieces: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            here = self.open[-1]
            heading = any(self.named.get(h) for h in ("h1", "h2"))
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), here.out > 0, heading, here.place, here.article, here.main))
        self.pieces, self.linked, self.tags = [], 0, 0

    def _pop(self) -> str:
        name = self.open[-1].name
        if name in _BLOCK:
            self.end_line()
        self.open.pop()
        self.named[name] -= 1
        return name

    def _close(self, names, until=frozenset()) -> None:
        """Closes the nearest open element of these names, unless one of the others is nearer."""
        if any(self.named.get(n) for n in names):
            for one in reversed(self.open):
                if one.name in names:
                    while self._pop() not in names:
                        pass
                    return
                if one.name in until:
                    return

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in ("br", "td", "th"):
            self.pieces.append(" ")
        if tag in _BLOCK:
            self._close({"p"}, _HOLDS_P)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in _BLOCK:
            self.end_line()
        if tag in _VOID:
            return
        here = self.open[-1]
        inside = here.article >= 0 or here.main >= 0
        own = 0 if tag in ("html", "body") else 2 if tag in _OUT else 1 if tag == "form" or (tag == "header" and not inside) else _out_by_name(attrs, tag, inside)
        is_main = tag == "main" or ("role", "main") in attrs
        out = max(own, here.out if here.out == 2 or not (is_main or tag == "article") else 0)
        place, article, main = here.place, here.article, here.main
        if tag in _GROUPS:
            self.places.append(place)
            place = len(self.places) - 1
        if not out:
            article, main = (place if tag == "article" else article), (place if is_main else main)
        dropped = tag not in _BLOCK and (here.dropped or (out > 0 and not here.out))
        if tag in _BLOCK or tag in _GROUPS or tag in ("a", "th") or own:  # others change nothing
            self.open.append(_Open(tag, out, dropped, place, article, main))
            self.named[tag] = self.named.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):  # in HTML the slash means nothing
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.pieces.append(" ")
        if tag in _BLOCK:
            self.end_line()
        self._close({tag}, frozenset() if tag in _BLOCK else _BLOCK)

    def handle_data(self, data: str) -> None:
        if not self.open[-1].dropped:
            self.pieces.append(data)
            if self.named.get("a"):
                self.linked += len(data.strip())


def _finished(html: str) -> str:
    """The html without what would be read again and again for an end that isn't there: comments and tags that nothing closes."""
    last = html.rfind("-->") + 1
    html = html[:last] + html[last:].replace("<!--", "<!---->")
    last = html.rfind(">") + 1
    tail = _TAG.search(html, last)
    return html[: tail.start()] if tail else html


def parsed(html: str) -> Lines:
    parser, html = Lines(), _finished(html)
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    parser.close()
    parser.end_line()
    return parser


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Each ratio with its neighbours', weighted by a Gaussian."""
    kernel = np.exp(-np.arange(-REACH, REACH + 1) ** 2 / (2 * WIDTH**2))
    weights = np.convolve(np.ones(len(ratios)), kernel, "full")[REACH : REACH + len(ratios)]
    return np.convolve(ratios, kernel, "full")[REACH : REACH + len(ratios)] / weights


def threshold(values: np.ndarray) -> float:
    """The middle between the centres of two clusters of values."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100):
        upper = values >= (low + high) / 2
        if upper.all():
            break
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content(lines: list[Line]) -> np.ndarray:
    """Which lines are in the cluster of high text-to-tag ratios."""
    out = np.array([x.out for x in lines])
    ratios = np.array([0.0 if x.out else (len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    values = smoothed(ratios)
    return (values >= threshold(values[~out])) & ~out if not out.all() else np.zeros(len(lines), bool)


def _smallest(parents: list[int], weight: dict[int, int]) -> int:
    """The smallest element that holds nearly all of the weight."""
    within = dict.fromkeys(range(len(parents)), 0)
    for place, n in weight.items():
        while place >= 0:
            within[place] += n
            place = parents[place]
    whole = within[0]
    return max(p for p, n in within.items() if n >= 0.9 * whole)  # elements are numbered downwards


def main_text(html: str) -> str:
    """The blocks of the main text, one a line."""
    parser = parsed(html)
    lines = parser.lines
    if all(x.out for x in lines):
        return ""
    picked = content(lines)
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    for x in lines:
        if x.article >= 0 and not x.out:
            size[x.article] = size.get(x.article, 0) + len(x.text)
            links[x.article] = links.get(x.article, 0) + x.linked
    chosen = [x for x, p in zip(lines, picked, strict=True) if p]
    holding = {x.article for x in chosen if x.article >= 0}
    largest = max(size.values(), default=0)
    articles = {a for a, n in size.items() if n == largest or (a in holding and n >= SHARE * largest and links[a] < LINKED * n)}
    if not holding and sum(len(x.text) for x in chosen) > 2 * largest:
        articles = set()  # teasers beside a text that isn't marked up
    mains = {x.main for x in chosen if x.main >= 0}
    if articles:
        keep = [not x.out and _in(parser.places, x.place, articles) for x in lines]
        first = keep.index(True)
        for k in range(first - 1, -1, -1):  # the title may stand before the article
            if not (lines[k].heading and not lines[k].out and lines[k].main == lines[first].main):
                break
            keep[k] = True
    elif mains:
        keep = [not x.out and x.main in mains for x in lines]
    else:
        weight: dict[int, int] = {}
        for x in chosen:
            weight[x.place] = weight.get(x.place, 0) + len(x.text)
        region = _smallest(parser.places, weight)
        at = np.flatnonzero(picked)
        between = lambda k: at[0] < k < at[-1]
        keep = [not x.out and (x.place in weight or between(k)) and _in(parser.places, x.place, {region}) for k, x in enumerate(lines)]
        keep = [k and x.linked < max(1, LINKED * len(x.text)) for k, x in zip(keep, lines, strict=True)]
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def _in(parents: list[int], place: int, wanted: set[int]) -> bool:
    while place >= 0:
        if place in wanted:
            return True
        place = parents[place]
    return False


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each page and n_chars, its code points, and drops the html; the other columns stay.

    A block's white space is one space, blocks are joined by a newline, character
    references are decoded. A null or empty html, and one without main text, gives an
    empty text. Pages are read whole, whatever their length. Repeated rows stay; input
    columns named like the added ones are replaced. An empty table gives an empty result.
    """
    added = {text: "string", "n_chars": "long"}
    kept = [c for c in pages.columns if c not in (html, *added)]
    slim = pages.select(html, *kept)
    schema = with_fields(slim.drop(html), added)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = [main_text(h.as_py() or "") for h in part.column(html)]
                new = [pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names=schema.names)

    return slim.mapInArrow(run, schema)
