"""Main text of web pages from streamed parser events.

The standard library's parser emits events; text between block boundaries is a line.  A
line's ratio is its unlinked characters by the tags met while it was read.  Scripts, forms
and hidden elements are no text at all; navigation, footers and what a class names as
clutter only weigh less: their ratios count a five-hundredth, half where the class has other words
too.  Ratios are smoothed with a Gaussian, and lines above the threshold (the standard
deviation of the smoothed ratios) are the seeds of content.  A block of lower weight is
clutter unless seeds are half of it.

The content region is the element that gains most, a seed's characters counting for it and
other characters against it; of equal gains an article goes first.  An article's lines all
belong to the text.  Elsewhere density goes on deciding: between the first and the last
seed, lines belong unless their block is mostly links; outside, only those that stand in
one container with seeds.

All work is linear in the page: elements know their parent, and what holds for an element
is summed up or handed down once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import few_rows, ship, utf8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("p li a b strong em i span u small q cite code sub sup font mark".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never content, whatever they hold.
DROPPED = frozenset("script style noscript template iframe object svg canvas audio video title head form button select textarea dialog menu datalist".split())
#: Seldom content: what they hold weighs less.
ASIDE = frozenset("nav footer aside header".split())
ENDS_P = BLOCK - {"br", "body", "html", "option", "optgroup", "caption"}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of classes and ids that name clutter, and such as go with them.
_HINT = re.compile(
    r"ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|sidebars?|rail|"
    r"comments?|commentlist|respond|replies|disqus|menus?|navbar|navigation|nav|breadcrumbs?|footers?|masthead|topbar|siteheader|pageheader|"
    r"share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|widgets?|toolbar|pagination|pager|tags?list|skiplink"
)
_WITH_HINT = frozenset(
    "a abc area article bar big block blog body bottom box btn button buttons card col column container content cta entry feed fixed float form global group head header heading hero icons"
    " id inline inner item items js label large layer left line link links list local main media middle mobile module news note outer page panel post primary reader right row secondary section"
    " side site slot small sticky story strip tab text thread title top unit user view web wrap wrapper zone".split()
)
#: What ratios in clutter count: by its tag, role or a class that names nothing else; by a class with other words.
CLUTTER, HINTED = 0.002, 0.5
#: Containers that a hint does not drop: they hold the page or the article itself.
SHELL = frozenset("html body main article".split())
SIGMA = 1.0
#: Elements whose start closes an open p, li or such, and where the search for those ends.
ENDS = {"li": "li", "option": "option", "tr": "tr", "td": "td", "th": "th", "dt": "dt", "dd": "dd"}
P_BOUNDS = ("td", "th", "div", "article", "section", "li", "blockquote")
ITEM_BOUNDS = ("ul", "ol", "table", "select", "dl")
#: Share of linked characters from which a block is a menu.
LINKED = 0.5


@dataclass
class Element:
    tag: str
    parent: int
    hard: bool  # never content, by its tag or style
    weight: float  # what ratios in it count, by tag or role
    hint: float  # the same by the words of its class or id
    anew: bool  # an article: what surrounds it does not make it clutter


@dataclass
class Line:
    text: str
    tags: int
    at: int
    linked: int
    heading: bool


def hint_weight(names: str) -> float:
    """The least that the classes of an element make its ratios count: ``ad-slot`` names clutter, ``notice-board-history`` perhaps."""
    least = 1.0
    for name in names.lower().split():
        parts = [p for p in re.split("[^a-z]+", name) if p]
        whole = bool(_HINT.fullmatch("".join(parts)))
        if whole or any(_HINT.fullmatch(p) for p in parts):
            least = min(least, CLUTTER if whole or all(_HINT.fullmatch(p) or p in _WITH_HINT for p in parts) else HINTED)
    return least


class Lines(HTMLParser):
    """Collects the lines of a page with their tags and enclosing elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", -1, False, 1.0, 1.0, False)]
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # by tag, where it is on the stack
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.met_article = False

    def _last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.open[-1], self.linked, self._last(*HEADINGS) > 0))
        if text or self.parts:
            self.tags = self.linked = 0
        self.parts = []

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.elements[self.open.pop()].tag].pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._close_within("p", P_BOUNDS)
        if tag in ENDS:
            self._close_within(ENDS[tag], ITEM_BOUNDS)
        if tag == "body":
            self._close_within("head", ())
        # An unclosed menu or advert before it must not swallow the article.
        anew = tag == "main" or (tag == "article" and not self.met_article and not self._last("aside", "form"))
        self.met_article |= tag == "article"
        # An article's own header keeps its headings, see main_text.
        own_header = tag == "header" and self._last("article", "main") > 0
        free = anew or own_header
        hard = not anew and (tag in DROPPED or self._hidden(attrs))
        aside = not free and (tag in ASIDE or any(k == "role" and (v or "").lower() in ROLES for k, v in attrs))
        named = () if free or tag in SHELL else [hint_weight(v) for k, v in attrs if k in ("class", "id", "data-role", "data-component") and v]
        self.elements.append(Element(tag, self.open[-1], hard, CLUTTER if aside else 1.0, min(named, default=1.0), anew))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.elements) - 1)

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        for k, v in attrs:
            v = (v or "").lower()
            if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if self.places.get(tag):
            self._pop_to(self.places[tag][-1])

    def _close_within(self, tag: str, bounds: tuple[str, ...]) -> None:
        at = self._last(tag)
        if at > self._last(*bounds):
            self.flush()
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.elements[self.open[-1]].tag in ("script", "style", "title"):
            return
        self.parts.append(data)
        if self.places.get("a"):
            self.linked += len(data.strip())


def page_lines(html: str) -> Lines:
    p = Lines()
    try:
        p.feed(html)
        p.close()
    except AssertionError:  # a declaration that the parser can't read
        p = Lines()
        p.feed(re.sub(r"<!\[", "<! [", html))
        p.close()
    p.flush()
    return p


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _summed(own: list[int], elements: list[Element]) -> list[int]:
    """What elements and all in them hold; children come after their parents."""
    total = list(own)
    for e in range(len(elements) - 1, 0, -1):
        total[elements[e].parent] += total[e]
    return total


def _held(lines: list[Line], value: list[int], elements: list[Element]) -> list[int]:
    own = [0] * len(elements)
    for x, v in zip(lines, value, strict=True):
        own[x.at] += v
    return _summed(own, elements)


def _weights(lines: list[Line], elements: list[Element]) -> tuple[list[float], list[int]]:
    """By element: what ratios in it count (0 for what is no text), and the outermost element that makes them count less (0: none).

    A hint on what holds most of the page and its title or article is none.
    """
    held = _held(lines, [len(x.text) for x in lines], elements)
    titles = _summed([int(e.tag in ("h1", "article", "main")) for e in elements], elements)
    weight, outer = [1.0] * len(elements), [0] * len(elements)
    for n, e in enumerate(elements[1:], 1):
        if e.anew:
            continue
        own = min(e.weight, 1.0 if titles[n] and 2 * held[n] >= held[0] else e.hint)
        weight[n] = 0.0 if e.hard else min(own, weight[e.parent])
        outer[n] = outer[e.parent] or (n if own < 1 else 0)
    return weight, outer


def _inside(root: int, elements: list[Element]) -> list[bool]:
    out = [False] * len(elements)
    for n, e in enumerate(elements):
        out[n] = n == root or (n > 0 and out[e.parent])
    return out


def seeds_of(lines: list[Line], weight: list[float]) -> list[bool]:
    """Lines in the clusters of high smoothed text-to-tag ratio that are dense of their own, not by their neighbours alone."""
    ratios = np.array([(len(x.text) - x.linked) / max(1, x.tags) * w for x, w in zip(lines, weight, strict=True)])
    smooth = smoothed(ratios)
    bar = float(smooth.std())
    found = [bool(w and s >= bar and r >= bar) for s, r, w in zip(smooth, ratios, weight, strict=True)]
    if any(found):
        return found
    best = max(float(s) for s, w in zip(smooth, weight, strict=True) if w == 1)
    return [bool(w == 1 and s >= best) for s, w in zip(smooth, weight, strict=True)]


def main_text(html: str) -> str:
    """The page's content lines in order, joined by one space; empty if there is none but clutter."""
    page = page_lines(html)
    lines, elements = page.lines, page.elements
    by_element, outer = _weights(lines, elements)
    weight = [by_element[x.at] for x in lines]
    if 1.0 not in weight:
        return ""
    seeds = seeds_of(lines, weight)
    size = [len(x.text) for x in lines]
    # Blocks of lower weight, by the outermost element that lowers it: content where seeds are half of them.
    dense, whole = [0] * len(elements), [0] * len(elements)
    for x, s, n in zip(lines, seeds, size, strict=True):
        dense[outer[x.at]] += n * s
        whole[outer[x.at]] += n
    free = [w > 0 and (not outer[x.at] or 2 * dense[outer[x.at]] >= whole[outer[x.at]]) for x, w in zip(lines, weight, strict=True)]
    seeds = [s and ok for s, ok in zip(seeds, free, strict=True)]
    held = _held(lines, [n * s for n, s in zip(size, seeds, strict=True)], elements)
    gain = _held(lines, [(n if s else -n) * ok for n, s, ok in zip(size, seeds, free, strict=True)], elements)
    places = [n for n, e in enumerate(elements) if e.tag not in HEADINGS | INLINE and held[n]]
    # Of equal gains an article goes first, then the smallest element; what lies in an article stands for it.
    root = max(places, key=lambda n: (gain[n], elements[n].tag in ("article", "main"), n))
    article = root
    while article and elements[article].tag not in ("article", "main"):
        article = elements[article].parent
    if article:
        region = _inside(article, elements)
        kept = [ok and region[x.at] and (x.heading or not header) for x, ok, header in zip(lines, free, _in_header(lines, elements), strict=True)]
    else:
        kept = _dense(lines, elements, free, seeds, held, root)
    return " ".join(x.text for x, k in zip(lines, kept, strict=True) if k)


def _in_header(lines: list[Line], elements: list[Element]) -> list[bool]:
    inside = [False] * len(elements)
    for n, e in enumerate(elements[1:], 1):
        inside[n] = e.tag == "header" or inside[e.parent]
    return [inside[x.at] for x in lines]


def _dense(lines: list[Line], elements: list[Element], free: list[bool], seeds: list[bool], weight: list[int], root: int) -> list[bool]:
    """Without an article: what stands with the clusters in the region and is no menu."""
    region = _inside(root, elements)
    whole = elements[root].tag in ("", "html", "body")
    size = _held(lines, [len(x.text) for x in lines], elements)
    linked = _held(lines, [x.linked for x in lines], elements)
    # The outermost block around an element that holds no seed, if there is one.
    block = [0] * len(elements)
    for n, e in enumerate(elements[1:], 1):
        block[n] = 0 if weight[n] else block[e.parent] or n
    places = [i for i, s in enumerate(seeds) if s]
    first, last = places[0], places[-1]
    title = max((i for i in range(first) if free[i] and lines[i].heading), default=None)
    out = []
    for i, x in enumerate(lines):
        b = block[x.at]
        menu = (linked[b] >= LINKED * size[b]) if b else 2 * x.linked > len(x.text)
        # Bare text of the page beyond the seeds stands with them in nothing.
        near = region[x.at] and (first < i < last or not whole or (b and elements[b].tag in ("p", "ul", "ol", "pre", "blockquote", *HEADINGS)))
        out.append(free[i] and (seeds[i] or (near and not menu) or (i == title and elements[b].tag in HEADINGS)))
    return out


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null html has the empty text; repeated rows each get a row, null ids and urls stay null;
    very long and deeply nested pages take time in proportion to their length; an empty table
    gives an empty result; other columns are ignored.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            texts = [main_text(h.decode("utf-8", "replace")) for h in b.column("_h").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), utf8(pages["html"]).alias("_h"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
