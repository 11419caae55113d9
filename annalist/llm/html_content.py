"""Main text of web pages from streaming parser events and text-to-tag ratios.

Events of the standard library's HTML parser are cut into lines, one per block of text, each with its number of tags.
The ratio of text to tags is smoothed over neighbouring lines with a Gaussian; lines above a threshold cluster into
content regions. The regions decide: they elect the deepest element that holds most of their text, which is widened to the element
that holds all their blocks without a mark and to the article element, or else the main one, around that. The result is every block of that
place, in page order, so that short lines of the article stay, but for runs of LINK_RUN or more lines whose text is mostly links, where most of the run is outside the regions.

Elements that are never article text go: menus, headers, footers, sidebars, forms, scripts, styles by their tag or role. Class and
id names are marks: one that means readers' comments and nothing else is taken like a menu; any other marked block doesn't widen the place, and one inside it goes if its name says nothing but furniture
(cookie-notice, comment-list, ad) or if the regions agree (a related-links box of short lines, but not a related-work section of prose).
Work is linear in the page's length, whatever its nesting.

Defined results: null or empty html, or a page with no content, gives an empty text; broken or unclosed markup is read as
far as it goes; an empty table gives an empty table; only the named columns are read; ids are read as long, a null id or url is passed through;
rows that repeat give rows of their own.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import mapped, session_defaults

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var br wbr img".split())
FURNITURE_TAGS = frozenset("nav header footer aside form script style noscript template iframe object embed svg canvas button select option textarea dialog menu head title fieldset audio video map".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead header topbar footer sidebar aside widget ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies gdpr consent notice notices popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations comment comments disqus respond replies pagination pager "
    "login search skip copyright toolbar teaser adslot adslots adunit adbox adbanner adwrapper adcontainer adsense commentlist responses".split()
)
#: Words of a reader's comment, and those that may stand beside them in a name that means nothing else.
READER_WORDS = frozenset("comment comments commentlist commentslist commentthread disqus reply replies thread threads".split())
READER_BESIDE = frozenset("user users reader readers visitor guest discussion thread form respond count header title new add latest".split())
NEGATING = frozenset("has with no without".split())
#: Words that say nothing about what an element holds.
NEUTRAL = frozenset("list box block area section wrap wrapper container item items post posts link links bar panel inner outer top bottom left right site page global module message main body content wide narrow large small".split())
HEADING_OF = frozenset("article post entry content story".split())
CLOSED_BY = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre section article aside header footer nav form figure hr main address fieldset details".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Open elements that a tag ends.
ENDS: dict[str, list[str]] = {}
for _name, _enders in CLOSED_BY.items():
    for _tag in _enders:
        ENDS.setdefault(_tag, []).append(_name)
STAYS_OPEN_IN = frozenset("ul ol dl table div section article body".split())
#: Gaussian of the smoothing (lines), share of the standard deviation that is the threshold, share of region text an element must hold.
SIGMA, LEVEL, SHARE = 1.0, 0.5, 0.7
#: Neighbouring lines of links that make a menu; share of a line's text in links from which it counts as one.
LINK_RUN, LINK_SHARE = 4, 0.8
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


HARD, STRONG, WEAK = 3, 2, 1
_PAGE = ("", -1, 0, -1)


def furniture(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """HARD: never article text. STRONG and WEAK: marked by a name of furniture words alone, or of others too. 0: none."""
    if tag in ("html", "body", "main"):
        return 0
    if tag in FURNITURE_TAGS and not (tag == "header" and in_article):
        return HARD
    mark = 0
    for k, v in attrs:
        if not v:
            if k == "hidden":
                return HARD
            continue
        if k == "role" and v.lower() in FURNITURE_ROLES or k == "aria-hidden" and v.lower() == "true" and tag not in INLINE:
            return HARD
        if k in ("class", "id") and tag not in INLINE:
            for name in v.split():
                words = {w.lower() for w in _WORDS.findall(name)}
                if words & READER_WORDS and words <= READER_WORDS | READER_BESIDE | NEUTRAL and not (words <= {"thread", "threads"} | NEUTRAL):
                    return HARD
                hit = words & FURNITURE_WORDS
                if tag == "article":
                    hit &= {"comment"}
                if hit and not words & NEGATING and not (hit == {"header"} and (in_article or words & HEADING_OF)):
                    mark = max(mark, STRONG if words <= FURNITURE_WORDS | NEUTRAL else WEAK)
    return mark


class Lines(HTMLParser):
    """Collects (text, tags, innermost element, its worst mark, the outermost element with a mark) of each block from the event stream.

    Elements are numbered as they open, so an element holds the numbers from its own to its `last`. For each tag the places
    where it is open in the stack are kept, so no event walks the stack.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int]] = []
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.fences: list[int] = []
        self.articles = 0
        self.parents: list[int] = []
        self.last: list[int] = []
        self.names: list[str] = []
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.linked: list[bool] = []
        self.link_chars = self.chars = 0
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                _, number, mark, marked = self.stack[-1] if self.stack else _PAGE
                self.lines.append((text, self.tags, number, mark, marked))
                self.linked.append(self.link_chars >= LINK_SHARE * self.chars)
                self.tags = 0
            self.link_chars = self.chars = 0

    def pop(self, depth: int) -> None:
        if self.blocks and self.blocks[-1] >= depth:
            self.flush()
        while len(self.stack) > depth:
            tag, number, _, _ = self.stack.pop()
            self.last[number] = len(self.names) - 1
            self.open[tag].pop()
            self.articles -= tag in ("article", "main")
        for places in (self.blocks, self.fences):
            while places and places[-1] >= depth:
                places.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            if tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            ended = max((self.open[name][-1] for name in ENDS.get(tag, ()) if self.open.get(name)), default=-1)
            if ended >= 0 and (not self.fences or ended > self.fences[-1]):
                self.pop(ended)
            self.flush()
        top = self.stack[-1] if self.stack else _PAGE
        own = furniture(tag, attrs, self.articles > 0)
        if own > top[2]:
            self.flush()
        depth, number = len(self.stack), len(self.names)
        self.stack.append((tag, number, max(own, top[2]), number if own and not top[2] else top[3]))
        self.open.setdefault(tag, []).append(depth)
        self.articles += tag in ("article", "main")
        if tag not in INLINE:
            self.blocks.append(depth)
        if tag in STAYS_OPEN_IN:
            self.fences.append(depth)
        self.parents.append(top[1])
        self.last.append(-1)
        self.names.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self.open.get(tag)
        if not at or tag in INLINE and self.blocks and self.blocks[-1] > at[-1]:
            return
        depth = at[-1]
        if self.stack[depth][2] > (self.stack[depth - 1][2] if depth else 0):
            self.flush()
        self.pop(depth)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.parts.append(data)
        size = len(data) - data.count(" ")
        self.chars += size
        self.link_chars += size if self.open.get("a") else 0

    def finish(self) -> None:
        self.close()
        self.flush()
        self.pop(0)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is normalised over the lines that exist."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def level_of(smooth: list[float]) -> float:
    """The threshold: LEVEL standard deviations of the smoothed ratios."""
    mean = sum(smooth) / len(smooth)
    return LEVEL * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))


def content_regions(ratios: list[float]) -> list[bool]:
    """Lines in a content region: smoothed ratio at or over the threshold."""
    if not ratios:
        return []
    smooth = smoothed(ratios)
    level = level_of(smooth)
    return [x >= level for x in smooth]


def totals(parents: list[int], own: dict[int, int]) -> list[int]:
    """Sum of each element's own value and those of all elements inside it. The last one is of the page."""
    out = [own.get(e, 0) for e in range(len(parents))] + [own.get(-1, 0)]
    for e in range(len(parents) - 1, -1, -1):
        out[parents[e]] += out[e]
    return out


def link_menus(linked: list[bool], region: list[bool]) -> list[bool]:
    """Lines of links that stand in runs of LINK_RUN or more, most of each outside the regions."""
    out, start = [False] * len(linked), 0
    for k, link in enumerate([*linked, False]):
        if not link:
            if k - start >= LINK_RUN and 2 * sum(region[start:k]) < k - start:
                out[start:k] = [True] * (k - start)
            start = k + 1
    return out


def main_text(html: str) -> str:
    p = Lines()
    p.feed(html)
    p.finish()
    at = [k for k, line in enumerate(p.lines) if line[3] < HARD]
    lines = [p.lines[k] for k in at]
    if not lines:
        return ""
    ratios = [0.0 if mark == HARD else len(text) / max(1, tags) for text, tags, _, mark, _ in p.lines]
    inside = content_regions(ratios)
    content = [inside[k] for k in at]
    menu = link_menus([p.linked[k] for k in at], content)
    weight: dict[int, int] = {}
    plain: dict[int, int] = {}
    good: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    for (text, tags, element, mark, marked), region in zip(lines, content):
        if mark == WEAK:
            size = held.setdefault(marked, [0, 0])
            size[0] += len(text) * region
            size[1] += tags
        if region:
            weight[element] = weight.get(element, 0) + len(text)
            plain[element] = plain.get(element, 0) + (not mark)
        good[element] = good.get(element, 0) + (mark < STRONG)
    by_weight, by_plain, by_good = (totals(p.parents, x) for x in (weight, plain, good))
    if not by_weight[-1]:
        return ""
    # Of the elements with enough of the text, the last opened one is the deepest; -1 is the page.
    need = SHARE * by_weight[-1]
    chosen = max((e for e in range(len(p.parents)) if by_weight[e] >= need), default=-1)
    # Most of the text isn't all of it: widen until every block of the regions without a mark is inside.
    while chosen >= 0 and by_plain[chosen] < by_plain[-1]:
        chosen = p.parents[chosen]
    # Then to the outermost article around it, or else the outermost main.
    around: dict[str, int] = {}
    element = chosen
    while element >= 0:
        around[p.names[element]] = element
        element = p.parents[element]
    chosen = around.get("article", around.get("main", chosen))
    # A single block isn't a region: widen to the element that holds it and its neighbours.
    while chosen >= 0 and by_good[chosen] < 2 <= by_good[-1] and p.parents[chosen] >= 0:
        chosen = p.parents[chosen]
    last = p.last[chosen] if chosen >= 0 else len(p.parents)
    # A marked element whose name leaves it open is prose if its text in the regions is, tag for tag, over the threshold too.
    level = level_of(smoothed(ratios))
    prose = {e for e, (text, tags) in held.items() if text >= level * max(1, tags)}
    return " ".join(text for (text, _, e, mark, marked), links in zip(lines, menu) if not links and chosen <= e <= last and (not mark or mark == WEAK and marked in prose))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns id, url, text, n_chars."""
    session_defaults(pages.sparkSession)

    def make(batch: pa.RecordBatch):
        texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return mapped(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), make, "id long, url string, text string, n_chars long")
