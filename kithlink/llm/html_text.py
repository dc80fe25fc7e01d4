"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser gives events; block-level tags cut them into lines, each with its text length,
the tags met in it, and the element it stands in. A line's text-to-tag ratio is smoothed over its neighbours with a
Gaussian; two-means clustering of the logarithms parts content from clutter. A line gains by what its smoothed ratio lies
above that threshold and loses by what it lies below. The content region is the element whose lines gain most together,
so short lines between long ones are kept and menus beside it are not (a line that the page repeats counts once); on pages that wrap the content in no element of its own it
is the stretch of lines that gains most. Tag names and words of class, id and role only remove what is never content: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comment sections.

``extract`` is the function, ``extract_pages`` its column form. Null or empty html gives empty text; very long pages are read whole, in
time linear in their length, and nothing is capped; unclosed, cut-off and broken markup is read as far as it goes; of elements that gain alike the innermost wins;
repeated rows stay; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: HTML elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "noscript ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
DROPPED = frozenset("nav footer aside form script style noscript template head title button select option textarea iframe object svg canvas audio video dialog menu search datalist math".split())
#: Words of class, id and role that mark clutter.
CLUTTER = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted outbrain taboola nav navbar navigation menu menubar topnav breadcrumb breadcrumbs "
    "footer foot sidebar sidebars side aside rail widget widgets cookie cookies consent gdpr notice notices alert alerts toolbar masthead comment comments discussion disqus respond replies reply responses "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay paywall pagination pager skip search contentinfo complementary".split()
)
#: A class word with one of these says that the element is what the page is about, whatever other words it has.
ARTICLE_WORDS = frozenset("article content post entry story main body articlebody".split())
#: A clutter word after one of these names what the element lacks or is beside.
BESIDE = frozenset("no not has have with without".split())
#: Opening one of these ends an open paragraph; opening one of an element's own kind ends it.
ENDS_P = BLOCKS - {"button", "option", "select", "template", "noscript", "body", "html", "head", "title", "td", "th", "tr"}
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_comment_end = re.compile(r"--\s*!?>")
_opens = re.compile(r"<[A-Za-z/!?]")
_word = re.compile(r"[a-z]+")
_hidden = re.compile(r"display\s*:\s*none")
SIGMA = 1.5
#: By how much more than the whole page a stretch of lines must gain to be taken instead.
WRAPPED = 2.0


class Line:
    __slots__ = ("clutter", "inside", "tags", "text")

    def __init__(self, text: str, tags: int, inside: int, clutter: bool):
        self.text, self.tags, self.inside, self.clutter = text, tags, inside, clutter


class Events(HTMLParser):
    """Parser events to lines. Element 0 is the page; ``parents`` holds each element's parent, which has a lower number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # name, number, whether it or one around it is clutter
        self.where: dict[str, list[int]] = {}  # places of each name in the stack
        self.parents = [0]
        self.outer = {0}  # the page, its html and body
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0

    def read(self, html: str) -> None:
        """All of a page. A tag that the page's end cuts off is dropped with what follows, so the parser never looks for its end again and again."""
        upto = html.rfind(">") + 1
        self.last_comment = max((m.end() for m in _comment_end.finditer(html)), default=-1)
        self.feed(html[:upto] + _opens.split(html[upto:], maxsplit=1)[0])
        self.last_comment = -1
        self.close()
        self.cut()

    def parse_comment(self, i, report=1):
        return super().parse_comment(i, report) if i < self.last_comment else -1

    def parse_marked_section(self, i, report=1):
        """``<![`` of any kind is a comment up to the next ``>``."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, inside, clutter = self.stack[-1] if self.stack else ("", 0, False)
            self.lines.append(Line(text, self.tags, inside, clutter))
            self.tags = 0
        self.parts = []

    def _pop(self, to: int) -> None:
        for name, _, _ in self.stack[to:]:
            self.where[name].pop()
        del self.stack[to:]

    def _nearest(self, names: tuple[str, ...]) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in BLOCKS and tag not in DROPPED:
            if tag == "br" or tag == "img":
                self.parts.append(" ")
            return
        self.cut()
        if tag in ENDS_P and self.stack and self.stack[-1][0] == "p":
            self._pop(len(self.stack) - 1)
        if tag in OWN_KIND:
            at = self._nearest(OWN_KIND[tag])
            if at > self._nearest(("tr", "table") if tag in ("td", "th") else ("ul", "ol", "dl", "table")):
                self._pop(at)
        if tag in VOID:
            return
        clutter = bool(self.stack) and self.stack[-1][2] or tag in DROPPED or tag == "header" and self._nearest(("article", "main")) < 0
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value and tag not in ("body", "html", "article", "main"):
                words = _word.findall(value.lower())
                named = {w for w, before in zip(words, ["", *words], strict=False) if before not in BESIDE}
                clutter = clutter or bool(named & CLUTTER) and not named & ARTICLE_WORDS
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _hidden.search(value):
                clutter = True
        self.parents.append(self.stack[-1][1] if self.stack else 0)
        if tag in ("html", "body"):
            self.outer.add(len(self.parents) - 1)
        self.where.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, len(self.parents) - 1, clutter))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in BLOCKS and tag not in DROPPED:
            return
        self.cut()
        at = self._nearest((tag,))
        if at >= 0 and (tag != "p" or at == len(self.stack) - 1):
            self._pop(at)

    def handle_data(self, data):
        self.parts.append(data)


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing, the kernel cut at three sigma and renormalised at the ends; 0 smooths nothing."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) if d else 1.0 for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        a, b = max(0, i - reach), min(len(ratios), i + reach + 1)
        weights = kernel[a - i + reach : b - i + reach]
        out.append(sum(w * r for w, r in zip(weights, ratios[a:b], strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Two-means clustering on a line: the middle of the two cluster means."""
    low, high = min(values), max(values)
    for _ in range(50):
        middle = (low + high) / 2
        below, above = [v for v in values if v < middle], [v for v in values if v >= middle]
        if not below or not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def best_stretch(gains: list[float]) -> tuple[float, int, int]:
    """(sum, first, end) of the stretch with the largest sum."""
    best, first, total = (0.0, 0, 0), 0, 0.0
    for i, g in enumerate(gains):
        if total <= 0:
            first, total = i, 0.0
        total += g
        if total > best[0]:
            best = (total, first, i + 1)
    return best


def region(events: Events, sigma: float = SIGMA, clustered: bool = True) -> list[Line]:
    """The lines of the content region; what is removed by its name takes part in the clustering only."""
    lines, parents = events.lines, events.parents
    values = [math.log1p(r) for r in smoothed([len(x.text) / max(1, x.tags) for x in lines], sigma)]
    met: set[str] = set()
    fresh = [not (x.text in met or met.add(x.text)) for x in lines]
    least = threshold([v for v, new in zip(values, fresh, strict=True) if new]) if clustered else 0.0
    own = [(x, v - least if new else 0.0) for x, v, new in zip(lines, values, fresh, strict=True) if not x.clutter]
    sums, several = [0.0] * len(parents), [0] * len(parents)
    for x, gain in own:
        sums[x.inside] += gain
        several[x.inside] += gain != 0
    for e in range(len(parents) - 1, 0, -1):
        sums[parents[e]] += sums[e]
        several[parents[e]] += several[e]
    # a line alone is no region, unless the page has but one
    best = max((e for e in range(len(parents)) if several[e] >= min(2, several[0])), key=lambda e: (round(sums[e], 9), e if several[0] > 1 else -e))
    total, first, end = best_stretch([g for _, g in own])
    if best in events.outer and total > WRAPPED * max(sums[best], 0.0) and sum(g > 0 for _, g in own[first:end]) > 1:
        return [x for x, _ in own[first:end]]
    inside = [False] * len(parents)
    for e in range(best, len(parents)):
        inside[e] = e == best or inside[parents[e]]
    return [x for x, _ in own if inside[x.inside]]


def extract(html: str | None, sigma: float = SIGMA, clustered: bool = True) -> str:
    """The page's main text. Without smoothing (sigma 0) or clustering it shows what these are worth."""
    if not html:
        return ""
    events = Events()
    events.read(html)
    if not events.lines:
        return ""
    return "\n\n".join(x.text for x in region(events, sigma, clustered))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def work(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
