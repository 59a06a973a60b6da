"""Main text of web pages from parser events, text-to-tag ratios and threshold clustering.

The standard library's parser streams a page's events into lines, one for each block of text.  A line
has its ratio of text (outside links) to tags; what the markup declares as furniture (menus, footers,
adverts, forms and so on) has ratio zero.  The ratios are smoothed with a Gaussian and split by a
threshold between two clusters.  Regions of the page that are mostly lines above it are content and keep
all their lines, and so do the short ones between them.  An article or main element that holds such
lines bounds the content; where there is none, the ratios alone choose the regions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, slices, through_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never content.
FURNITURE = frozenset("nav footer aside script style noscript template iframe svg math button select textarea dialog menu search head title object canvas audio video".split())
#: Elements that are regions of the page, and those in which prose stands.
REGION = frozenset("article body div main section td".split())
PROSE = frozenset("article blockquote main p pre".split())
#: Elements that end when another of them starts, up to the element that may hold both.
ENDS = {"p": ("p", ()), "li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}
#: Words in class, id or role that declare furniture.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead cookie cookies consent gdpr notice banner popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus reply replies respond pagination pager widget widgets toolbar skip contentinfo complementary search alert dialog form hidden".split()
)
#: Words beside them that change nothing: what a piece of furniture is made of, where it stands and whose it is.
NEUTRAL = frozenset(
    "area article bar block blog body bottom box btn button buttons card col column container content entry floating footer global group header holder icons inner item items left link links list "
    "main my outer page panel popular post posts primary reader right row secondary section site slot sticky text thread title top unit user wrap wrapper".split()
)
_split = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_space = re.compile(r"\s+")


@dataclass
class Line:
    parts: list[tuple[str, int]]  # text and the claim that it stands in
    tags: int
    linked: int  # characters in links
    region: int
    heading: bool
    text: str = ""


@dataclass
class Region:
    tag: str
    parent: int
    lines: list[int] = field(default_factory=list)


@dataclass
class Claim:
    """That an element is furniture, and the text and prose in it.  A soft one falls if it would take most of the page's prose."""

    parent: int
    soft: bool
    text: int = 0
    prose: int = 0


def declared(attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element's attributes say that it is furniture.  An article may have a header of its own."""
    for k, v in attrs:
        if k in ("class", "id", "role"):
            for name in (v or "").split():
                words = {w.lower() for w in _split.findall(name)}
                told = words & WORDS
                if told and words <= WORDS | NEUTRAL and not (in_article and told == {"header"}):
                    return True
        elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "").lower()):
            return True
    return False


class Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]  # tag, claim, region, in a link, in prose
        self.claims = [Claim(0, True)]  # 0: none
        self.regions = [Region("", 0)]  # 0: outside all elements
        self.lines: list[Line] = []
        self.held: Counter[str] = Counter()  # open elements of each tag, so that none is looked for in vain
        self.parts: list[tuple[str, int]] = []
        self.tags = self.linked = 0
        self.region = -1

    def end_line(self) -> None:
        if self.parts:
            if any(not t.isspace() for t, _ in self.parts):
                region = max(self.region, 0)
                heading = any(e[0] in ("h1", "h2") for e in self.open[-3:])
                self.regions[region].lines.append(len(self.lines))
                self.lines.append(Line(self.parts, self.tags, self.linked, region, heading))
            self.parts = []
        self.tags = self.linked = 0
        self.region = -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.end_line()
            self._close("p", ())
            if tag in ENDS:
                self._close(*ENDS[tag])
        self.tags += 1
        if tag == "br":
            self.parts.append((" ", self.open[-1][1]))
        if tag in VOID:
            return
        _, claim, region, linked, prose = self.open[-1]
        in_article = self._article(region)
        hard = tag in FURNITURE
        if hard or tag == "form" or (tag == "header" and not in_article) or (attrs and tag not in ("html", "body") and declared(attrs, in_article)):
            self.claims.append(Claim(claim, not hard))
            claim = len(self.claims) - 1
        if tag in REGION and (tag in ("article", "main") or not in_article):
            self.regions.append(Region(tag, region))
            region = len(self.regions) - 1
        self.open.append((tag, claim, region, linked or tag == "a", prose or tag in PROSE))
        self.held[tag] += 1

    def _article(self, region: int) -> bool:
        return self.regions[region].tag == "article"

    def _end(self, i: int) -> None:
        for x in self.open[i:]:
            self.held[x[0]] -= 1
        del self.open[i:]

    def _close(self, tag: str, holders: tuple) -> None:
        """Ends an open element that the markup leaves open."""
        if not self.held[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            here = self.open[i][0]
            if here == tag:
                return self._end(i)
            if here in holders or (here in BLOCK and not holders):
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if self.held[tag]:
            self._end(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag))

    def handle_data(self, data: str) -> None:
        tag, claim, region, linked, prose = self.open[-1]
        if tag in ("script", "style"):
            return
        self.parts.append((data, claim))
        size = len(data)
        if linked:
            self.linked += size
        if self.region < 0 and not data.isspace():
            self.region = region
        self.claims[claim].text += size
        self.claims[claim].prose += size * prose

    def settle(self) -> None:
        """Lets soft claims fall that hold most of the prose which no hard claim holds (of all text, if there is no prose); then gives lines their text."""
        for c in reversed(self.claims[1:]):  # parents come before
            if c.soft:
                self.claims[c.parent].text += c.text
                self.claims[c.parent].prose += c.prose
        kind = "prose" if self.claims[0].prose else "text"
        whole = getattr(self.claims[0], kind)
        gone = [False]
        for c in self.claims[1:]:
            gone.append(gone[c.parent] or not c.soft or 2 * getattr(c, kind) <= whole)
        for x in self.lines:
            x.text = _space.sub(" ", "".join([t for t, c in x.parts if not gone[c]])).strip()


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian; what lies beyond the ends counts as zero."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(x, kernel / kernel.sum())[reach : reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """Halfway between the means of the two clusters that 2-means finds from the least and the largest value."""
    low, high = float(x.min()), float(x.max())
    for _ in range(20):
        cut = (low + high) / 2
        below, above = x[x < cut], x[x >= cut]
        new = (float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def chosen(lines: list[Line], regions: list[Region], content: np.ndarray) -> list[bool]:
    """Which lines are main text, from which lines' ratios are above the threshold."""
    share = []
    for r in regions:
        size = sum(len(lines[i].text) for i in r.lines)
        good = sum(len(lines[i].text) for i in r.lines if content[i])
        share.append(good / size if size else 0.0)
    for tag in ("article", "main"):
        # An article keeps all that is in it, a main element if there is no article.
        bound = [False] * len(regions)
        alive = [0.0] * len(regions)
        inside = [-1] * len(regions)
        for k, r in enumerate(regions):
            inside[k] = k if r.tag == tag else inside[r.parent] if k else -1
            if inside[k] >= 0:
                alive[inside[k]] += share[k]
        for k in range(len(regions)):
            bound[k] = inside[k] >= 0 and alive[inside[k]] > 0
        if any(bound):
            return [bool(x.text) and bound[x.region] for x in lines]
    kept = [bool(x.text) and share[x.region] >= 0.5 for x in lines]
    if not any(kept):
        best = max(range(len(regions)), key=lambda k: sum(len(lines[i].text) for i in regions[k].lines if content[i]))
        kept = [bool(x.text) and x.region == best for x in lines]
    # Short lines between content belong to it if they are no lists of links; so do headings right before it.
    at = [i for i, k in enumerate(kept) if k]
    for i in range(at[0], at[-1]) if at else ():
        kept[i] = kept[i] or (bool(lines[i].text) and 2 * lines[i].linked < len(lines[i].text))
    for i in range(len(lines) - 2, -1, -1):
        if lines[i].heading and lines[i].text and kept[i + 1]:
            kept[i] = True
    return kept


def extract(html: str, sigma: float = 1.0, cut=threshold) -> str:
    """Blocks of the content regions in page order, joined by line feeds.  cut: the threshold of the smoothed ratios."""
    parser = Lines()
    for i in range(0, len(html), 1 << 16):
        parser.feed(html[i : i + (1 << 16)])
    parser.close()
    parser.end_line()
    parser.settle()
    lines = parser.lines
    if not any(x.text for x in lines):
        return ""
    ratio = np.array([max(0, len(x.text) - x.linked) / (1 + x.tags) for x in lines])
    # The scale of a ratio is logarithmic: an article's long lines don't make its short ones furniture.
    level = smoothed(np.log1p(ratio), sigma)
    kept = chosen(lines, parser.regions, level >= cut(level))
    return "\n".join(x.text for x, k in zip(lines, kept) if k)


def main_text(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each page; one narrow pass.

    A null or empty page, or one of furniture alone, has an empty text.  Whole pages are read.
    Repeated rows give repeated rows; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [extract(x) for x in as_text(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return kept.transform(through_arrow, run, "page_id long, url string, text string, n_chars long")
