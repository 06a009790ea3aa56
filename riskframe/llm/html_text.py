"""Main text of web pages from standard-library parser events.

One pass over the events of ``html.parser`` builds a page's lines: one per block element, with its
text, the tags in it and where it stands; inline elements leave a line whole, also those left out of
it. Menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts and styles are left out by element, role and the names in class and id. For
the remaining lines the text-to-tag ratios are smoothed by a Gaussian over neighbouring lines and
split by two-means clustering; lines of the high cluster mark content. A page that names its article
(article, main, role=main) gives every line of each such region that holds a marked line, so short
paragraphs of an article are kept; other pages give the lines from the first to the last marked one.

Bad markup fails no row: an unknown declaration ``<![ ... >`` is a comment, and a comment, declaration or
tag that never closes runs to the page's end.

Rows: null html counts as empty; a page without content has the empty text. Repeated rows give equal
texts. Nothing is cut off. Columns other than those named are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SIGMA = 1.0
REACH = int(3 * SIGMA)
#: Clusters whose means differ by less than this factor are one.
APART = 3.0
KERNEL = [math.exp(-d * d / (2 * SIGMA ** 2)) for d in range(REACH + 1)]
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "option", "optgroup", "legend"}
#: A block in one of these leaves a paragraph around it open.
HOLDS = frozenset("noscript template button select iframe object canvas audio video".split())
LEFT_OUT = frozenset("head title script style noscript template nav footer aside form menu dialog button select option textarea input iframe object svg canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset("ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices comment comments disqus respond share sharing social related newsletter subscribe signup popup modal login toolbar pagination pager widget widgets".split())
COMMENTS = frozenset("comment comments disqus respond".split())
REGION = frozenset(("article", "main"))
#: Parts that may stand beside a listed name in a class or id (cookie-banner, sidebar_left).
AROUND = frozenset("area bar bottom box button buttons container content global group holder icons inner item items left link links list main outer page panel primary right row section secondary site slot text top unit wrap wrapper".split())
PARTS = re.compile(r"[-_]+")
#: What the parser keeps back at a page's end if it is markup that never closes: no text.
UNCLOSED = re.compile(r"<[!?/a-zA-Z]")


def _unwanted(name: str) -> bool:
    """Whether a class or id is a listed name, or a compound of listed names and ``AROUND`` only."""
    parts = {p for p in PARTS.split(name) if p and not p.isdigit()}
    return name in NAMES or bool(parts & NAMES) and parts <= NAMES | AROUND


class _Lines(HTMLParser):
    """Lines (text, tags, region, link share) of a page; region 0 is outside any."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.open: list[tuple[str, bool, int]] = []  # element, left out, region
        self.regions = 0
        self.parts: list[str] = []
        self.tags = 0
        self.paragraphs = 0  # p elements opened and not closed

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, 0)  # as browsers do: <![ is a comment up to the next >

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def _out(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1][2] if self.open else 0))
        self.parts, self.tags = [], 0

    def _left_out(self, tag: str, attrs: dict, region: int) -> bool:
        if not attrs:
            return not region if tag == "header" else tag in LEFT_OUT
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
        if tag in REGION or tag in ("body", "html"):
            return tag in REGION and any(_unwanted(x) and COMMENTS & set(PARTS.split(x)) for x in names)
        if tag == "header":
            return not region
        return (tag in LEFT_OUT or any(map(_unwanted, names)) or (attrs.get("role") or "").lower() in ROLES
                or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true")

    def handle_starttag(self, tag, attrs):
        inside = self._out()
        if tag == "br" and not inside:
            self.parts.append("\n")
        if tag in BLOCKS and (not inside or tag == "body"):
            self.tags += 1
            self._flush()
        if tag == "body":
            self.open, self.paragraphs = [x for x in self.open if x[0] == "html"], 0
        if self.paragraphs and tag in CLOSES_P:
            self._close("p", CLOSES_P - {"p"} | HOLDS)
        if tag in VOID:
            self.tags += tag not in BLOCKS and not inside
            return
        attrs = dict(attrs)
        self.paragraphs += tag == "p"
        out, region = self.open[-1][1:] if self.open else (False, 0)
        if not out and not region and (tag in REGION or (attrs.get("role") or "").lower() == "main"):
            self.regions += 1
            region = self.regions
            if tag not in BLOCKS:
                self._flush()
        left_out = out or self._left_out(tag, attrs, region)
        self.tags += tag not in BLOCKS and not left_out
        self.open.append((tag, left_out, region))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, within: frozenset = frozenset()) -> None:
        """Close the innermost open ``tag`` and all in it; look no further out than elements ``within``."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                around = [self.open[i - 1] if i else ("", False, 0), *self.open[i:-1]]
                # inline elements and what stands in left-out ones do not end a line
                if any(not x[1] and (y[0] in BLOCKS or x[2] != y[2]) for x, y in zip(around, self.open[i:], strict=True)):
                    self._flush()
                self.paragraphs -= sum(x[0] == "p" for x in self.open[i:])
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag):
        if not self._out():
            self.tags += 1
            if tag in BLOCKS:
                self._flush()
        # a stray inline end tag does not reach out of the block it stands in
        self._close(tag, frozenset() if tag in BLOCKS | LEFT_OUT and tag != "p" else BLOCKS - {"p"})

    def handle_data(self, data):
        if not self._out():
            self.parts.append(data)

    def close(self):
        if UNCLOSED.match(self.rawdata):  # an unclosed comment, declaration or tag runs to the page's end
            self.rawdata = ""
        super().close()
        self._flush()


def _high(ratios: list[float]) -> list[bool]:
    """Lines of the higher of two clusters of the smoothed ratios."""
    n, smooth = len(ratios), []
    for i in range(n):
        near = range(max(0, i - REACH), min(n, i + REACH + 1))
        smooth.append(sum(KERNEL[abs(i - j)] * ratios[j] for j in near) / sum(KERNEL[abs(i - j)] for j in near))
    low, high = min(smooth), max(smooth)
    for _ in range(30):
        cut = (low + high) / 2
        above, below = [x for x in smooth if x >= cut], [x for x in smooth if x < cut]
        new = sum(below) / len(below) if below else low, sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    if low * APART > high:  # one cluster: nothing stands out, all is content
        return [True] * n
    return [x >= (low + high) / 2 for x in smooth]


def main_text(html: str | None) -> str:
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    high = _high([len(text) / (1 + tags) for text, tags, _ in lines])
    regions = {r for (_, _, r), h in zip(lines, high, strict=True) if r and h} or {r for _, _, r in lines if r}
    if regions:
        return " ".join(text for text, _, r in lines if r in regions)
    at = [i for i, h in enumerate(high) if h]
    return " ".join(text for text, _, _ in lines[at[0]:at[-1] + 1])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    @F.pandas_udf("string")
    def text(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in htmls], dtype=object)

    out = bounded_batches(pages).select("page_id", "url", text(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
