"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams events; block-level tags cut the page into lines, each with its text, its number of
tags and its link text. Lines inside elements that are never content (menus, footers, forms, adverts, comments and so on)
don't compete. All others do: their ratios of text to tags, smoothed over neighbours, are cut at a threshold into content and rest, and content lines
add up in their region (the nearest enclosing article or main, or else container). Regions whose sum is a fair share of the greatest give the main text,
with their short lines too, and so do two or more regions of text without lines of links that follow each other beside such a region. An article or main element counts for more, but it has to
have content lines as any other region.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import string_col

# Fixed element and name lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video select option textarea button title".split())
NEVER = frozenset("nav footer aside form dialog menu header".split())
REGION = frozenset("article main section div td body blockquote".split())
SECTION = frozenset("article main".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar header masthead footer sidebar sidebars rail widget widgets related recommended recommendations trending "
    "share sharing social comment comments commentlist discussion disqus replies reviews respond skip copyright legal disclaimer tags".split()
)
#: Words that stand beside those in a name without changing what it says. With any other word (social-history) the name says something else.
BESIDE = frozenset(
    "site page global main primary secondary top bottom left right inner outer upper lower wrapper wrap container content contents box block bar area section list item items link links post posts article articles news story "
    "sticky fixed mobile desktop col column row slot unit google js is has button buttons icon icons media form user new policy text title group holder panel the and of".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SIGMA, SPREAD = 1.0, 0.5
#: What a line inside article or main counts for, and the share of the greatest region that a region needs.
SECTION_WEIGHT, SHARE = 8.0, 0.2


class _Lines(HTMLParser):
    """Cuts a page into lines: text, tags, link characters, region, whether excluded, whether in a section."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # name, excluded, region, in a section; the page itself first
        self.lines, self.parts, self.tags, self.links, self.in_link, self.above = [], [], 0, 0, 0, [-1]  # above: each region's enclosing one
        self.open, self.scopes = Counter(), [Counter()]  # names of open elements: in all, and since each body, article or main

    def push(self, name: str, excluded: bool, region: int, section: bool) -> None:
        self.stack.append((name, excluded, region, section))
        self.open[name] += 1
        if name == "body" or name in SECTION:
            self.scopes.append(Counter())
        self.scopes[-1][name] += 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        if name == "body" or name in SECTION:
            self.scopes.pop()
        else:
            self.scopes[-1][name] -= 1
        return name

    def parse_marked_section(self, i, report=1):
        """<![...]> is a comment, whatever it holds."""
        return self.parse_bogus_comment(i)

    def read(self, html: str) -> None:
        """The whole page, in time that grows with its length: what isn't finished yet is looked at again only when as much has come in again.

        A tag that nothing closes would swallow the rest, such as one with an open quote: from there on quotes don't count. What then still has no end, comments without
        an end and cut-off tags are markup without text.
        """
        self.pieces(html)
        rest, self.rawdata = self.rawdata, ""
        if self.cdata_elem or rest.startswith("<!--"):
            return
        if "<" in rest and ">" in rest:
            self.pieces(rest.replace('"', "").replace("'", ""))
            rest, self.rawdata = self.rawdata, ""
            if self.cdata_elem or rest.startswith("<!--"):
                return
        self.rawdata = rest.split("<", 1)[0]
        self.close()

    def pieces(self, html: str) -> None:
        at = 0
        while at < len(html):
            size = max(1 << 14, len(self.rawdata))
            self.feed(html[at : at + size])
            at += size

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, excluded, region, section = self.stack[-1]
            self.lines.append((text, self.tags, self.links, region, excluded, section))
        self.parts, self.tags, self.links = [], 0, 0

    def _bad(self, tag: str, attrs) -> bool:
        if tag in SILENT or tag in NEVER and not (tag == "header" and self.stack[-1][3]):
            return True
        if tag in ("html", "body", *SECTION):
            return False
        for key, value in attrs:
            if key in ("class", "id") and value and any(map(telling, value.split())):
                return True
            if key == "role" and (value or "").lower() in ROLES or key == "hidden" or key == "aria-hidden" and (value or "").lower() == "true":
                return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.cut()
            return
        if tag in INLINE and not self._bad(tag, attrs):
            self.in_link += tag == "a"
            return
        self.cut()
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and self.stack[-1][0] == tag:
            self.pop()
        if tag in ("article", "main"):  # an element left open before it doesn't hide the article
            while self.stack[-1][1] and self.stack[-1][0] in ("div", "p", "span", "ul", "li", "section"):
                self.pop()
        _, excluded, region, section = self.stack[-1]
        if tag in SECTION or tag in REGION and not section:  # inside a section all is one region, but for a section in it
            self.above.append(region)
            region = len(self.above) - 1
        bad = self._bad(tag, attrs)
        self.in_link = 0
        self.push(tag, excluded or bad, region, section or tag in SECTION)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        # a stray end tag doesn't close what encloses it: only html and body reach beyond the nearest article, main or body
        if (self.open if tag in ("html", "body") else self.scopes[-1])[tag]:
            self.cut()
            while self.pop() != tag:
                pass
            return
        if tag not in INLINE and tag not in VOID:
            self.cut()

    def handle_data(self, data):
        if self.stack[-1][0] in SILENT:
            return
        self.parts.append(data)
        if self.in_link:
            self.links += len(data)


def telling(name: str) -> bool:
    """Whether a class or id names a menu, an advert, comments or the like: a word of NAMES, and beside it only such and neutral words."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    return not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE for w in words)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the weights of what lies beyond the ends go to the rest."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    # the full products, cut to the values' places: also where there are fewer values than weights
    cut = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[cut] / np.convolve(np.ones(len(values)), kernel)[cut]


def blocks(html: str | None) -> list[str]:
    """The page's content blocks in page order, white space inside them as single spaces."""
    page = _Lines()
    page.read(html or "")
    page.cut()
    lines = [x for x in page.lines if not x[4]]
    if not lines:
        return []
    ratio = smooth(ratios(lines))
    threshold = min(SPREAD * ratio.std(), ratio.max())
    sums: dict[int, float] = {}
    for (text, _, links, region, _, section), r in zip(lines, ratio.tolist(), strict=True):
        if r >= threshold and 2 * links <= len(text):  # lines of links never open a region
            sums[region] = sums.get(region, 0.0) + r * (SECTION_WEIGHT if section else 1.0)
    least = SHARE * max(sums.values(), default=0.0)
    kept = {region for region, total in sums.items() if total >= least}
    order = list(dict.fromkeys(x[3] for x in page.lines))  # regions with text, as the page has them
    beside, more = {page.above[region] for region in kept}, set()
    linked = {region for text, _, links, region, *_ in lines if 2 * links > len(text)}
    plain = {x[3] for x in lines if x[3] in kept or x[3] not in linked}
    runs: list[list[int]] = []  # regions of text that follow each other in one container
    for before, region in zip([None, *order], order, strict=False):
        if region in plain and page.above[region] in beside:
            if before in plain and page.above[before] == page.above[region]:
                runs[-1].append(region)
            else:
                runs.append([region])
    for run in runs:
        for weak, few in groupby(run, lambda region: region not in kept):
            few = list(few)
            if weak and len(few) > 1 and len(few) < len(run):
                more.update(few)
    kept |= more
    return [x[0] for x in lines if x[3] in kept]


def ratios(lines: list[tuple]) -> np.ndarray:
    """Characters outside of links for each tag of a line."""
    return np.array([max(0, len(text) - links) / max(1, tags) for text, tags, links, *_ in lines])


def extract(pages: DataFrame, html_col: str = "html", batch: int = 128) -> DataFrame:
    """pages without the html, with text (blocks joined by a line feed; empty if none), n_blocks and n_chars (code points).

    A null or empty html has no text. Pages may be cut off anywhere and of any length, and no markup, however broken, ends the job. Repeated rows are each a page, an empty table
    gives an empty one. Other columns stay, but for older ones of those names.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_blocks", "n_chars", "__html")]

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("__html")
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                found = [blocks(h.as_py()) for h in part.column(at)]
                texts = ["\n".join(x) for x in found]
                made = (pa.array(texts, pa.string()), pa.array(list(map(len, found)), pa.int32()), pa.array(list(map(len, texts)), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(rest))), *made], [*rest, "text", "n_blocks", "n_chars"])

    keep = [F.col(f"`{c}`") for c in rest]
    full = pages.select(*keep, string_col(pages, html_col).alias("__html"))
    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).alias("n_blocks"), F.lit(0).cast("long").alias("n_chars")).schema
    return full.mapInArrow(run, schema)
