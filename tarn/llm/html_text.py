"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering.

A page may be one physical line, so a line here is a block: the text between two block-level tags. Its ratio is its
text's length over the number of tags in it (at least 1), times a weight: 0 in elements that are never main text (NOT_MAIN,
or a class, id or role that says so), 1 in an article or main element, and OUTSIDE for other lines of a page that has such
elements. The weighted ratios are smoothed with a Gaussian; lines that reach the threshold (the standard deviation of the smoothed ratios)
are content. Lines of one container (an article or main element, else the nearest of CONTAINERS around) are a region. A
region is content if it has a line that is, and the region with the largest sum of smoothed ratios always is one. Of an article or main
region all lines of a weight are taken, short ones too; of another those from its first to its last content line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import map_columns, read_table

SIGMA, RADIUS, OUTSIDE = 1.0, 2, 0.25
#: HTML's element names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_MAIN = frozenset("nav footer aside form script style noscript template head title button select textarea iframe object svg math canvas dialog menu".split())
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("body center details div fieldset section table td".split())
#: Elements whose end is left out: a start tag in the set ends an open element of that name.
ENDS = {"p": BLOCKS - {"body", "html"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option", "optgroup"))}
#: Words of a class, id or role that mark what is no main text.
MARKS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: The begin of a tag, comment or declaration.
OPEN = re.compile(r"<[!?/]?(?:[A-Za-z]|--|\[)")


class Line(NamedTuple):
    text: str
    tags: int
    skipped: bool
    region: int
    main: bool


class Lines(HTMLParser):
    """Collects the lines of a page. Every tag costs constant time on average: an element is looked for only if one of its name is open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool]] = []  # name, skipped, region, main
        self.names: Counter[str] = Counter()
        self.blocks: list[int] = []  # places of block elements in open
        self.parts: list[str] = []
        self.tags, self.regions = 0, 0
        self.lines: list[Line] = []

    def flush(self) -> None:
        if self.parts and (text := SPACE.sub(" ", "".join(self.parts)).strip()):
            _, skipped, region, main = self.open[-1] if self.open else ("", False, 0, False)
            self.lines.append(Line(text, self.tags, skipped, region, main))
        self.parts, self.tags = [], 0

    def cut(self, k: int) -> None:
        """Ends the elements from the k-th open one on."""
        for name, *_ in self.open[k:]:
            self.names[name] -= 1
        del self.open[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.blocks and tag in ENDS.get(self.open[self.blocks[-1]][0], ()):
                self.cut(self.blocks[-1])
        else:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
        if tag in VOID:
            return
        _, skipped, region, main = self.open[-1] if self.open else ("", False, 0, False)
        if not skipped:
            inside_header = tag == "header" and not main  # an article's own header is part of it
            marked = tag not in ("html", "body", *MAIN) and any(not MARKS.isdisjoint(WORDS.findall((v or "").lower())) for a, v in attrs if a in ("class", "id", "role"))
            skipped = tag in NOT_MAIN or inside_header or marked or any(a in ("hidden",) for a, _ in attrs)
            if skipped:
                self.flush()
            if not main and (tag in MAIN or tag in CONTAINERS):
                self.regions += 1
                region, main = self.regions, tag in MAIN
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, skipped, region, main))
        self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag] > 0:
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                k -= 1
            if tag in BLOCKS or self.open[k][1]:
                self.flush()
            else:
                self.tags += 1
            self.cut(k)
        elif tag in BLOCKS:
            self.flush()
        else:
            self.tags += 1

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius), weights / weights.sum(), mode="valid")


def content(smooth: np.ndarray) -> np.ndarray:
    """Which lines are content by their smoothed ratios: those that reach the threshold."""
    return (smooth > 0) & (smooth >= min(smooth.std(), smooth.max(initial=0)))


def main_lines(lines: list[Line]) -> list[str]:
    if not lines:
        return []
    other = OUTSIDE if any(x.main and not x.skipped for x in lines) else 1.0
    weights = np.array([0.0 if x.skipped else 1.0 if x.main else other for x in lines])
    smooth = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines]) * weights) * (weights > 0)
    on = content(smooth)
    regions = np.array([x.region for x in lines])
    sums = np.bincount(regions, smooth)
    chosen = set(regions[on].tolist()) | ({int(sums.argmax())} if sums.max() > 0 else set())
    first, last = {}, {}
    for k in np.flatnonzero(on).tolist():
        first.setdefault(lines[k].region, k)
        last[lines[k].region] = k
    return [x.text for k, x in enumerate(lines) if weights[k] and x.region in chosen and (x.main or first.get(x.region, 0) <= k <= last.get(x.region, k))]


def main_blocks(html: str | None) -> list[str]:
    parser = Lines()
    parser.feed(html or "")
    # a tag or comment that the page's end leaves open goes with all after it, as in HTML; close() would try each "<" in it anew
    if not OPEN.match(parser.rawdata):
        parser.close()
    parser.flush()
    return main_lines(parser.lines)


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of pages: page_id, url, text, n_chars.

    Text is empty for a null or empty html and where nothing but what is left out has text. Pages of any length go whole, in time linear in
    them; ids may be null or repeat. Further columns are left out. An empty table gives no rows.
    """

    def run(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in rows:
            text = ["\n".join(main_blocks(h)) for h in x["html"]]
            yield {"page_id": x["page_id"], "url": x["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_columns(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
