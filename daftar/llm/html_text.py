"""Main text of web pages by text-to-tag ratios (operator 2).

The standard library's parser streams events; blocks of text between block-level tags are the page's lines. A line's ratio is
its characters over the tags in it. The ratios of all lines are smoothed with a Gaussian and, on a log scale, split into content and
rest by a threshold fitted to each page (two-means). The region of the article is the smallest container (article, main, section, div, table cell,
body) around all content lines; containers of one line each that stand apart from one that holds nearly all content, such as notices, don't widen it, and
headings around it belong to it. All of the region counts, so that a short paragraph stays with its article, but runs of lines that are links and no content
(menus, lists of further pages).

What the markup declares only weighs lines: those in navigation, asides, forms, headers and footers of the page, and in elements whose class, id or role
consists of words for menu, sidebar, advert, notice or comments, are no content, nor is what follows a heading that announces comments; lines
in a declared article or main part weigh DECLARED times their characters when regions are compared.

Defined results: null and empty html give an empty text; broken or unclosed markup is read to the end: unknown declarations are comments, and an
article or main part that begins inside an element left open counts nevertheless; a page without visible text gives an empty text; a page is one
row and rows are kept one for one. A page is handled whole inside one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from daftar.llm.common import small_batches

#: Elements by what they are to the text.
SKIPPED = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg canvas object video audio math dialog menu".split())
#: Of these not even the ratios count.
UNSEEN = frozenset("script style noscript template head title textarea iframe svg canvas object video audio math".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("article main section div td body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Closed by the start of another block: paragraphs, items and the head need no end tag.
LOOSE = {"head": BLOCKS | SKIPPED - frozenset("script style noscript template head title".split()) | {"body"}, "p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
#: Words in class, id or role that declare an element no part of the article.
OUTSIDE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies reply respond related recommended recommendations share sharing social pagination pager toolbar contentinfo complementary search skip".split())
#: Words that may stand beside those and change nothing, and words that make a header one of an article.
BESIDE = frozenset("box block wrapper wrap container list bar area item items top bottom left right inner outer panel row col column site page global main primary secondary links link button buttons icons form reader readers user users text section slot unit google the our more also read".split())
ARTICLE = frozenset("article post entry story title".split())
ANNOUNCED = re.compile(r"(?i)^\W*(?:\d+\W+)?(?:(?:reader|user|readers'|your)\W+)?(?:comments?|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))\W*(?:\d+\W*)?$")
DECLARED = 4
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Line:
    """text; tags in it; characters of links; the container around it (a number, see _Reader.parents); in a heading; inside an article or main part; hidden by what the markup declares; doubts: see _Reader."""

    text: str
    tags: int
    linked: int
    container: int
    heading: bool
    inside: bool
    hidden: bool
    doubts: tuple[int, ...]


def declares(value: str) -> bool:
    """Whether a class, id or role has a part that is made of words for what is no article."""
    for part in value.split():
        words = {w.lower() for w in _NAME.findall(part)}
        if not words.isdisjoint(OUTSIDE) and words <= OUTSIDE | BESIDE | ARTICLE and not (words & ARTICLE and words & {"header", "side", "notice"}):
            return True
    return False


class _Reader(HTMLParser):
    """Collects the lines and the tree of containers.

    An element declared outside hides what it holds. An article or main part that begins in it leaves it in doubt: if its own end tag never
    comes, it was left open and hides nothing of the article.
    """

    def __init__(self, skipped: frozenset = SKIPPED) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped = skipped
        self.stack: list[tuple[str, int, int, tuple[int, ...], int, bool]] = []
        #: The number of the element that hides this place (0: none), and the numbers of those in doubt.
        self.outside, self.doubts, self.section, self.inside = 0, (), 0, False
        self.hiding = 0
        self.closed: set[int] = set()
        #: Tag and parent of each container; number 0 is the page.
        self.tags_of, self.parents = ["page"], [0]
        self.announced: set[int] = set()  # containers in which a heading has announced comments
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.headings = self.unseen = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                heading = self.headings > 0
                if heading and self.section and ANNOUNCED.match(text):
                    self.announced.add(self.section)
                hidden = self.outside > 0 or self.section in self.announced
                self.lines.append(Line(text, self.tags, self.linked, self.section, heading, self.inside, hidden, self.doubts))
            self.text = []
        self.tags = self.linked = 0

    def _pop(self, ended: bool = False) -> None:
        """ended: by its own end tag."""
        tag, hides, self.outside, self.doubts, self.section, self.inside = self.stack.pop()
        self.links -= tag == "a"
        self.headings -= tag in HEADINGS
        self.unseen -= tag in UNSEEN
        if hides and (ended or tag in LOOSE):
            self.closed.add(hides)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Unknown and unclosed declarations are comments up to the next `>`."""
        try:
            end = super().parse_marked_section(i, report)
        except AssertionError:
            end = -1
        return end if end >= 0 else self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in SKIPPED or tag == "body":
            self.flush()
            while self.stack and tag in LOOSE.get(self.stack[-1][0], ()):
                self._pop()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        around = (self.outside, self.doubts, self.section, self.inside)
        hides = 0
        if tag in ("article", "main") and self.outside:
            self.doubts, self.outside = (*self.doubts, self.outside), 0
        if not self.outside:
            outside = tag in self.skipped or tag == "header" and not self.inside or tag not in HEADINGS and tag not in ("html", "body", "article", "main") and any(k in ("class", "id", "role") and v and declares(v) for k, v in attrs)
            outside |= any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)
            if outside:
                self.hiding += 1
                hides = self.outside = self.hiding
        self.stack.append((tag, hides, *around))
        self.links += tag == "a"
        self.headings += tag in HEADINGS
        self.unseen += tag in UNSEEN
        if tag in SECTIONS:
            self.tags_of.append(tag)
            self.parents.append(self.section)
            if self.section in self.announced:
                self.announced.add(len(self.parents) - 1)
            self.section = len(self.parents) - 1
            self.inside |= tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED or tag in ("body", "html"):
            self.flush()
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop(len(self.stack) == k + 1)
                return
            if self.stack[k][0] in SECTIONS and tag not in SECTIONS and tag not in SKIPPED:
                return  # a stray end tag doesn't close the section around it

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """A Gaussian over neighbouring lines, weights renormalised at the ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(x: np.ndarray) -> float:
    """Two-means split of the smoothed ratios' logarithms; below their least where all are alike."""
    lo, hi = float(x.min()), float(x.max())
    if hi < lo + 0.7:
        return lo
    cut = (lo + hi) / 2
    for _ in range(20):
        low, high = x[x < cut], x[x >= cut]
        new = (low.mean() + high.mean()) / 2 if len(low) and len(high) else cut
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def region(lines: list[Line], content: np.ndarray, tags: list[str], parents: list[int]) -> set[int]:
    """The containers of the article, by the content lines."""

    def chain(c: int) -> list[int]:
        """From the page down to the container."""
        out = [c]
        while out[-1]:
            out.append(parents[out[-1]])
        return out[::-1]

    chains = [chain(x.container) for x in lines]
    inside = sum(DECLARED * len(x.text) for x, yes in zip(lines, content, strict=True) if yes and x.inside)
    beside = sum(len(x.text) for x, yes in zip(lines, content, strict=True) if yes and not x.inside)
    if inside >= beside and inside:
        declared = {next(i for i in c if tags[i] in ("article", "main")) for c, x in zip(chains, lines, strict=True) if x.inside and not x.hidden}
        articles = {next((i for i in c if tags[i] == "article"), None) for c, x, yes in zip(chains, lines, content, strict=True) if yes and x.inside}
        return declared if None in articles or not articles else articles
    own = [c for c, yes in zip(chains, content, strict=True) if yes]
    size = [len(x.text) for x, yes in zip(lines, content, strict=True) if yes]
    depth = 0
    while all(len(c) > depth + 1 for c in own) and len({c[depth + 1] for c in own}) == 1:
        depth += 1
    while True:  # a container of nearly all content, beside containers of one line each
        below = [c[depth + 1] if len(c) > depth + 1 else None for c in own]
        if None in below:
            break
        mass = {b: sum(n for n, o in zip(size, below, strict=True) if o == b) for b in below}
        best = max(mass, key=mass.get)
        lone = all(sum(len(c) > depth + 1 and c[depth + 1] == b for c in chains) == 1 for b in mass if b != best)
        if mass[best] < 0.8 * sum(size) or not lone:
            break
        keep = [b == best for b in below]
        own, size = [c for c, k in zip(own, keep, strict=True) if k], [n for n, k in zip(size, keep, strict=True) if k]
        depth += 1
        while all(len(c) > depth + 1 for c in own) and len({c[depth + 1] for c in own}) == 1:
            depth += 1
    found = own[0][: depth + 1]
    while len(found) > 1:  # headings just around it
        around = [x for c, x in zip(chains, lines, strict=True) if not x.hidden and found[-2] in c and found[-1] not in c]
        if not around or not all(x.heading for x in around):
            break
        found.pop()
    return {found[-1]}


def main_text(html: str | None, skipped: frozenset = SKIPPED) -> str:
    """The page's main text: blocks in page order, one per line. A page that has no text outside forms stands in one, so its forms count as other containers."""
    if not html:
        return ""
    reader = _Reader(skipped)
    reader.feed(html)
    reader.close()
    reader.flush()
    lines = reader.lines
    for x in lines:
        x.hidden |= not reader.closed.isdisjoint(x.doubts)
    seen = np.array([not x.hidden for x in lines], bool)
    if not seen.any():
        return main_text(html, skipped - {"form"}) if "form" in skipped and "<form" in html.lower() else ""
    smoothed = np.log1p(smooth(np.array([len(x.text) / max(1, x.tags) for x in lines])))
    high = smoothed >= threshold(smoothed)
    links = np.array([x.linked >= 0.8 * len(x.text) for x in lines])  # beside a paragraph, smoothing lifts a link too
    content = seen & high & ~links
    if not content.any():
        content = seen & (smoothed >= smoothed[seen].max())
    own = region(lines, content, reader.tags_of, reader.parents)
    belongs = list(map(own.__contains__, range(len(reader.parents))))
    for c, parent in enumerate(reader.parents):  # parents come first
        belongs[c] |= c > 0 and belongs[parent]
    menu = links & ~high
    edges = np.flatnonzero(np.diff(np.r_[0, menu.astype(np.int8), 0]))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a < 3:
            menu[a:b] = False
    return "\n".join(x.text for x, m in zip(lines, menu.tolist(), strict=True) if not x.hidden and not m and belongs[x.container])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                texts = [main_text(h) for h in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
