"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: the text between block borders,
with the tags seen in it. Each line has a ratio of characters to tags. The ratios are smoothed with
a Gaussian, and lines over a threshold between the two clusters of smoothed values are content.
The content lines name a region: the innermost element that holds most of their characters. All
lines of the region are kept, so that a short paragraph or a heading beside long ones is not lost,
and so are the content lines outside it; if the page has no such element below its body, the body is the region. Lines inside
elements that are never article text (menus, forms, adverts, comments) take no part at any step. A form
or an element marked only by its class, id or role that holds most of the page's text is a wrapper and
stays, unless the page has an article elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button option datalist".split())
APART = frozenset("nav footer aside dialog menu search".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the first kind ends when one of the second begins.
ENDED_BY = {
    "p": BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"}, "head": {"body", "article", "main", "div", "p", "nav", "header", "h1"},
}
#: Words in class, id and role that mark a part as no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
    "consent disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted related respond sidebar share sharing signup social sponsor sponsored subscribe toolbar "
    "widget widgets complementary contentinfo search dialog alert paywall".split()
)
#: Before a mark these say how a wrapper is laid out; ids of headings and paragraphs are made from their words.
LAYOUT = frozenset("with without has have no not non".split())
UNMARKED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Elements whose own header or footer belongs to the article's frame, too.
REGIONS = frozenset("article main".split())


def hidden(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether the attributes say that a part is not shown."""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def marked(attrs: list[tuple[str, str | None]], tag: str) -> bool:
    """Whether class, id or role mark a part as no article text."""
    if tag in ("body", "html", *REGIONS, *UNMARKED):
        return False
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for one in value.split():
                words = [w for w in SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()) if w]
                if any(w in MARKS and not LAYOUT.intersection(words[:i]) for i, w in enumerate(words)):
                    return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, path, apart) per line; ``path`` is the stack of open elements by number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, number, never text, apart from the article
        self.names: list[str] = []
        self.marks: set[int] = set()  # forms and marked elements
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.text: list[str] = []
        self.tags = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section is a bogus comment: it ends at the next ``>``, whatever it holds, or with the page."""
        end = self.rawdata.find(">", i + 3)
        return len(self.rawdata) if end < 0 else end + 1

    def end_line(self) -> None:
        if not self.text:
            self.tags = 0
            return
        text = " ".join("".join(self.text).split())
        if text:
            path = tuple(number for _, number, _, _ in self.open)
            self.lines.append((text, self.tags, path, bool(self.open) and self.open[-1][3]))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and tag in ENDED_BY.get(self.innermost(), ()):
            self.close_to(self.innermost())
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag == "br" or tag == "hr":
            self.text.append(" ")
        if tag in VOID:
            return
        _, _, never, apart = self.open[-1] if self.open else ("", 0, False, False)
        inside = any(t in REGIONS for t, _, _, _ in self.open)
        self.open.append((
            tag, len(self.names), never or tag in HIDDEN,
            apart or tag in APART or tag == "header" and not inside or hidden(attrs),
        ))
        if tag == "form" or marked(attrs, tag):
            self.marks.add(len(self.names))
        self.names.append(tag)

    def innermost(self) -> str:
        """The innermost open element that a new one may end: inline elements inside it end with it."""
        for tag, _, _, _ in reversed(self.open):
            if tag in ENDED_BY or tag in BLOCKS:
                return tag
        return ""

    def close_to(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if any(t in BLOCKS or t in ENDED_BY for t, _, _, _ in self.open[i:]):
                    self.end_line()
                del self.open[i:]
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][2]):
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the weights are renewed at the borders so that they add up to one."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    top = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return top / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def two_clusters(values: np.ndarray) -> float:
    """The threshold midway between the means of two clusters of values (one-dimensional 2-means)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            return cut
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_blocks(html: str | None, sigma: float = 1.0, share: float = 0.7) -> list[str]:
    """The blocks of the main text, in page order."""
    if not html:
        return []
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    shown = [(text, tags, path) for text, tags, path, apart in parser.lines if not apart]
    away = parser.marks - wrappers(shown, parser.names, parser.marks)
    lines = [line for line in shown if away.isdisjoint(line[2])]
    if not lines:
        return []
    length = np.array([len(text) for text, _, _ in lines], float)
    smooth = smoothed(length / np.maximum(1, [tags for _, tags, _ in lines]), sigma)
    content = smooth >= min(two_clusters(smooth), smooth.max())
    region = region_of([p for (_, _, p), c in zip(lines, content) if c], length[content], parser.names, share)
    if region is None:  # the article lies in the body itself, or in parts side by side
        return [text for text, _, _ in lines]
    return [text for (text, _, path), c in zip(lines, content) if c or region in path]


def wrappers(lines: list[tuple[str, int, tuple[int, ...]]], names: list[str], marks: set[int]) -> set[int]:
    """The marked elements with over half of the text, if no article or main beside them has any."""
    held = dict.fromkeys(marks, 0)
    for text, _, path in lines if marks else ():
        for number in marks.intersection(path):
            held[number] += len(text)
    total = sum(len(text) for text, _, _ in lines)
    found = set()
    for number in (n for n, size in held.items() if 2 * size > total):
        around = next(path for _, _, path in lines if number in path)
        around = set(around[:around.index(number)])
        if not any(names[n] in REGIONS and n not in around for _, _, path in lines if number not in path for n in path):
            found.add(number)
    return found


def region_of(paths: list[tuple[int, ...]], weight: np.ndarray, names: list[str], share: float) -> int | None:
    """The innermost element holding at least ``share`` of the content; an article or main around it, if any."""
    held: dict[int, float] = {}
    for path, w in zip(paths, weight):
        for number in path:
            held[number] = held.get(number, 0.0) + w
    total = float(weight.sum())
    most = [n for n, w in held.items() if w >= share * total]  # a chain of nested elements
    regions = [n for n in most if names[n] in REGIONS]
    if regions:
        return max(regions)
    most = [n for n in most if names[n] in BLOCKS and names[n] not in ("html", "body", "p", "td", "li")]
    return max(most) if most else None


def extract_text(pages: DataFrame, html_column: str = "html", sigma: float = 1.0, share: float = 0.7) -> DataFrame:
    """Adds ``text`` (the main text; empty if there is none) and ``n_chars`` (its code points) to the pages.

    ``html_column`` and columns named like the results are replaced; all other columns stay as they
    are. One row per input row, repeated ones too. A null or empty page has an empty text. Pages are
    parsed whole, one at a time, so memory is bounded by the largest page. No shuffle.
    """
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = ["\n\n".join(main_blocks(h.as_py(), sigma, share)) for h in part.column(n)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(n)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*kept, "text", "n_chars"],
                )

    rows = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(html_column).alias("__html"))
    return rows.mapInArrow(run, f"{schema}{', ' if kept else ''}text string, n_chars long")
