"""HTML extraction: parser events to block lines, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard parser's events are cut into *lines*, one per block element (headings, paragraphs, list items, cells,
...). A line knows its text, the number of tags met in it, the share of its text inside links, and the container it
stands in. Text-to-tag ratios of all candidate lines are smoothed with a Gaussian along the page, and the smoothed ratios are
split into two clusters by an iterated threshold (the middle of both means; means that differ by less than a factor are one cluster). Lines over the threshold form content
regions. Where the page marks articles (or a main part), every one that holds a content region is taken, with
all its candidate lines, so that short paragraphs and list items between long ones stay; elsewhere the regions
themselves are the text, with the lines between the first and the last of them that are not mostly links.

Which lines are candidates is one more input: lines in elements that by their tag, role or class are no content (menus,
headers, also that of an article, footers, asides, forms, scripts, styles, adverts, notices, comments) are none. A class or id
counts by its words, unless it negates or only states something ("no-sidebar", "comments-open"), and never on an element
that is or holds the page's article or main part.

A link counts as such only when its end is met: an unclosed one does not make the rest of the page link text.

Defined results: null and empty pages, and pages without candidate lines, give an empty text; unclosed and stray tags
are tolerated (an unclosed paragraph ends at the next block); articles come in page order; rows are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "nav header footer aside form script style noscript template head title button select option textarea iframe object svg canvas menu dialog".split()
)
#: Words of class, id and role that mark a container as no content.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that make a class a statement about the page and not a name of the box.
NEGATIONS = frozenset("no not has have with without hide is".split())
STATES = frozenset("open opened closed enabled disabled allowed visible on off none".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SIGMA = 1.0
RADIUS = 2
APART = 2.0
LINK_SHARE = 0.8


def names_no_content(said: str) -> bool:
    """Whether a class or id attribute names a box that holds no content."""
    for name in said.lower().replace("_", "-").split():
        parts = [p for p in name.split("-") if p]
        if parts and parts[0] not in NEGATIONS and parts[-1] not in STATES and not MARKS.isdisjoint(parts):
            return True
    return False


class Lines(HTMLParser):
    """Collects [text, tags, characters by link, container, excluding element] per block line.

    Elements that are excluded by their names alone are numbered, as an article met inside takes the exclusion back.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, dict[int, int], int, int]] = []
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, excluded, container, excluded by name in this element (0: none)
        self.kinds: list[str] = ["body"]  # of containers
        self.parts: list[str] = []
        self.tags = 0
        self.link_chars: dict[int, int] = {}
        self.links = self.named = 0
        self.open_links: list[tuple[int, int]] = []  # link, depth of the stack
        self.closed_links: set[int] = set()
        self.taken_back: set[int] = set()

    def state(self) -> tuple[bool, int, int]:
        return self.stack[-1][1:] if self.stack else (False, 0, 0)

    def close_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        excluded, container, named = self.state()
        if text and not excluded:
            self.lines.append((text, self.tags, self.link_chars, container, named))
        self.parts.clear()
        self.tags = 0
        self.link_chars = {}

    @property
    def rows(self) -> list[tuple[str, int, int, int]]:
        """(text, tags, characters in closed links, container) of the candidate lines."""
        return [
            (text, tags, sum(n for link, n in links.items() if link in self.closed_links), container)
            for text, tags, links, container, named in self.lines
            if not named or named in self.taken_back
        ]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.close_line()
            # An open paragraph ends here, with what is open in it.
            depth = len(self.stack) - 1
            while depth >= 0 and self.stack[depth][0] not in BLOCKS:
                depth -= 1
            if depth >= 0 and self.stack[depth][0] == "p":
                self.cut(depth)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        excluded, container, named = self.state()
        attributes = dict(attrs)
        inside = tag in NEVER or "hidden" in attributes or (attributes.get("role") or "").lower() in ROLES
        by_name = names_no_content(f"{attributes.get('class') or ''} {attributes.get('id') or ''}")
        if tag in ("article", "main") and not excluded:
            comment = tag == "article" and (inside or by_name)
            outer = [open_named for *_, open_named in self.stack if open_named]
            # A box that holds the first article or main part is no comment box, whatever its class says.
            if not comment and len(self.kinds) == 1:
                self.taken_back.update(outer)
            # A nested article belongs to the outer one.
            if self.kinds[container] != "article" and not comment:
                self.kinds.append(tag)
                container = len(self.kinds) - 1
        if tag in ("html", "body", "main"):
            inside = by_name = False
        if by_name and not excluded and not inside and not (named and named not in self.taken_back):
            self.named += 1
            named = self.named
        if tag == "a":
            self.open_links.clear()  # links do not nest; one that is still open was never closed
            self.links += 1
            self.open_links.append((self.links, len(self.stack)))
        self.stack.append((tag, excluded or inside, container, named))

    def cut(self, depth: int) -> None:
        """Close the elements from ``depth`` on; links left open in them are over, unclosed."""
        del self.stack[depth:]
        while self.open_links and self.open_links[-1][1] >= depth:
            self.open_links.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.close_line()
        self.tags += 1
        if tag == "a" and self.open_links:
            self.closed_links.add(self.open_links.pop()[0])
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.cut(depth)
                break
            if self.stack[depth][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                break  # a stray end tag closes nothing outside the content container

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.parts.append(data)
        if self.open_links:
            link = self.open_links[-1][0]
            self.link_chars[link] = self.link_chars.get(link, 0) + len(data)


def smooth(values: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(radius + 1)]
    out = []
    for i in range(len(values)):
        weight = total = 0.0
        for j in range(max(0, i - radius), min(len(values), i + radius + 1)):
            k = kernel[abs(i - j)]
            weight += k
            total += k * values[j]
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Middle of the means of the two clusters that it separates itself; where these differ by less than ``APART`` times, all values are over it."""
    cut = sum(values) / len(values)
    for _ in range(100):
        low = [v for v in values if v < cut]
        high = [v for v in values if v >= cut]
        if not low or not high:
            return min(values)
        mean_low, mean_high = sum(low) / len(low), sum(high) / len(high)
        moved = (mean_low + mean_high) / 2
        if abs(moved - cut) < 1e-9:
            return cut if mean_high >= APART * mean_low else min(values)
        cut = moved
    return cut


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.close_line()
    rows = parser.rows
    if not rows:
        return ""
    smoothed = smooth([len(text) / max(1, tags) for text, tags, _, _ in rows])
    cut = threshold(smoothed)
    content = [v >= cut and links < LINK_SHARE * len(text) for v, (text, _, links, _) in zip(smoothed, rows, strict=True)]
    size: dict[int, int] = {}
    for chosen, (text, _, _, container) in zip(content, rows, strict=True):
        if chosen:
            size[container] = size.get(container, 0) + len(text)
    marked = {c for c in size if parser.kinds[c] == "article"} or {c for c in size if parser.kinds[c] == "main"}
    if not marked and not size:
        # No line stands out; what the page marks decides.
        present = {container for *_, container in rows if parser.kinds[container] != "body"}
        marked = {c for c in present if parser.kinds[c] == "article"} or present
    if marked:
        kept = [text for text, _, _, container in rows if container in marked]
    else:
        inside = [i for i, chosen in enumerate(content) if chosen]
        if not inside:
            return ""
        kept = [text for i, (text, _, links, _) in enumerate(rows) if inside[0] <= i <= inside[-1] and links < LINK_SHARE * len(text)]
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars in place of the html."""
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*others, "text", "n_chars"]
            )

    rows = pages.select(*others, F.col(html_col).cast("string").alias("_html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_html")
    return rows.mapInArrow(extract, f"{schema}text string, n_chars long")
