"""Main-text extraction from HTML (operator 2).

A streaming parser (standard library) turns a page into lines: runs of text between block-level
tags, each with its count of tags. Lines have a text-to-tag ratio; the ratios are smoothed with a
Gaussian and lines at or above their standard deviation form the content clusters, which choose the
regions: the articles that hold clustered text, and main as a whole if it has some outside articles; where
none of it is in either, the smallest block that holds all of it, which is never a paragraph, a heading
or an inline element. An article without any is left out, and a page without clusters has no text. Within a region every line stays, however short, except what is marked up as
navigation, header, footer, sidebar, notice, advert, form, script, style or readers' comments.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEED = 1 << 16

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template svg math iframe object canvas audio video head title nav footer aside form button select textarea datalist dialog menu".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset(("article", "main"))
#: What a whole text may be in, where a page has none of these.
BLOCKS = frozenset("html body div section center".split())
#: Elements that an open paragraph outside isn't closed from.
P_BOUNDS = CONTAINERS | {"table", "div", "section", "blockquote", "li", "td"}
#: An open element that a start tag closes, with the elements that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_UNWANTED = re.compile(
    r"(?:.*[-_])?(?:ads?|advert(?:s|ising|isements?)?|adsense|banner|promo(?:tion)?|sponsor(?:ed|s)?|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|signup|"
    r"sidebar|side-?bar|rail|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|topbar|footer|comments?|disqus|respond|replies|reply|related|recommended|"
    r"share|sharing|social|popup|modal|overlay|widget|toolbar|login|search|pagination|pager|skip-?link|copyright|disclaimer)(?:[-_].*)?",
    re.I,
)
_LAYOUT = re.compile(r"(?:has|with|no|without|is)[-_]", re.I)
_CONTENT = re.compile(r"(?:.*[-_])?(?:article|entry|post|story)[-_]?(?:header|title|body|content|text)?", re.I)


def _unwanted(tag: str, attrs, inside: bool) -> bool:
    """Whether an element is furniture by its tag, role, class or id."""
    if tag in DROPPED:
        return True
    if tag == "header" and not inside:
        return True
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value or tag in ("html", "body"):
            continue
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id"):
            for word in value.split():
                if _UNWANTED.fullmatch(word) and not _LAYOUT.match(word) and not (inside and _CONTENT.fullmatch(word)):
                    return True
    return False


class LineParser(HTMLParser):
    """Lines of a page: text, tags, characters in links, and the innermost element around it.

    Elements are numbered in page order from 1, so an element's descendants have the numbers that
    follow its own. The depths at which each tag is open are kept, so that no tag costs more on a deep page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tag, number of the element (0 inside furniture)
        self.depths: dict[str, list[int]] = {}
        self.skipped = 0  # depth of the outermost furniture element, or 0
        self.tag_of = [""]
        self.parent = [0]
        self.inside = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.tags = 0
        self.link_chars = 0
        self.links = 0
        self.at = 0

    def _break(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.link_chars, self.at))
            self.text = []
        self.tags = self.link_chars = 0

    def _push(self, tag: str, number: int):
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, number))

    def _pop_to(self, depth: int):
        """Close all from ``depth`` on; furniture and what is in it was never counted."""
        for n in range(len(self.open) - 1, depth - 1, -1):
            tag, number = self.open.pop()
            self.depths[tag].pop()
            if number and not (self.skipped and n >= self.skipped - 1):
                self.inside -= tag in CONTAINERS
                self.links -= tag == "a"

    def _innermost(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def _close_to(self, tags, stop):
        depth = self._innermost(tags)
        if depth > self._innermost(stop):
            self._pop_to(depth)

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            if tag not in VOID:
                self._push(tag, 0)
            return
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self._break()
            self.tags += 1
            return
        if tag not in INLINE:
            self._break()
            self._close_to(("p",), P_BOUNDS)
            if tag in CLOSES:
                self._close_to(*CLOSES[tag])
        self.tags += 1
        self.parent.append(self.open[-1][1] if self.open else 0)
        self.tag_of.append(tag)
        self._push(tag, len(self.tag_of) - 1)
        if _unwanted(tag, attrs, bool(self.inside)):
            self.skipped = len(self.open)
        elif tag in CONTAINERS:
            self.inside += 1
        elif tag == "a":
            self.links += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = self._innermost((tag,))
        if depth < 0:
            return
        if self.skipped:
            if depth < self.skipped - 1 and (tag in INLINE or tag == "p"):
                return
            ends_furniture = depth < self.skipped
            if depth >= self.skipped - 1:
                self._pop_to(depth)
                self.skipped = 0 if ends_furniture else self.skipped
                return
            self._pop_to(self.skipped - 1)
            self.skipped = 0
        if tag not in INLINE:
            self._break()
        self.tags += 1
        self._pop_to(depth)

    def handle_data(self, data):
        if self.skipped:
            return
        if not self.text or not self.at:
            self.at = self.open[-1][1] if self.open else 0
        self.text.append(data)
        if self.links:
            self.link_chars += len(data)

    def finish(self):
        self.close()
        self._break()
        return self.lines


def smoothed(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing with a standard deviation of ``radius`` lines, renormalised at the ends."""
    import numpy as np

    x = np.asarray(values, float)
    offsets = np.arange(-2 * radius, 2 * radius + 1)
    kernel = np.exp(-(offsets**2) / (2 * radius**2))
    total = np.convolve(x, kernel)[2 * radius : 2 * radius + len(x)]
    weight = np.convolve(np.ones_like(x), kernel)[2 * radius : 2 * radius + len(x)]
    return (total / weight).tolist()


def main_text(html: str | None) -> str:
    """The main text of a page: lines of its content regions joined by newlines.

    Of nested blocks that hold the same clustered text the innermost is the region; regions with equal
    weight are all kept, so there are no ties to settle.
    """
    if not html:
        return ""
    parser = LineParser()
    for at in range(0, len(html), FEED):
        parser.feed(html[at : at + FEED])
    lines = parser.finish()
    if not lines:
        return ""
    ratios = [len(text) / max(1, tags) for text, tags, _, _ in lines]
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    threshold = min((sum((v - mean) ** 2 for v in smooth) / len(smooth)) ** 0.5, max(smooth))
    clustered = [v > 0 and v >= threshold for v in smooth]
    content = [c and link <= len(text) / 2 for c, (text, _, link, _) in zip(clustered, lines)]
    content = content if any(content) else clustered  # a page of links
    if not any(content):
        return ""
    count = len(parser.tag_of)
    # clustered text, that outside articles, and the last element inside
    weight, free, last = [0] * count, [0] * count, list(range(count))
    for chosen, (text, _, _, at) in zip(content, lines):
        weight[at] += len(text) if chosen else 0
        free[at] = weight[at]
    for n in range(count - 1, 0, -1):  # children before parents
        up = parser.parent[n]
        weight[up] += weight[n]
        free[up] += free[n] if parser.tag_of[n] != "article" else 0
        last[up] = max(last[up], last[n])
    marked = [n for n in range(1, count) if parser.tag_of[n] in CONTAINERS and (weight if parser.tag_of[n] == "article" else free)[n]]
    if marked:
        kept, end = bytearray(count), 0
        for n in marked:
            if n > end:
                end = last[n]
                kept[n : end + 1] = b"\1" * (end + 1 - n)
        return "\n".join(text for text, _, _, at in lines if kept[at])
    region = max((n for n in range(1, count) if weight[n] == weight[0] and parser.tag_of[n] in BLOCKS), default=0)
    return "\n".join(text for chosen, (text, _, link, at) in zip(content, lines) if region <= at <= last[region] and (chosen or link <= 0.8 * len(text)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row, from its whole html.

    A null html is empty and so is its text; ids and urls may be null; repeated rows get a
    row each; an empty table gives none; other columns are ignored.
    """

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        extract, "page_id long, url string, text string, n_chars long"
    )
