"""Main text of web pages: text-to-tag ratios, smoothed and thresholded.

The standard library's parser streams a page as events. Text is collected in lines, one per block
element, each with its characters, its tags and how many characters stand in links. Lines inside
elements that never hold the article (nav, header outside the article, footer, aside, form, script,
..., or a class, id or role that says menu, advert, notice, comments, ... as a whole name, unless a name
alone says so and the article is inside) are dropped as they come, and when the page marks its article (article, main), so are lines outside it. Over the lines
left, the ratio of text to tags is smoothed with a Gaussian kernel and split from the rest by a
threshold on the spread of the ratios. Inside a marked article every line is content; elsewhere
content is what the threshold keeps, and lines between kept lines that are not mostly links.

Null and empty pages give an empty text. Markup is never capped: an unclosed element ends with the
one that contains it.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from .common import derived

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea option iframe object svg canvas dialog menu map audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
SELF = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: A class or id that is one of these, alone or with one of the words that go with it before or after.
NAMES = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|top|bottom|global|primary|secondary|left|right|social|cookie|mobile|user|reader)[_-]+)*"
    r"(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|"
    r"footer|header|masthead|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|"
    r"comments?|disqus|replies|respond|related|recommended|pagination|pager|toolbar|skip|hidden|copyright|legal|tags)"
    r"(?:[_-]+(?:list|box|container|wrapper|section|area|bar|block|links?|buttons?|form|menu|items?|slot|unit|banner|widget|notice|posts|articles|stories|nav|content|inner|[0-9]+))*(?=$|\s)",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Lines of a page: (text, tags, characters in links, whether inside a marked article)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, article, dropped for its name alone
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.dropped = self.articles = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, self.articles > 0))
            self.tags = 0
        self.parts, self.linked = [], 0

    def pop(self) -> None:
        tag, dropped, article, _ = self.open.pop()
        if tag not in INLINE:
            self.flush()
        self.dropped -= dropped
        self.articles -= article
        self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += not self.dropped
        if tag == "br":
            self.parts.append(" ")
        if tag == "body":  # an unclosed head ends here
            while self.open and self.open[-1][0] != "html":
                self.pop()
        if tag in CLOSES_P or tag in SELF:
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i][0]
                if name in SELF.get(tag, ()) or name == "p" and tag in CLOSES_P:
                    while len(self.open) > i:
                        self.pop()
                    break
                if name not in INLINE:
                    break
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        article = tag in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody"
        named = f"{a.get('class', '')} {a.get('id', '')}"
        dropped = tag in DROPPED or tag == "header" and not self.articles or a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
        by_name = not dropped and tag not in ("html", "body", "article", "main") and named != " " and bool(NAMES.search(named))
        dropped = dropped or by_name
        if tag in ("article", "main") and self.dropped and not self.articles and all(x[3] for x in self.open if x[1]):
            self.open = [(name, False, inside, False) for name, _, inside, _ in self.open]  # a wrapper of the article, whatever its name
            self.dropped = 0
        self.open.append((tag, dropped, article, by_name))
        self.dropped += dropped
        self.articles += article
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.dropped
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self.pop()
                break
        if tag not in INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self.pop()
        self.flush()


def smoothed(values: list[float], radius: int = 2, sigma: float = 1.0) -> list[float]:
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    total = sum(kernel)
    n = len(values)
    return [sum(k * values[min(max(j + i - radius, 0), n - 1)] for i, k in enumerate(kernel)) / total for j in range(n)]


def main_text(html: str, threshold: float = 0.5) -> str:
    """Content lines of a page in its order, joined by newlines."""
    parser = Lines()
    tail = html.rfind("<")
    if tail >= 0 and ">" not in html[tail:] and re.match("[A-Za-z/!?]", html[tail + 1 : tail + 2]):
        html = html[:tail]  # a tag that the page's end cuts off
    parser.feed(html)
    parser.close()
    lines = [x for x in parser.lines if x[3]] or parser.lines
    if not lines:
        return ""
    if not lines[0][3]:
        ratios = smoothed([len(text) / max(tags, 1) for text, tags, _, _ in lines])
        mean = sum(ratios) / len(ratios)
        spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
        high = [r >= min(mean, threshold * spread) and 2 * linked <= len(text) for r, (text, _, linked, _) in zip(ratios, lines)]
        if any(high):
            first, last = high.index(True), len(high) - 1 - high[::-1].index(True)
            lines = [x for x in lines[first : last + 1] if 2 * x[2] <= len(x[0])]
    return "\n".join(x[0] for x in lines)


def extract(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """``pages`` without the html, with a column ``to``: the main text. A column of that name gives way."""

    def run(htmls: pa.Array) -> list[pa.Array]:
        return [pa.array([main_text(x.as_py()) if x.is_valid else "" for x in htmls], pa.string())]

    return derived(pages, html_col, (html_col,), {to: StringType()}, run)
