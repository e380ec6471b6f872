"""Main text of web pages by the distribution of text over their lines.

Markup is stripped so that every block (paragraph, heading, list item, cell, ...) becomes a
line, and every edge of a container (division, section, list, ...) an empty one. A line
weighs as many code points as it has, or nothing if it is link text for the most part or
stands in an element that by its name, role, class or id is no article: menus, headers,
footers, sidebars, notices, adverts, forms, comments. Weights are summed over sliding windows
of ``WINDOW`` lines. The text surges where the sum rises to the page's threshold, and dives
where it falls to zero; the lines between a surge and its dive are kept. Two container edges
side by side are a dive, so a short notice beside the article is judged by itself.

Where a page marks its article (``article``, ``main``, or the like), lines outside weigh nothing
and the threshold inside is one code point, so short paragraphs and titles stay.

Defined results: NULL and empty pages, and pages without main text, give the empty text.
Character references are decoded, white space (as Python's ``str.split`` has it) inside a
block becomes one space, blocks are joined by an empty line. Unclosed and wrongly nested
tags are closed as far as browsers would. Nothing is cut off: very long pages are read whole.
Each row is judged by itself, so ties and repeated rows give equal texts.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lines of a window.
WINDOW = 2
# A region surges at this share of the page's heaviest window, and needs this many code points.
SURGE_SHARE = 0.2
SURGE_LEAST = 25
# A line is link text from this share on.
LINK_SHARE = 0.6

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "address article aside blockquote body center details dialog dir div dl fieldset figure footer"
    " form header hgroup html main menu nav ol section table tbody tfoot thead ul".split()
)
LINES = frozenset(
    "caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li option p pre summary td th tr".split()
)
# Contents that are never text of the page.
UNSEEN = frozenset(
    "audio canvas head iframe math noscript object script select style svg template textarea"
    " title video button".split()
)
# Elements that are no article.
ASIDES = frozenset("aside dialog footer form header menu nav".split())
# A start tag of the first kind ends an open element of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search"
    " toolbar".split()
)
# Words of a class or id that name what is no article, and those that name it.
ASIDE_WORDS = re.compile(
    r"ad(s|vert\w*|slot|unit|box|sbygoogle)?\d*|alert|announcement|aside|banner|breadcrumbs?|"
    r"comments?|commentlist|consent|cookies?|copyright|disclaimer|disqus|foot|footer|gdpr|header|"
    r"login|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|notification|pager|"
    r"pagination|popup|promos?|promotion|rail|recommend\w*|related|replies|respond|search|share|"
    r"sharing|side|sidebar|signup|social|sponsor\w*|subscribe|subscription|toc|toolbar|topbar|widgets?"
)
ARTICLE_WORDS = frozenset("article body content entry main post story text page wrapper container".split())
STATE_WORDS = frozenset("has is no not with without js".split())
# A heading that opens the readers' comments.
COMMENTS = re.compile(
    r"\W*\d*\W*(reader |user )?(comments?|commentaires?|comentarios?|kommentare?|replies|responses|"
    r"leave a (comment|reply))\b.{0,20}",
    re.IGNORECASE,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _names_aside(name: str, in_article: bool) -> bool:
    """Whether a class or id, like ``site-header`` or ``cookieNotice``, names what is no article.

    The header of an article, like ``entry-header``, holds its title and is part of it.
    """
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-").split("-")
    if words[0] in STATE_WORDS or ARTICLE_WORDS.intersection(words[-1:]):
        return False
    if in_article or words[0] in ARTICLE_WORDS:
        words = [w for w in words if w != "header"]
    return any(map(ASIDE_WORDS.fullmatch, words))


def _marks_article(tag: str, attributes: dict[str, str]) -> bool:
    return (
        tag in ("article", "main")
        or attributes.get("role") in ("main", "article")
        or attributes.get("itemprop") == "articleBody"
    )


class _Line:
    """A block's text, and where it stands."""

    __slots__ = ("text", "article", "heading", "weight")

    def __init__(self, text: str, linked: int, aside: bool, article: int, heading: str):
        self.text, self.article, self.heading = text, article, heading
        own = sum(map(len, text.split()))
        links = linked >= LINK_SHARE * own and not heading
        self.weight = 0 if aside or links else len(text)


class _Lines(HTMLParser):
    """The lines of a page, with empty ones at the edges of containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        # Of each marked article, whether it is the page's main part, which may hold more.
        self.articles: list[bool] = []
        # Open elements: (tag, unseen, aside, article, link).
        self.open: list[tuple[str, bool, bool, int, bool]] = [("", False, False, 0, False)]
        self.parts: list[str] = []
        self.linked = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` outside foreign elements is a comment up to the next ``>``."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, _, aside, article, _ = self.open[-1]
            heading = next((e[0] for e in self.open if e[0] in HEADINGS), "")
            self.lines.append(_Line(text, self.linked, aside, article, heading))
        self.parts, self.linked = [], 0

    def _edge(self) -> None:
        self.lines.append(_Line("", 0, False, 0, ""))

    def _close(self, at: int) -> None:
        """End the open elements from ``at`` on."""
        if any(e[0] in CONTAINERS or e[0] in LINES for e in self.open[at:]):
            self._end_line()
        for tag, *_ in self.open[at:]:
            if tag in CONTAINERS:
                self._edge()
        del self.open[at:]

    def _close_implied(self, tag: str) -> None:
        ended, limit = IMPLIED.get(tag, ({"p"}, CONTAINERS | LINES - {"p"}))
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in ended:
                self._close(at)
                break
            if self.open[at][0] in limit:
                break
        if tag in IMPLIED:
            self._close_open_paragraph()

    def _close_open_paragraph(self) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == "p":
                self._close(at)
                break
            if self.open[at][0] in CONTAINERS or self.open[at][0] in LINES:
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        block = tag in CONTAINERS or tag in LINES
        if block:
            self._close_implied(tag)
            self._end_line()
        if tag in CONTAINERS:
            self._edge()
        if tag in VOID:
            return
        _, unseen, aside, article, link = self.open[-1]
        attributes = {k: v or "" for k, v in attrs}
        if _marks_article(tag, attributes):
            # The innermost mark counts, unless it stands in an aside, like a reader's comment.
            if not aside or tag == "main":
                self.articles.append(tag == "main" or attributes.get("role") == "main")
                article, aside = len(self.articles), False
        elif not aside and tag not in ("html", "body"):
            aside = self._is_aside(tag, attributes, article)
        hidden = "hidden" in attributes or re.search(r"display:\s*none", attributes.get("style", ""))
        self.open.append(
            (tag, unseen or tag in UNSEEN or bool(hidden), aside, article, link or tag == "a")
        )

    def _is_aside(self, tag: str, attributes: dict[str, str], article: int) -> bool:
        if tag == "header" and article:
            return False
        if tag in ASIDES or attributes.get("role") in ROLES:
            return True
        if tag in HEADINGS:
            return False
        names = attributes.get("class", "").split() + attributes.get("id", "").split()
        return any(_names_aside(name, bool(article)) for name in names)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # Browsers ignore the slash of "<p/>".
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        block = tag in CONTAINERS or tag in LINES
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == tag:
                self._close(at)
                return
            # An inline end tag does not close blocks, nor a line's end tag containers.
            if name in CONTAINERS and tag not in CONTAINERS or not block and name in LINES:
                return

    def handle_data(self, data: str) -> None:
        _, unseen, _, _, link = self.open[-1]
        if unseen:
            return
        self.parts.append(data)
        if link:
            self.linked += sum(map(len, data.split()))

    def finish(self) -> None:
        self.close()
        self._close(1)
        self._end_line()


def _marked_article(lines: list[_Line], main_parts: list[bool]) -> list[int]:
    """Weights with those outside the marked article of most text as 0; empty if none has text.

    An article counts twice against text of the main part beside it. The page's title,
    a first-level heading before an article that has none, is part of it.
    """
    totals: dict[int, int] = {}
    for line in lines:
        if line.article:
            times = 1 if main_parts[line.article - 1] else 2
            totals[line.article] = totals.get(line.article, 0) + times * line.weight
    best = max(totals, key=totals.__getitem__, default=0)
    if not totals.get(best):
        return []
    weights = [line.weight if line.article == best else 0 for line in lines]
    first = next(i for i, w in enumerate(weights) if w)
    if not any(line.heading == "h1" for line, w in zip(lines, weights, strict=True) if w):
        titles = [i for i in range(first) if lines[i].heading == "h1" and lines[i].weight]
        for i in titles[-1:]:
            weights[i] = lines[i].weight
    return weights


def _regions(weights: list[int], threshold: float) -> list[tuple[int, int]]:
    """Stretches of lines from a surge of the windows' sums to the next dive."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    regions, i = [], 0
    while i < len(sums):
        if sums[i] == 0:
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end] > 0:
            end += 1
        if max(sums[i:end]) >= threshold:
            regions.append((i, end))
        i = end
    return regions


def _without_comments(lines: list[_Line]) -> list[_Line]:
    """The lines before a heading that opens the readers' comments, if text precedes it."""
    for i, line in enumerate(lines):
        if line.heading and COMMENTS.fullmatch(line.text) and any(x.weight for x in lines[:i]):
            return lines[:i]
    return lines


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    # A tag that the page's end cuts off is no text.
    parser.feed(re.sub(r"<[/!?a-zA-Z][^<>]*$", "", html))
    parser.finish()
    lines = _without_comments(parser.lines)
    threshold = 1.0
    weights = _marked_article(lines, parser.articles)
    if not weights:
        weights = [line.weight for line in lines]
        heaviest = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
        threshold = max(SURGE_LEAST, SURGE_SHARE * heaviest)
    kept = [
        lines[i].text
        for start, end in _regions(weights, threshold)
        for i in range(start, end)
        if weights[i]
    ]
    return "\n\n".join(kept)


@F.pandas_udf(T.StringType())
def _main_texts(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def main_text_of(html: Column) -> Column:
    """The main text of a column of pages."""
    return _main_texts(html.cast("string"))


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """All columns of ``pages`` and the main text; a column named ``into`` is replaced."""
    others = [F.col(f"`{c}`") for c in pages.columns if c != into]
    return pages.select(*others, main_text_of(F.col(f"`{html}`")).alias(into))
