"""Main text of web pages by tree scoring.

A page becomes a tree of elements and a list of blocks of text. Every block passes points for its length and its commas
to its parent, half of them to the grandparent and half again to each above; a container's points are discounted by the
share of its text that stands in links. The best container, or the article around it, is kept with those of its siblings that
score well. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out
by their tags, roles, classes and ids wherever they stand, but never an element that alone holds the page's article or
main, or most of the text outside links.

Reading and scoring take time in proportion to the page's length, whatever its markup: open elements are found by tag
without walking up, scores and marks are added up once from the leaves to the root, and after a quote that is never
closed tags end at the next ``>``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_IN_TAG = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var img br wbr".split()
)
_LEFT_OUT_TAGS = frozenset("nav footer aside form button select dialog menu head object canvas audio video".split())
_LEFT_OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split()
)
#: Words that mark what is not the article: a class or an id that consists of them, of words of place and of numbers.
_LEFT_OUT_WORD = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|newsletter|"
    r"subscri\w+|signup|login|sidebar\w*|rail|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|siteheader|"
    r"comments?|commentlist|disqus\w*|respond|replies|reactions|shar(?:e|ing)|social|related|recommended|popup|modal|"
    r"overlay|widget|pagination|pager|skip|toolbar|disclaimer)"
)
_PLACE_WORD = r"(?:site|page|main|header|top|bottom|left|right|global|primary|secondary|area|bar|block|box|body|items?|links?|lists?|buttons?|posts?|section|slot|unit)"
_LEFT_OUT_WORDS = re.compile(
    rf"(?<!\S)[_-]*(?:(?:{_PLACE_WORD}|\d+)[_-]+)*{_LEFT_OUT_WORD}\d*(?:[_-]+(?:{_LEFT_OUT_WORD}|{_PLACE_WORD}|\d+)\d*)*[_-]*(?!\S)".replace(r"\w", "[^\\W_]"), re.I
)
_OF_READERS = re.compile(r"(?<![^\W_])(?:comments?|commentlist|disqus\w*|respond|replies|reactions)(?![^\W\d_])", re.I)
_GOOD_WORDS = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
_CLOSED_BY = {  # a start tag of the key ends an open element of these
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_START_SCORES = {"article": 25, "main": 25, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "li": -3}


class _Page:
    """Elements as parallel lists, and blocks (text, element, link characters, innermost element).

    ``out`` is 0 for elements that are not marked to be left out, 1 for those marked by words or as a form, and 2 for
    the others. ``stack`` holds the open elements, ``solid`` the depths in it of those that are not inline, and ``open``
    the depths of each tag.
    """

    def __init__(self) -> None:
        self.tag, self.parent, self.out, self.words = ["#root"], [-1], [0], [""]
        self.blocks: list[tuple[str, int, int, int]] = []
        self.title = ""
        self.stack, self.solid = [0], [0]
        self.open: dict[str, list[int]] = {}
        self.run: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.run:
            text = " ".join(html.unescape("".join(self.run)).split())
            if text:
                self.blocks.append((text, self.stack[self.solid[-1]], self.linked, self.stack[-1]))
            self.run, self.linked = [], 0

    def pop_to(self, depth: int) -> None:
        if self.solid[-1] >= depth:
            self.flush()
        while self.solid[-1] >= depth:
            self.solid.pop()
        while len(self.stack) > depth:
            self.open[self.tag[self.stack.pop()]].pop()

    def depth_of(self, tags) -> int:
        """Depth of the innermost open element of the tags, 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.open.get(t))), default=0)

    def start(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE:
            self.flush()
            ended = _CLOSED_BY.get(tag, ())
            while True:
                paragraph = self.solid[-1] if self.tag[self.stack[self.solid[-1]]] == "p" else 0
                depth = self.depth_of(ended)
                depth = depth if depth > self.depth_of(_SCOPES.get(tag, ())) else 0
                if not (depth or paragraph):
                    break
                self.pop_to(max(depth, paragraph))
        found = {}
        if attributes.strip(" /\n\t\r"):
            for m in _ATTRIBUTE.finditer(attributes):
                if (name := m[1].lower()) in _ATTRIBUTES:
                    found.setdefault(name, (m[2] or "").strip("\"'"))
        words = f"{found.get('class', '')} {found.get('id', '')}"
        out = 0
        if (
            tag in _LEFT_OUT_TAGS
            and tag != "form"
            or found.get("role", "").lower() in _LEFT_OUT_ROLES - {"form"}
            or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
            or "display:none" in found.get("style", "").replace(" ", "").lower()
            or tag == "header" and not self.depth_of(("article", "main"))
        ):
            out = 2
        elif tag == "form" or found.get("role", "").lower() == "form":
            out = 1
        elif tag not in ("html", "body", "article", "main") and _LEFT_OUT_WORDS.search(words):
            out = 2 if _OF_READERS.search(words) else 1
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.out.append(out)
        self.words.append(words)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in _INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def end(self, tag: str) -> None:
        """Close the innermost element of the tag; an inline one only within its block."""
        depth = self.depth_of((tag,))
        if depth and (tag not in _INLINE or depth > self.solid[-1]):
            self.pop_to(depth)

    def text(self, piece: str) -> None:
        self.run.append(piece)
        if self.open.get("a"):
            self.linked += len(piece)


def _decide(page: _Page) -> list[bool]:
    """Whether each element is left out, by itself or with one around it; marks that would lose the article are taken back."""
    n = len(page.tag)
    mark = [-1] * n  # the innermost marked element, from each element up
    story = [-1] * n  # the innermost article or main
    hard, readers = [False] * n, [False] * n  # whether a mark of kind 2, or one of readers' comments, is among them
    for e in range(n):
        up = page.parent[e]
        if up >= 0:
            mark[e], story[e], hard[e], readers[e] = mark[up], story[up], hard[up], readers[up]
        if page.out[e]:
            mark[e] = e
            hard[e] = hard[e] or page.out[e] == 2
            readers[e] = readers[e] or bool(_OF_READERS.search(page.words[e]))
        if page.tag[e] in ("article", "main"):
            story[e] = e
    kept: set[int] = set()
    if any(page.out):
        plain = [(len(text) - 2 * link, own) for text, _, link, own in page.blocks if len(text) > 2 * link]
        if not any(story[own] >= 0 and mark[own] < 0 for _, own in plain):
            # no article in sight: marks above one go, but not those of readers' comments
            for _, own in plain:
                e = story[own]
                if e >= 0 and not page.out[e] and mark[own] == mark[e] and not readers[e]:
                    m = mark[e]
                    while m >= 0 and m not in kept:
                        kept.add(m)
                        m = mark[page.parent[m]]
            if not kept:
                held = [0] * n
                for size, own in plain:
                    if not hard[own]:
                        held[own] += size
                total = sum(held)
                for e in range(n - 1, 0, -1):
                    held[page.parent[e]] += held[e]
                kept = {e for e in range(n) if page.out[e] and 2 * held[e] > total}
    out = [False] * n
    for e in range(n):
        out[e] = page.parent[e] >= 0 and out[page.parent[e]] or page.out[e] > 0 and e not in kept
    return out


_CLOSERS: dict[str, re.Pattern] = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}


def _tag_end(source: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Where the tag that is open at ``at`` ends (0 if it does not), and whether quotes count from there on."""
    if quotes:
        if m := _IN_TAG.match(source, at):
            return m.end(), True
    end = source.find(">", at)
    return end + 1, False


def _parse(source: str) -> _Page:
    page, at, n, quotes = _Page(), 0, len(source), True
    last = source.rfind(">")
    while at < n:
        start = source.find("<", at)
        if start < 0 or start > last:
            page.text(source[at:])
            break
        if start > at:
            page.text(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        m = _NAME.match(source, start + 1)
        if not m:
            if source[start + 1 : start + 2] in ("!", "?", "/"):
                at = source.find(">", start) + 1
            else:
                page.text("<")
                at = start + 1
            continue
        at, quotes = _tag_end(source, m.end(), quotes)
        tag, attributes = m[2].lower(), source[m.end() : at - 1]
        if m[1]:
            page.end(tag)
        elif tag in _RAW:
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            close = _CLOSERS[tag].search(source, at)
            if tag == "title" and close and not page.title:
                page.title = " ".join(html.unescape(source[at : close.start()]).split())
            at = close.end() if close else n
        elif tag in _VOID:
            if tag in ("br", "wbr", "img"):
                page.run.append("\n" if tag == "br" else "")
            else:
                page.flush()
        else:
            page.start(tag, attributes)
    page.flush()
    return page


def _kept(page: _Page, out: list[bool]) -> set[int]:
    """Elements whose blocks are the article: the best container's and its good siblings'."""
    n = len(page.tag)
    points, length, linked, seen = [0.0] * n, [0] * n, [0] * n, [False] * n
    for text, at, link, own in page.blocks:
        if out[own]:
            continue
        to = at if page.tag[at] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") else page.parent[at]
        points[to] += 1 + text.count(",") + text.count("，") + len(text) / 100
        seen[to] = True
        length[at] += len(text)
        linked[at] += min(link, len(text))
    if not any(seen):
        return set()
    for e in range(n - 1, 0, -1):  # children stand behind their parents
        up = page.parent[e]
        points[up] += points[e] / 2
        length[up] += length[e]
        linked[up] += linked[e]
        seen[up] = seen[up] or seen[e]
    final = {}
    for e in range(n):
        if seen[e]:
            score = points[e] + _START_SCORES.get(page.tag[e], 0) + (10 if _GOOD_WORDS.search(page.words[e]) else 0)
            final[e] = score * (1 - linked[e] / max(length[e], 1))
    inner = [e for e in final if page.tag[e] not in ("#root", "html")] or list(final)
    best = max(inner, key=lambda e: (final[e], -e))
    around, up = best, best
    while up > 0:
        if page.tag[up] in ("article", "main"):
            around = up
        up = page.parent[up]
    kept = {around}
    if page.tag[around] == "article":  # an article may go on in the next one
        for e in range(1, n):
            if page.parent[e] == page.parent[around] and e != around and page.tag[e] in ("article", "section") and length[e]:
                if final.get(e, 0) >= max(10, 0.2 * final[best]) and linked[e] / length[e] < 0.25:
                    kept.add(e)
    if around == best and page.tag[best] not in ("article", "main", "body"):
        for e in range(1, n):
            if page.parent[e] == page.parent[best] and e != best and length[e]:
                clean = linked[e] / length[e] < 0.25
                if final.get(e, 0) >= max(10, 0.2 * final[best]) or clean and page.tag[e] in ("p", "h1", "h2", "h3", "blockquote", "pre"):
                    kept.add(e)
    return kept


def extract(source: str | None) -> tuple[str, str]:
    """Main text (blocks joined by one line feed) and title of a page; null and empty pages have neither.

    Very long pages are read whole, in time linear in their length.
    """
    if not source:
        return "", ""
    page = _parse(source)
    out = _decide(page)
    kept = _kept(page, out)
    inside = [False] * len(page.tag)
    for e in range(len(page.tag)):
        inside[e] = e in kept or page.parent[e] >= 0 and inside[page.parent[e]]
    return "\n".join(t for t, at, _, own in page.blocks if not out[own] and inside[at]), page.title


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html column, with ``text``, ``n_chars`` and ``title``. Other columns of these names are replaced.

    Pages are read each by itself, also if rows are repeated; a table without rows gives none.
    """
    rest = [c for c in pages.columns if c not in {html_col, "text", "n_chars", "title"}]
    made = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("title", T.StringType())]
    schema = T.StructType([*(pages.schema[c] for c in rest), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x) for x in batch.column(len(rest)).to_pylist()]
            text = [t for t, _ in found]
            columns = [
                *(batch.column(i) for i in range(len(rest))),
                pa.array(text, pa.string()),
                pa.array([len(t) for t in text], pa.int64()),
                pa.array([t for _, t in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*rest, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, schema)
