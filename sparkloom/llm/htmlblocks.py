"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one a block element.  A line weighs the length of
its text apart from links; lines inside menus, headers, footers, sidebars, forms,
adverts, notices and comments weigh nothing.  Inside an article or main element
links count as text and a line weighs ``SURGE`` more, and regions set apart there
are cut out.  Sums of the weights over a sliding window of ``WINDOW`` lines show
where text is: it surges where the sum rises from zero and dives where it falls
back to zero.  A stretch between surge and dive is kept if some window of it
passes ``SURGE`` characters (or the highest of the page, if none does).  If such
stretches lie inside an article or main element, those outside are not the
article and go.

Pages are scanned once; broken ones, with unclosed tags, quotes or elements,
too: what failed to close is remembered and not looked for again.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import free_name

WINDOW = 3
SURGE = 60

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, forms' fields included.
_RAW = frozenset("script style title textarea iframe template svg select button noframes xmp".split())
#: Of these, what never closes runs to the end of the page.
_TO_THE_END = frozenset("script style title textarea xmp".split())
_ASIDE = frozenset("nav header footer aside form menu dialog".split())
_ROOTS = frozenset(("article", "main"))
_WHOLE = frozenset(("html", "body"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|commentary|disqus|replies|reply|respond)(?:$|[_-])", re.I)
#: Names in class, id or role that mark what isn't the article.
_NAMED = re.compile(
    _COMMENTS.pattern + r"|(?:^|[_-])(?:ads?|adverts?|advertisement|advertising|adsense|adbox|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|"
    r"newsletter|subscribe|subscription|signup|login|popup|modal|overlay|sidebar|menu|menubar|nav|navbar|navigation|"
    r"breadcrumbs?|pagination|pager|footer|header|masthead|topbar|contentinfo|complementary)(?:$|[_-])",
    re.I,
)
#: Names such as ``no-sidebar`` tell of an element beside or away.
_ABOUT = re.compile(r"(?:no|has|with|without|hide|is)[_-]", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOPS = re.compile(r"[>\"']")
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}


@dataclass(slots=True)
class Tag:
    """A tag or, with an empty name, the end of the page; ``low`` to ``high`` is
    the text before it.  ``end`` is the tag where the element ends, ``closed``
    whether by its own end tag."""

    name: str
    closing: bool
    attributes: str
    low: int
    high: int
    end: int = 0
    closed: bool = False


@dataclass(slots=True)
class Line:
    text: str
    weight: int
    in_root: bool
    apart: bool


class _Scanner:
    """The tags of a page in one pass."""

    def __init__(self, page: str):
        self.page, self.last_mark = page, page.rfind(">")
        self.odd: set[int] = set()
        self.absent: set[str] = set()

    def _after_tag(self, at: int) -> int:
        """Behind the ``>`` that ends the tag; ``>`` in quotes ends none, unless
        the quotes never balance.  Quotes on a way that failed are remembered."""
        page, way, here = self.page, [], at
        while stop := _STOPS.search(page, here):
            here = stop.end()
            if stop[0] == ">":
                return here
            if stop.start() in self.odd:
                break
            way.append(stop.start())
            close = page.find(stop[0], here)
            here = close + 1 if close >= 0 else here
        self.odd.update(way)
        return page.find(">", at) + 1

    def _after_raw(self, name: str, at: int) -> int:
        """Behind the end tag of an element whose content is no text."""
        found = None if name in self.absent else _CLOSERS[name].search(self.page, at)
        if found:
            return self.page.find(">", found.end()) + 1 or len(self.page)
        self.absent.add(name)
        return len(self.page) if name in _TO_THE_END else at

    def tags(self) -> list[Tag]:
        page, out, low, at = self.page, [], 0, 0
        while 0 <= (at := page.find("<", at)) < self.last_mark:
            kind = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                close = page.find("-->", at + 4)
                after = close + 3 if close >= 0 else len(page)
                out.append(Tag("!", True, "", low, at))
            elif kind in ("!", "?"):
                after = page.find(">", at) + 1
                out.append(Tag("!", True, "", low, at))
            elif name := _NAME.match(page, at + 1 + (kind == "/")):
                after = self._after_tag(name.end())
                attributes = page[name.end() : after - 1].strip()
                tag = Tag(name[0].lower(), kind == "/", attributes, low, at)
                out.append(tag)
                if tag.name in _RAW and not tag.closing and not attributes.endswith("/"):
                    after = self._after_raw(tag.name, after)
            elif kind == "/":
                after = page.find(">", at) + 1
                out.append(Tag("!", True, "", low, at))
            else:
                at += 1
                continue
            low = at = after
        if page.startswith("<!--", at) and at >= 0:
            out.append(Tag("", True, "", low, at))  # a comment that never ends
        else:
            out.append(Tag("", True, "", low, len(page)))
        return out


@dataclass(slots=True)
class _Frame:
    """An open block element and the inline elements opened in it."""

    tag: int
    name: str
    inline: list[int] = field(default_factory=list)
    open: dict[str, int] = field(default_factory=dict)


def _match(tags: list[Tag]) -> None:
    """Find where elements end.  An end tag ends the innermost open element of
    its name and all opened in it since; an inline one only within its block."""
    frames, blocks = [_Frame(-1, "")], {}
    for i, tag in enumerate(tags):
        name = tag.name
        if not name or name == "!" or name in _VOID or name in _RAW:
            continue
        top = frames[-1]
        if not tag.closing:
            if tag.attributes.endswith("/") and name not in _BLOCKS:
                tag.end, tag.closed = i, True
            elif name in _BLOCKS:
                frames.append(_Frame(i, name))
                blocks[name] = blocks.get(name, 0) + 1
            else:
                top.inline.append(i)
                top.open[name] = top.open.get(name, 0) + 1
        elif name in _BLOCKS:
            while blocks.get(name):
                gone = frames.pop()
                blocks[gone.name] -= 1
                for k in gone.inline:
                    tags[k].end = i
                tags[gone.tag].end = i
                if gone.name == name:
                    tags[gone.tag].closed = True
                    break
        elif top.open.get(name):
            while True:
                k = top.inline.pop()
                top.open[tags[k].name] -= 1
                tags[k].end = i
                if tags[k].name == name:
                    tags[k].closed = True
                    break
    for frame in frames:
        for k in [*frame.inline, frame.tag]:
            if k >= 0:
                tags[k].end = len(tags) - 1


@lru_cache(4096)
def _names(attributes: str) -> tuple[bool, tuple[str, ...]]:
    """Whether attributes hide an element, and the names that say what it is."""
    found = [n for groups in _ATTRIBUTE.findall(attributes) for n in " ".join(groups).split()]
    return bool(_HIDDEN.search(attributes)), tuple(n for n in found if not _ABOUT.match(n))


def _set_apart(name: str, attributes: str, in_root: bool) -> bool:
    if name in _WHOLE:
        return False
    hidden, names = _names(attributes) if attributes else (False, ())
    if hidden or any(map(_COMMENTS.search, names)):
        return True
    if name in _ROOTS:
        return False
    if name in _ASIDE and not (name == "header" and in_root):
        return True
    return any(_NAMED.search(n) and not (in_root and re.search("header$|^header", n, re.I)) for n in names)


def lines_of(page: str) -> list[Line]:
    """Lines of a page in order, with the weight of their text."""
    tags = _Scanner(page).tags()
    _match(tags)
    openings = [i for i, t in enumerate(tags) if t.name in _ROOTS and not t.closing and not _set_apart(t.name, t.attributes, False)]
    out: list[Line] = []
    text: list[str] = []
    linked = 0
    # Tags where what is open ends.
    roots: list[int] = []
    apart = cut = header = heading = link = -1

    def close(in_root: bool) -> None:
        nonlocal linked
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                weight = SURGE + len(line) if in_root else max(len(line) - linked, 0)
                out.append(Line(line, 0 if i <= apart else weight, in_root, i <= apart))
            text.clear()
        linked = 0

    for i, tag in enumerate(tags):
        if tag.high > tag.low and not (i <= cut or (i <= header and i > heading)):
            piece = page[tag.low : tag.high]
            text.append(piece)
            if i <= link:
                linked += len(piece)
        while roots and roots[-1] <= i:
            close(True)
            roots.pop()
            if not roots:
                out += [Line("", 0, False, True)] * WINDOW
        name = tag.name
        if not name:
            close(bool(roots))
            break
        if name == "!" or i < cut:
            continue
        if name in _BLOCKS:
            close(bool(roots))
        if tag.closing or name in _RAW:
            continue
        if name in _VOID:
            if name == "br":
                text.append(" ")
            continue
        if i >= apart and _set_apart(name, tag.attributes, bool(roots)):
            close(bool(roots))
            end = tag.end
            if not tag.closed:
                k = bisect_right(openings, i)
                end = min(end, openings[k]) if k < len(openings) else end
            if roots:
                cut = end
            else:
                apart = end
        elif i < apart:
            continue
        elif name in _ROOTS:
            if not roots:
                out += [Line("", 0, False, True)] * WINDOW
            roots.append(tag.end)
        elif name == "header":
            header = tag.end
        elif name in _HEADINGS:
            heading = tag.end
        elif name in ("td", "th"):
            text.append(" ")
        elif name == "a":
            link = tag.end
    return out


def stretches(weights: list[int]) -> list[tuple[int, int, int]]:
    """(first line, last line, highest window) of each stretch: from the line
    where the window sums rise from zero to the one before they are zero again."""
    out, total, start, last, most = [], 0, None, 0, 0
    for i, w in enumerate([*weights, *[0] * WINDOW]):
        total += w - (weights[i - WINDOW] if i >= WINDOW else 0)
        if w:
            start, last = (i if start is None else start), i
        if start is not None:
            most = max(most, total)
            if not total:
                out.append((start, last, most))
                start, most = None, 0
    return out


def main_text(page: str | None) -> str:
    """The article of a whole page: its blocks joined by line ends; empty if
    there is none.  Null counts as empty."""
    if not page:
        return ""
    lines = lines_of(page)
    found = stretches([line.weight for line in lines])
    least = min(SURGE, max((most for *_, most in found), default=0) - 1)
    found = [(a, b) for a, b, most in found if most > least]
    inside = [(a, b) for a, b in found if lines[a].in_root]
    return "\n".join(line.text for a, b in inside or found for line in lines[a : b + 1] if not line.apart)


_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


@F.pandas_udf(_TEXT)
def _extract(pages: pd.Series) -> pd.DataFrame:
    texts = [main_text(p) for p in pages]
    return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, html_col: str = "html", out: str = "main") -> DataFrame:
    """``pages`` with struct column ``out`` (text, n_chars); every other column
    and row is kept, repeated ones too; where a column has that name, the new one
    has underscores before it.  Of windows of equal height the stretches of all are kept.  An empty
    table stays empty."""
    return pages.withColumn(free_name(pages, out), _extract(F.col(html_col)))


def extract_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "main.text", "main.n_chars")
