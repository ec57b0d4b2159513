"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped into lines, one a block element. A line weighs as much as it has characters outside links;
lines in page furniture (menus, forms, scripts, adverts, comments ...) weigh nothing. A form that holds most of the page's
text wraps the page and is no furniture. Words like ``related`` or ``share`` in the marked article only make a part furniture
if none of its lines is as long as the article's floor. Where the page marks its article
(``article``, ``main`` or their roles), each line of the marked part weighs as much as its long ones do, link
lists too, and other lines weigh a tenth, or nothing if that is not as much as the marked part's floor for a line.
Sums of weights over a sliding window of lines surge where the article begins and dive where it ends; all lines
but furniture between these points are the text, and headings right before them. On pages without marks, lines beside the
stretch belong to it if they lie in the element that holds its lines (a byline, a date, a last short paragraph). What counts as a surge is measured by
the middle line of each window, so that a single long line sets no floor for the others.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes end before the next tag unless they are quoted, so that a tag that is never closed isn't looked for to the end of the page.
_INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
_RAW = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object|title)\b(?:{_INSIDE}|[^<>]*)>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/<>]*)({_INSIDE})>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>")
_MARKS = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Class words that tell of a part elsewhere (``has-sidebar``) don't make their own element furniture.
_ELSEWHERE = re.compile(r"(?:^|(?<=\s))(?:has|no|not|with|without|is)[_-]\S+", re.I)
#: Words that make even an ``article`` a reader's comment.
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comment\w*|repl(?:y|ies)|respond|disqus\w*)(?=$|[\s_-])", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_MAY_HIDE = re.compile(r"hidden|none", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
#: Words of class, id or role that mark page furniture.
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|comment\w*|disqus\w*|respond|replies|reply|side-?bar\w*|"
    r"menu\w*|nav|navbar|navigation|breadcrumb\w*|pagination|pager|footer|foot|masthead|cookie\w*|consent|gdpr|notice\w*|alert|"
    r"popup|modal|overlay|newsletter|subscribe\w*|complementary|contentinfo|dialog)(?=$|[\s_-])",
    re.I,
)
#: Words that mark furniture outside the article, and short parts of it.
_PERHAPS = re.compile(r"(?:^|[\s_-])(?:signup|login|share|sharing|social\w*|related|recommend\w*|widget\w*|toolbar|search\w*|form)(?=$|[\s_-])", re.I)
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)
#: The page's own header; those of an article (``entry-header`` ...) hold its title.
_PAGE_HEADER = re.compile(r"(?:^|\s)(?:(?:site|top|global)[_-])?header(?=$|\s)", re.I)
_ARTICLE_MARK = re.compile(r"(?:^|\s)(?:main|article|articlebody)(?=$|\s)", re.I)
_DROPPED = frozenset("nav footer aside menu dialog button head select fieldset label legend".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot "
    "thead tr ul head".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TABLE = frozenset("table thead tbody tfoot tr".split())
#: Elements whose lines belong to the element around them.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header pre address blockquote figure figcaption".split())
_WHOLE = frozenset("body html form".split())
_CLOSES_P = _BLOCK - {"body", "html", "head"}
_ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}


@dataclass
class Line:
    text: str
    weight: int
    article: bool
    heading: bool
    furniture: bool
    home: int  # the element that holds the line's own one; negative if that is the whole page
    forms: tuple[int, ...]  # open forms
    perhaps: int  # the element of the article that may be furniture; 0 if none


class _Open(NamedTuple):
    name: str
    furniture: bool
    article: bool
    home: int
    forms: tuple[int, ...]
    perhaps: int


_PAGE = _Open("", False, False, -1, (), 0)


def _hidden(attrs: str) -> bool:
    """Whether the attributes hide their element: by name, as a class of its own, or by style."""
    if not _MAY_HIDE.search(attrs):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if (
            name == "hidden" and value != "false" or name == "aria-hidden" and value.strip() == "true"
            or name == "class" and "hidden" in value.split() or name == "style" and _UNSEEN.search(value)
        ):
            return True
    return False


def lines(page: str) -> list[Line]:
    """The page's text by block, with the weight of each."""
    page = _RAW.sub(" ", page)
    out: list[Line] = []
    buffer: list[str] = []
    stack: list[_Open] = []
    opened = 0
    linked = 0
    link = -1  # the number of open elements where the open link began
    heading = False

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                top = stack[-1] if stack else _PAGE
                weight = 0 if top.furniture else max(0, len(text) - linked)
                out.append(Line(text, 0 if 2 * linked > len(text) else weight, top.article, heading, top.furniture, top.home, top.forms, top.perhaps))
            buffer.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            buffer.append(text)
            if link >= 0:
                linked += len(text)

    at = 0
    for tag in _TAG.finditer(page):
        add(page[at : tag.start()])
        at = tag.end()
        closing, name, attrs = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        block = name in _BLOCK
        if block:
            flush()
        if name in ("br", "td", "th"):
            add(" ")
        if name == "a":
            link = len(stack) if not closing and _HREF.search(attrs) else -1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    if not block:
                        flush()
                    del stack[k:]
                    if k < link:  # a link that isn't closed ends with the element that holds it
                        link = -1
                    break
            if name[:1] == "h" and name[1:].isdigit():
                heading = False
            continue
        if block and stack and stack[-1].name == "p" and name in _CLOSES_P:
            stack.pop()
        if name in _ENDS_LIKE and stack and stack[-1].name in _ENDS_LIKE[name]:
            stack.pop()
        if link > len(stack):
            link = -1
        if name in _VOID:
            continue
        if block:
            heading = name[:1] == "h" and name[1:].isdigit()
        top = stack[-1] if stack else _PAGE
        article, perhaps = top.article, top.perhaps
        marks = " ".join(a or b or c for a, b, c in _MARKS.findall(attrs)) if attrs else ""
        main = name in ("article", "main") or bool(marks and block and _ARTICLE_MARK.search(marks))
        odd = name in _DROPPED or name == "header" and not article
        if not odd and attrs and name not in ("body", "html"):
            own = _ELSEWHERE.sub("", marks)
            if own and name != "form":
                odd = bool((_COMMENT if main else _FURNITURE).search(own))
                if not odd and not main and name not in _TABLE and _PERHAPS.search(own):
                    odd, perhaps = not article, perhaps or opened + 1
            odd = odd or _hidden(attrs) or not article and not main and bool(marks and _PAGE_HEADER.search(marks))
        aside = perhaps and not top.perhaps
        if block or odd or aside:
            if not block and (odd or aside):
                flush()
            opened += 1
            home = top.home if name in _LEAVES else -opened if name in _WHOLE else opened
            stack.append(_Open(name, top.furniture or odd, article or main, home, (*top.forms, opened) if name == "form" else top.forms, perhaps))
    add(page[at:])
    flush()
    return _settled(out)


def _settled(found: list[Line]) -> list[Line]:
    """``found`` with the lines of forms as furniture, but for forms that hold most of the page's text."""
    own: dict[int, int] = {}
    for line in found:
        for form in line.forms:
            own[form] = own.get(form, 0) + (0 if line.furniture else len(line.text))
    if own:
        total = sum(len(x.text) for x in found if not x.furniture)
        for line in found:
            if any(2 * own[f] <= total for f in line.forms):
                line.furniture, line.weight = True, 0
    return found


def _without_asides(found: list[Line], window: int, share: float) -> None:
    """Parts of the article that may be furniture are, if no line of them reaches the floor."""
    longest: dict[int, int] = {}
    for line in found:
        if line.perhaps:
            longest[line.perhaps] = max(longest.get(line.perhaps, 0), line.weight)
    if longest:
        sure = [x.weight for x in found if x.article and not x.furniture and not x.perhaps]
        floor = max(1.0, share * max(_middles(sure, window // 2), default=0))
        for line in found:
            if line.perhaps and longest[line.perhaps] < floor:
                line.furniture, line.weight = True, 0


def _middles(weights: list[int], half: int) -> list[int]:
    """The middle weight of the window around each line."""
    out = []
    for k in range(len(weights)):
        own = sorted(weights[max(0, k - half) : k + half + 1])
        out.append(own[(min(k, half) + min(len(weights) - 1 - k, half)) // 2])
    return out


def weights(found: list[Line], window: int, share: float) -> list[float]:
    """The weight of each line, by its text and by whether the page marks it as its article's."""
    marked = [max(x.weight, 1) for x in found if x.article and not x.furniture]
    if not any(x.article and x.weight for x in found):
        return [x.weight for x in found]
    high = max(_middles(marked, window // 2))
    other = lambda x: 0.1 * x.weight if 0.1 * x.weight >= share * high else 0
    return [0 if x.furniture else max(x.weight, high) if x.article else other(x) for x in found]


def between(weights: list[float], window: int, share: float) -> tuple[int, int]:
    """First and last line of the stretch from the first surge to the last dive; (0, -1) if none."""
    half = window // 2
    sums = [sum(weights[max(0, k - half) : k + half + 1]) for k in range(len(weights))]
    floor = max(1.0, share * window * max(_middles(weights, half), default=0))
    over = [k for k, s in enumerate(sums) if s >= floor]
    if not over:
        return 0, -1
    first, last = over[0], over[-1]
    while first < last and not weights[first]:
        first += 1
    while last > first and not weights[last]:
        last -= 1
    return first, last


def main_text(page: str | None, window: int = 3, share: float = 0.2) -> str:
    """The article of a page, blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    found = lines(page)
    _without_asides(found, window, share)
    first, last = between(weights(found, window, share), window, share)
    while 0 < first <= last and found[first - 1].heading and not found[first - 1].furniture:
        first -= 1
    kept = [not x.furniture and first <= k <= last for k, x in enumerate(found)]
    if not any(x.article and x.weight for x in found):
        _beside(found, kept, first, last)
    return "\n".join(x.text for x, keep in zip(found, kept, strict=True) if keep)


def _beside(found: list[Line], kept: list[bool], first: int, last: int) -> None:
    """Keep the lines beside the stretch that share the element which holds its lines. Where that is the whole page, only
    those up to the next line elsewhere or of links, and no copyright line after it."""
    homes = {x.home for x, keep in zip(found, kept, strict=True) if keep and x.weight}
    for side in (range(first - 1, -1, -1), range(last + 1, len(found))):
        joined = True
        for k in side:
            line = found[k]
            if line.furniture:
                continue
            joined = joined and line.home in homes and line.weight > 0 and not (k > last and _RIGHTS.match(line.text))
            kept[k] = line.home in homes and (joined or line.home > 0)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, share: float = 0.2) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row's main text.

    A null page or one without text gives an empty text; ids and URLs pass through as they are, null too;
    repeated rows each give a row, equal pages equal texts; other columns are ignored; an empty table gives no rows. A page of any length is taken whole, in time in
    proportion to it. Pages are not shuffled.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), window, share) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")
