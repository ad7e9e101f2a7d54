"""A small tag walker for jobs that need nesting; runs in Arrow batches on the executors."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions.common import SPACES

# Executors receive this module with the function, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Element classes of HTML that matter for nesting.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search"
    " section summary table ul".split()
)
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
             "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = frozenset("ul ol table td th html body button".split())


class Element:
    __slots__ = ("tag", "raw", "parent", "start", "end", "last")

    def __init__(self, tag, raw, parent, start):
        self.tag, self.raw, self.parent, self.start = tag, raw, parent, start
        self.end = self.last = None

    def attribute(self, name: str) -> str | None:
        for key, value in _ATTRIBUTE.findall(self.raw):
            if key.lower() == name:
                return unescape(value[1:-1] if value[:1] in ("'", '"') else value)
        return None


def walk(html: str) -> tuple[list[Element], list[str]]:
    """Elements in document order and the text pieces their [start, end) ranges point into."""
    elements: list[Element] = []
    pieces: list[str] = []
    stack: list[int] = []

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            element = elements[stack.pop()]
            element.end, element.last = len(pieces), len(elements)

    def close_nearest(tags, barrier) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            tag = elements[stack[depth]].tag
            if tag in tags:
                return close_to(depth)
            if tag in barrier:
                return None
        return None

    at = 0
    for token in iter(lambda: _TOKEN.search(html, at), None):
        if token.start() > at:
            pieces.append(unescape(html[at : token.start()]))
        at = token.end()
        closing, name, raw = token.groups()
        if not name:
            continue
        tag = name.lower()
        if closing:
            close_nearest((tag,), ("td", "th") if tag not in ("table", "tr", "body", "html") else ())
            continue
        if tag in _ENDS_P:
            close_nearest(("p",), _SCOPE)
        if tag in _SIBLINGS:
            close_nearest(_SIBLINGS[tag], _SCOPE - {"td", "th"} if tag == "tr" else _SCOPE)
        element = Element(tag, raw, stack[-1] if stack else None, len(pieces))
        stack.append(len(elements))
        elements.append(element)
        if tag in _VOID:
            close_to(len(stack) - 1)
        elif tag in _RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(html, at)
            end = stop.start() if stop else len(html)
            body = html[at:end]
            pieces.append(body if tag in ("script", "style") else unescape(body))
            at = end
    if at < len(html):
        pieces.append(unescape(html[at:]))
    close_to(0)
    return elements, pieces


# Elements read as text blocks, and what marks an element as code.
_BLOCK = frozenset("p div span a h1 h2 h3 h4 h5 h6 li".split())
_CODE_TAGS = ("pre", "code")
_CODE_CLASSES = ("code", "language-", "highlight")

_BLOCKS_TYPE = pa.struct(
    [
        ("blocks", pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))),
        ("codes", pa.list_(pa.struct([("class", pa.string()), ("text", pa.string())]))),
    ]
)


_SPACES = SPACES
_ASCII = re.compile(r"[\x00-\x7f]")


def _blocks_of(html: str | None, first_only: bool) -> dict:
    """All blocks, or those up to the first that is not empty once cleaned (and no code)."""
    blocks, codes, is_code = [], [], []
    found = False
    elements, pieces = walk(html or "")
    for element in elements:
        names = element.attribute("class") or "" if "class" in element.raw.lower() else ""
        lowered = names.lower()
        code = element.tag in _CODE_TAGS or any(c in lowered for c in _CODE_CLASSES)
        is_code.append(code)
        if first_only and (found or code):
            continue
        if code:
            text = "".join(pieces[element.start : element.end])
            codes.append({"class": names, "text": text})
        elif element.tag in _BLOCK and not (
            element.parent is not None and is_code[element.parent]
        ):
            text = "".join(pieces[element.start : element.end])
            found = _ASCII.search(text.strip(_SPACES)) is not None
            blocks.append({"tag": element.tag, "text": text})
    return {"blocks": blocks, "codes": codes}


PAGES_AT_ONCE = 256  # pages whose results are held at the same time


def page_by_page(
    batches: Iterator[pa.Array], of: Callable[[str | None], object], kind: pa.DataType
) -> Iterator[pa.Array]:
    """``of`` each page; a batch may hold thousands, so results are sent back a few pages at a time."""
    for pages in batches:
        for at in range(0, len(pages), PAGES_AT_ONCE):
            yield pa.array([of(page.as_py()) for page in pages.slice(at, PAGES_AT_ONCE)], kind)


def page_blocks(html: Column | str, first_only: bool = False) -> Column:
    """Raw text blocks and code blocks of each page, in document order.

    ``first_only`` leaves out what comes after the first block with text, and all code, so that
    little is sent back for a page of which only the leading text is wanted.
    """

    @F.arrow_udf(
        "struct<blocks: array<struct<tag: string, text: string>>,"
        " codes: array<struct<class: string, text: string>>>"
    )
    def parse(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return page_by_page(pages, lambda page: _blocks_of(page, first_only), _BLOCKS_TYPE)

    return parse(html)


def _simple(selector: str):
    """Test for one simple selector: ``tag``, ``.class``, ``#id`` or a mix such as ``a.more``."""
    shape = re.fullmatch(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)", selector)
    if not shape:
        raise ValueError(f"unsupported selector: {selector!r}")
    tag = (shape[1] or "*").lower()
    marks = re.findall(r"([.#])([\w-]+)", shape[2])

    def matches(element: Element) -> bool:
        if tag not in ("*", element.tag):
            return False
        return all(
            value in (element.attribute("class") or "").split()
            if mark == "."
            else element.attribute("id") == value
            for mark, value in marks
        )

    return matches


def _matcher(selector: str):
    """Test for simple selectors separated by blanks, each inside the one before."""
    steps = [_simple(part) for part in selector.split()]
    if not steps:
        raise ValueError("empty selector")

    def matches(element: Element, elements: list[Element]) -> bool:
        if not steps[-1](element):
            return False
        left = len(steps) - 2
        while left >= 0 and element.parent is not None:
            element = elements[element.parent]
            left -= steps[left](element)
        return left < 0

    return matches


def records_column(html: Column, base: str, fields: list[dict]) -> Column:
    """Array of maps, one per element that matches ``base``.

    Each field has ``name``, ``selector`` and optionally ``attribute``; it takes the first match
    inside the base element, NULL when there is none.
    """
    is_base = _matcher(base)
    wanted = [(f["name"], _matcher(f["selector"]), f.get("attribute")) for f in fields]
    record_type = pa.list_(pa.map_(pa.string(), pa.string()))

    def value(element: Element, attribute: str | None, pieces: list[str]) -> str | None:
        if attribute:
            return element.attribute(attribute.lower())
        return "".join(pieces[element.start : element.end]).strip()

    def records_of(page: str | None) -> list[list[tuple[str, str | None]]]:
        elements, pieces = walk(page or "")
        records = []
        for index, element in enumerate(elements):
            if not is_base(element, elements):
                continue
            inside = elements[index + 1 : element.last]
            found = [
                (name, next((e for e in inside if matches(e, elements)), None), attribute)
                for name, matches, attribute in wanted
            ]
            records.append([(n, None if e is None else value(e, a, pieces)) for n, e, a in found])
        return records

    @F.arrow_udf("array<map<string, string>>")
    def extract(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return page_by_page(pages, records_of, record_type)

    return extract(html)
