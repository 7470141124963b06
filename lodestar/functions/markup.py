"""A scanner for HTML: one pass over a page, however broken, in time proportional to its length."""

from __future__ import annotations

import functools
import re
from collections.abc import Collection, Iterator
from typing import NamedTuple

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_UP_TO_QUOTE = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Piece(NamedTuple):
    """A stretch of a page. kind: `text` (with character references), `cdata` and `raw` (without), `open`, `close` or `single` (an element that closes itself)."""

    kind: str
    start: int
    end: int
    name: str = ""
    attrs: str = ""


@functools.lru_cache(64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I)


def pieces(page: str, raw: Collection[str] = ("script", "style")) -> Iterator[Piece]:
    """The texts and tags of `page` in order. What `raw` elements hold is one piece up to their end tag.

    Comments, declarations and instructions are left out; an open comment lasts to the end. A
    bracket that begins no tag, and a tag that is never closed, are text. Once a quote in a tag is
    found to have no end, quotes mean nothing in the rest of the page.
    """
    last, cdata_end, quoted = page.rfind(">"), page.rfind("]]>"), True
    at = look = 0
    while (here := page.find("<", look)) >= 0 and here <= last:
        kind, name, attrs, inner = "", "", "", None
        follows = page[here + 1 : here + 2]
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", here) and here < cdata_end:
            end = page.find("]]>", here) + 3
            kind, inner = "cdata", (here + 9, end - 3)
        elif follows and follows in "!?":
            end = page.find(">", here) + 1
        elif named := _NAME.match(page, here + 1 + (follows == "/")):
            name, end = named[0].lower(), 0
            if follows == "/":
                kind, end = "close", page.find(">", named.end()) + 1
            else:
                kind, look = "open", named.end()
                while quoted and not end:
                    look = _UP_TO_QUOTE.match(page, look).end()
                    if page[look : look + 1] == ">":
                        end = look + 1
                    else:
                        look = page.find(page[look], look + 1) + 1 if look < len(page) else 0
                        quoted = look > 0
                end = end or page.find(">", named.end()) + 1
                attrs = page[named.end() : end - 1]
                if attrs.endswith("/"):
                    kind = "single"
            if not end:
                break
        else:
            look = here + 1
            continue
        if here > at:
            yield Piece("text", at, here)
        if kind:
            yield Piece(kind, *(inner or (here, end)), name, attrs)
        at = look = end
        if kind == "open" and name in raw:
            close = _closing(name).search(page, at)
            if at < (close.start() if close else len(page)):
                yield Piece("raw", at, close.start() if close else len(page), name)
            at = look = close.start() if close else len(page)
    if at < len(page):
        yield Piece("text", at, len(page))


def attributes(attrs: str) -> Iterator[tuple[str, str]]:
    """(name, value) of a tag's attributes, names in lower case."""
    for m in _ATTRIBUTE.finditer(attrs):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""
