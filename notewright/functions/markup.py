"""Brings fetched HTML into a regular form in one pass over its tags.

Pages of the wild have unquoted attributes, ``>`` inside attribute values, character references of all kinds, and
elements that are never closed or are closed by others. In the regular form every attribute is quoted, values and
text hold no raw ``<`` or ``>`` of their own, all character references are decoded except those of markup
signs, every element is closed, and opening and closing tag carry the number of open elements of their name
(``_d``), so that a regular expression finds an element's end at any depth. Comments, scripts and styles go.
"""

from __future__ import annotations

import html as html_library
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.functions.text import col

DEPTH = "_d"
# References that text functions decode later, so that they stay as they are.
KEPT = frozenset(("&nbsp;", "&lt;", "&gt;", "&quot;", "&#39;", "&apos;", "&amp;"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 article section header footer nav main aside table tr form blockquote body html".split()
)
# An opening tag that ends an open element, up to the container that such elements stand in.
ENDS = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "dt": ("dl",), "dd": ("dl",), "a": ()}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<![^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _decoded(m: re.Match) -> str:
    if m[0] in KEPT:
        return m[0]
    text = html_library.unescape(m[0])
    if text == "\xa0":
        return "&nbsp;"
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;") if text != m[0] else text


def references(text: str) -> str:
    return _REFERENCE.sub(_decoded, text) if "&" in text else text


def regular(page: str) -> str:
    out: list[str] = []
    stack: list[str] = []
    depth: dict[str, int] = {}

    def close(name: str) -> None:
        """Closes open elements up to the last one of a name."""
        while stack:
            top = stack.pop()
            out.append(f'</{top} {DEPTH}="{depth[top]}">')
            depth[top] -= 1
            if top == name:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        out.append(references(page[at : m.start()]))
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if depth.get(name):
                close(name)
            continue
        if name in BLOCKS and depth.get("p"):
            close("p")
        if name in ENDS and depth.get(name):
            # only within the nearest container
            inside = next((x for x in reversed(stack) if x == name or x in ENDS[name]), None)
            if inside == name:
                close(name)
        attributes = []
        for a in _ATTRIBUTE.finditer(m[4]):
            key, value = a[1].lower(), next((v for v in (a[2], a[3], a[4]) if v is not None), "")
            if key != DEPTH:
                value = references(value).replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
                attributes.append(f' {key}="{value}"')
        if name in VOID:
            out.append(f"<{name}{''.join(attributes)}>")
            continue
        depth[name] = depth.get(name, 0) + 1
        stack.append(name)
        out.append(f'<{name} {DEPTH}="{depth[name]}"{"".join(attributes)}>')
    out.append(references(page[at:]))
    close("")
    return "".join(out)


def strings(values: Iterable[str | None]) -> pa.Array:
    """Texts as they come, each put into the array's bytes at once, so that not all of them are held a second time."""
    data, ends, known = bytearray(), [0], []
    for v in values:
        known.append(v is not None)
        if v is not None:
            data += v.encode("utf-8")
        ends.append(len(data))
    buffers = [pa.py_buffer(np.array(ends, dtype=np.int32)), pa.py_buffer(data), pa.array(known, pa.bool_()).buffers()[1]]
    return pa.StringArray.from_buffers(len(known), *buffers)


@F.arrow_udf(T.StringType())
def _regular(pages: pa.Array) -> pa.Array:
    return strings(None if (page := p.as_py()) is None else regular(page) for p in pages)


def canonical(html: Column | str) -> Column:
    """The regular form of a page; pages that are in it already stay the same."""
    return _regular(col(html))
