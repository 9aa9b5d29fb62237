"""Reading fetched pages with column expressions.

A page is first brought into a regular form (``markup.canonical``), in which the tags of an
element carry its depth. Elements are then found by regular expressions inside the JVM, at
any depth. Functions of whole pages do this themselves; ``select_all``, ``select_first``,
``first_main``, ``anchors``, ``meta_contents`` and ``inner_text`` expect the regular form.
"""

from __future__ import annotations

from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions.markup import canonical
from notewright.functions.text import col, let, trim_u

BLOCK_TAGS = "div|li|ul|ol|h[1-6]|article|section|header|footer|nav|main|aside|table|tr|form|blockquote"
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}
HIDDEN = r"(?is)<head\b.*?</head\b[^>]*>"


# ---- patterns ----------------------------------------------------------------------------


def _closed(name: str, attributes: str = "") -> str:
    r"""Element of a name in the regular form: group 1 is its name, 2 its depth, 3 the inside."""
    return rf'(?is)<({name}) _d="(\d+)"{attributes}[^>]*>(.*?)</\1 _d="\2">'


def _class_test(value: str) -> str:
    return rf"(?=[^>]*\sclass\s*=\s*[\"'](?-i:{value})[\"'])"


@cache
def element_pattern(selector: str) -> str:
    """Pattern of one simple selector: ``tag``, ``.class``, ``[class*="x"]`` or ``tag[class*="x"]``."""
    tag, part = selector, None
    if '[class*="' in selector:
        tag, part = selector.removesuffix('"]').split('[class*="')
    any_tag = tag or "[a-z][a-z0-9]*"
    if part is not None:
        inside = "[^\"'>]*" + part + "[^\"'>]*"
        return _closed(any_tag, _class_test(inside))
    if selector.startswith("."):
        token = r"(?:[^\"'>]*\s)?" + selector[1:] + r"(?:\s[^\"'>]*)?"
        return _closed("[a-z][a-z0-9]*", _class_test(token))
    return _closed(selector)


def _group_pattern(tag: str, classes: list[str]) -> str:
    """First of a tag or any of several classes, in page order."""
    token = r"(?:[^\"'>]*\s)?(?:" + "|".join(classes) + r")(?:\s[^\"'>]*)?"
    return _closed(rf"(?:(?={tag}\b)|(?=[a-z][a-z0-9]*\b[^>]*\sclass\s*=\s*[\"'](?-i:{token})[\"']))[a-z][a-z0-9]*")


# ---- text ------------------------------------------------------------------------------------


def decode(c: Column) -> Column:
    for entity, value in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(value))
    return c


def inner_text(html: Column | str) -> Column:
    """Visible text: blocks on their own lines, a blank line around paragraphs."""
    x = F.regexp_replace(col(html), HIDDEN, "")
    x = F.regexp_replace(x, r"[ \t\r\n\f]+", " ")
    x = F.regexp_replace(x, r"(?i)</?p\b[^>]*>", "\n\n")
    x = F.regexp_replace(x, rf"(?i)<br\b[^>]*>|</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    x = decode(F.regexp_replace(x, r"<[^>]*>", ""))
    x = F.regexp_replace(x, r" *\n *", "\n")
    return trim_u(F.regexp_replace(x, r"\n{3,}", "\n\n"))


# ---- elements ------------------------------------------------------------------------------


def select_all(html: Column | str, selector: str) -> Column:
    """Inside HTML of every element of a selector; a space in it means "inside of"."""
    outer, _, inner = selector.partition(" ")
    found = F.regexp_extract_all(col(html), F.lit(element_pattern(outer)), F.lit(3))
    if not inner:
        return found
    return F.flatten(
        F.transform(found, lambda h: F.regexp_extract_all(h, F.lit(element_pattern(inner)), F.lit(3)))
    )


def select_first(html: Column | str, selector: str) -> Column:
    """Inside HTML of the first element; empty when there is none."""
    if " " in selector:
        return F.coalesce(F.try_element_at(select_all(html, selector), F.lit(1)), F.lit(""))
    return F.regexp_extract(col(html), element_pattern(selector), 3)


def first_main(html: Column | str) -> Column:
    tag, *classes = V.MAIN_SELECTORS
    p = _group_pattern(tag, [c[1:] for c in classes])
    return F.regexp_extract(col(html), p, 3)


def attribute(tag: Column, name: str) -> Column:
    """An attribute of the first tag of a piece of HTML; null when absent or empty."""
    p = rf"(?is)^<[^>]*?\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    value = F.concat(F.regexp_extract(tag, p, 1), F.regexp_extract(tag, p, 2))
    return F.nullif(decode(value), F.lit(""))


def anchors(html: Column | str) -> Column:
    """All links in page order with href, onclick and text."""
    tags = F.regexp_extract_all(col(html), F.lit(r'(?is)<a _d="(\d+)"[^>]*>.*?</a _d="\1">'), F.lit(0))
    return F.transform(
        tags,
        lambda a: F.struct(
            attribute(a, "href").alias("href"), attribute(a, "onclick").alias("onclick"), inner_text(a).alias("text")
        ),
    )


def meta_contents(html: Column | str, names: tuple[str, ...]) -> Column:
    """Contents of meta tags with one of the names (or properties), in page order."""
    tags = F.regexp_extract_all(col(html), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    wanted = F.filter(
        tags, lambda m: F.coalesce(attribute(m, "name"), attribute(m, "property"), F.lit("")).isin(*names)
    )
    return F.array_compact(F.transform(wanted, lambda m: attribute(m, "content")))


# ---- fields of a page ---------------------------------------------------------------------------


def _first_over(texts: Column, n: int) -> Column:
    return F.try_element_at(F.filter(texts, lambda t: F.length(t) > n), F.lit(1))


def _pick(text: Column, n: int) -> Column:
    # through a one-element list, so that the text expression is evaluated once
    return F.try_element_at(F.filter(F.array(text), lambda t: F.length(t) > n), F.lit(1))


def page_title(html: Column | str) -> Column:
    """Title by selectors (more than 5 characters), then meta tags, then a fixed text."""
    html = canonical(html)
    picks = [_pick(inner_text(select_first(html, s)), V.LENGTHS["title"]) for s in V.TITLE_SELECTORS]
    meta = trim_u(F.try_element_at(meta_contents(html, V.TITLE_META), F.lit(1)))
    return F.coalesce(*picks, meta, F.lit(V.MISSING_TITLE))


def heading_title(html: Column | str, result_title: Column | str) -> Column:
    """The h1 cut to 200 characters, then the title of the result list, then a fixed text."""
    html = canonical(html)
    h1 = F.substring(inner_text(select_first(html, "h1")), 1, V.LENGTHS["page_title"])
    return F.coalesce(F.nullif(h1, F.lit("")), F.nullif(col(result_title), F.lit("")), F.lit(V.UNTITLED))


def site1_abstract(html: Column | str) -> Column:
    """First element over 50 characters by selector, then a line with the word for abstract."""
    html = canonical(html)
    n = V.LENGTHS["abstract"]
    picks = [
        _first_over(F.transform(select_all(html, s), lambda e: inner_text(e)), n) for s in V.ABSTRACT_SELECTORS["site1"]
    ]
    lines = F.filter(
        F.split(inner_text(html), "\n"),
        lambda line: F.contains(line, F.lit(V.ABSTRACT_WORD)) & (F.length(line) > V.LENGTHS["line"]),
    )
    return F.coalesce(*picks, trim_u(F.try_element_at(lines, F.lit(1))), F.lit(V.MISSING_ABSTRACT))


def keyword_abstract(text: Column) -> Column:
    """Text after a keyword up to the next blank line, over 50 characters; ``text`` is the visible text of the page."""
    n = V.LENGTHS["abstract"]
    picks = []
    for word in V.ABSTRACT_KEYWORDS:
        p = rf"(?isU){word}[\s\x1c-\x1f:：]*(.+?)(?:\n\n|$)"
        found = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda t: trim_u(t))
        picks.append(_first_over(found, n))
    return F.coalesce(*picks)


def site2_abstract(html: Column | str) -> Column:
    """Keyword text, then selectors, then meta tags, then the start of the main text."""
    html = canonical(html)
    n = V.LENGTHS["abstract"]
    picks = [_pick(inner_text(select_first(html, s)), n) for s in V.ABSTRACT_SELECTORS["site2"]]
    meta = trim_u(_first_over(meta_contents(html, V.ABSTRACT_META), n))
    main = F.transform(
        F.filter(F.array(inner_text(first_main(html))), lambda t: F.length(t) > V.LENGTHS["body"]),
        lambda t: F.when(
            F.length(t) > V.LENGTHS["body_cut"], F.concat(F.substring(t, 1, V.LENGTHS["body_cut"]), F.lit("..."))
        ).otherwise(t),
    )
    return F.coalesce(
        let(inner_text(html), keyword_abstract), *picks, meta, F.try_element_at(main, F.lit(1)), F.lit(V.MISSING_ABSTRACT)
    )


def page_abstract(html: Column | str, site: str = "site2") -> Column:
    return {"site1": site1_abstract, "site2": site2_abstract}[site](html)


def shows_no_results(html: Column | str, site: str = "site1") -> Column:
    """A page that says that nothing was found, by text or (site 1) by element class."""
    html = canonical(html)
    marks = [m.lower() for m in V.NO_RESULT_TEXTS[site]]
    said = let(F.lower(inner_text(html)), lambda t: reduce(or_, [F.contains(t, F.lit(m)) for m in marks]))
    if site != "site1":
        return said
    token = r"(?:[^\"'>]*\s)?(?:" + "|".join(V.NO_RESULT_CLASSES) + r")(?:\s[^\"'>]*)?"
    return said | F.regexp_like(col(html), F.lit(rf"(?i)<[a-z][^>]*\sclass\s*=\s*[\"'](?-i:{token})[\"']"))


def has_results(html: Column | str, site: str = "site1", legacy: bool = False) -> Column:
    """Whether a search page has results; ``legacy`` accepts every page of site 2."""
    if site == "site2" and legacy:
        return F.lit(True)
    return ~shows_no_results(html, site)


def is_pdf(content: Column | str, content_type: Column | str) -> Column:
    """A payload that starts as a PDF, says that it is one, or is larger than 2000 bytes."""
    content = col(content)
    starts = F.substring(content, 1, 4) == F.lit(b"%PDF")
    says = F.contains(F.lower(F.coalesce(col(content_type), F.lit(""))), F.lit("pdf"))
    return F.coalesce(starts, F.lit(False)) | says | F.coalesce(F.octet_length(content) > V.PDF_MIN_BYTES, F.lit(False))


# ---- links ------------------------------------------------------------------------------------------


def resolve_url(href: Column | str, base: Column | str | None = None, variant: str = "page") -> Column:
    """Absolute form of a link.

    Variants: ``results`` (host of site 1), ``direct`` (host of site 2, bare names get a
    scheme), ``page`` (relative to the page), ``detail`` (host of site 2). A scheme-less
    ``//host`` always gets https. ``results_legacy`` prefixes the host even then, and
    ``detail_legacy`` joins host and path without a slash.
    """
    h = trim_u(href)
    full = h.startswith("http")
    https = F.concat(F.lit("https:"), h)
    rest = F.ltrim(h, F.lit("/"))
    site1, site2 = F.lit(V.SITE1_HOST), F.lit(V.SITE2_HOST)
    if variant == "results_legacy":
        return F.when(full, h).when(h.startswith("/"), F.concat(site1, h)).otherwise(F.concat(site1, F.lit("/"), h))
    out = F.when(h.startswith("//"), https).when(full, h)
    if variant == "detail_legacy":
        return out.otherwise(F.concat(site2, h))
    if variant == "results":
        return out.otherwise(F.concat(site1, F.lit("/"), rest))
    if variant == "direct":
        return out.when(h.startswith("/"), F.concat(site2, h)).otherwise(F.concat(F.lit("https://"), h))
    if variant == "detail":
        return out.otherwise(F.concat(site2, F.lit("/"), rest))
    return out.otherwise(F.concat(F.rtrim(col(base), F.lit("/")), F.lit("/"), rest))


def onclick_target(onclick: Column) -> Column:
    """The address assigned in an onclick text, or the text itself."""
    found = F.regexp_extract(onclick, r"href\s*=\s*['\"]([^'\"]+)['\"]", 1)
    return F.coalesce(F.nullif(found, F.lit("")), onclick)


def pdf_links(html: Column | str, by_text: bool = False) -> Column:
    """Links to PDF files; ``by_text`` also takes links whose text says so (and then wants a lower-case suffix)."""
    html = canonical(html)
    links = anchors(html)

    def wanted(a: Column) -> Column:
        if not by_text:
            return F.contains(F.lower(a["href"]), F.lit(".pdf"))
        said = reduce(or_, [F.contains(F.lower(a["text"]), F.lit(m)) for m in V.PDF_MARKS])
        return a["href"].isNotNull() & (F.contains(a["href"], F.lit(".pdf")) | said)

    return F.transform(F.filter(links, lambda a: F.coalesce(wanted(a), F.lit(False))), lambda a: a["href"])


def frame_pdf_links(html: Column | str) -> Column:
    html = canonical(html)
    tags = F.regexp_extract_all(col(html), F.lit(r"(?is)<i?frame\b[^>]*>"), F.lit(0))
    links = F.transform(tags, lambda t: attribute(t, "src"))
    return F.filter(links, lambda u: F.contains(F.lower(u), F.lit(".pdf")))


def is_content_link(text: Column) -> Column:
    """Link text that looks like a title and not like site navigation."""
    low, high = V.LINK_TEXT_BAND
    noise = reduce(or_, [F.contains(text, F.lit(w)) for w in V.LINK_NOISE])
    return F.length(text).between(low, high) & ~noise
