"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notewright.functions.text import SPACE
from notewright.plans.views import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BLANKS = " || ".join(f"chr({ord(c)})" for c in sorted(SPACE))


def query(name: str, sql: str | None = None):
    """Register a function of the inputs under a name, with its SQL counterpart if there is one."""

    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


# ---- fragments of DuckDB SQL ----------------------------------------------------------------


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_trim(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def sql_ltrim(x: str) -> str:
    return f"ltrim({x}, {_BLANKS})"


def sql_sub(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def sql_drop(x: str, *literals: str) -> str:
    for literal in literals:
        x = f"replace({x}, {q(literal)}, '')"
    return x


def sql_safe_name(x: str) -> str:
    x = sql_trim(f"replace({x}, chr(65279), '')")
    x = sql_sub(x, r"[\x00-\x1f]")
    for sign in "/\\:|":
        x = f"replace({x}, {q(sign)}, '_')"
    x = sql_drop(x, *'?*"<>')
    x = sql_trim(sql_sub(x, "[ _]{2,}", "_"))
    x = sql_trim(f"trim({x}, '.')")
    return f"coalesce(nullif(rtrim({x}, '. '), ''), 'unknown')"


def sql_disease_name(x: str) -> str:
    x = sql_trim(x)
    return sql_trim(
        f"case when contains({x}, '(') then split_part({x}, '(', 1) "
        f"when contains({x}, '（') then split_part({x}, '（', 1) else {x} end"
    )


def sql_text(html: str) -> str:
    """Visible text of HTML."""
    x = html
    for hidden in (r"<!--.*?-->", r"<script\b.*?</script\s*>", r"<style\b.*?</style\s*>", r"<head\b.*?</head\s*>"):
        x = sql_sub(x, f"(?is){hidden}")
    x = sql_sub(x, r"[ \t\r\n\f]+", " ")
    x = sql_sub(x, r"(?i)</?p\b[^>]*>", "\n\n")
    x = sql_sub(
        x,
        r"(?i)<br\b[^>]*>|</?(?:div|li|ul|ol|h[1-6]|article|section|header|footer|nav|main|aside|table|tr|form|blockquote)\b[^>]*>",
        "\n",
    )
    x = sql_sub(x, "<[^>]*>")
    for entity, value in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"),
                          ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{entity};', {q(value)})"
    x = sql_sub(x, r" *\n *", "\n")
    return sql_trim(sql_sub(x, r"\n{3,}", "\n\n"))


def sql_attr(tag: str, name: str) -> str:
    x = f"regexp_extract({tag}, {q(rf'''(?is)^<[^>]*?\s{name}\s*=\s*\"([^\"]*)\"''')}, 1)"
    return f"nullif(replace({x}, '&amp;', '&'), '')"


# All links of a page as structs.
def sql_anchors(html: str) -> str:
    return (
        f"list_transform(regexp_extract_all({html}, '(?is)<a\\b[^>]*>.*?</a\\s*>'), "
        f"lambda a: {{'href': {sql_attr('a', 'href')}, 'onclick': {sql_attr('a', 'onclick')}, 'text': {sql_text('a')}}})"
    )
