"""Text expressions shared by every operator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything str.strip() treats as white space; Spark's trim only knows U+0020.
SPACE = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
# (?U) makes \s Unicode-aware but leaves out the four separator controls.
_CLASSES = {r"\s": r"[\s\x1c-\x1f]", r"\S": r"[^\s\x1c-\x1f]"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def trim_u(c: Column | str) -> Column:
    """Strip all Unicode white space from both ends."""
    return F.btrim(col(c), F.lit(SPACE))


def ltrim_u(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(SPACE))


def pattern(body: str, dotall: bool = False) -> str:
    """Java regex with Unicode classes and only \\n as a line end."""
    body = re.sub(r"\\[sS]", lambda m: _CLASSES[m.group()], body)
    return ("(?dsU)" if dotall else "(?dU)") + body


def remove(c: Column | str, body: str, repl: str = "", dotall: bool = False) -> Column:
    return F.regexp_replace(col(c), pattern(body, dotall), repl)


def drop_literal(c: Column | str, literal: str) -> Column:
    return F.replace(col(c), F.lit(literal), F.lit(""))


def zero_pad(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer values stay whole (lpad alone would cut them)."""
    c = col(c)
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def preview(c: Column | str, n: int, suffix: str = "...") -> Column:
    """The first n characters, with a suffix when something was cut."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def longer(c: Column | str, n: int) -> Column:
    """The value when it has more than n characters, else null."""
    c = col(c)
    return F.when(F.length(c) > n, c)


def missing_to(c: Column | str, default: str = "") -> Column:
    """Null and NaN, a missing number or its text, both count as missing."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("NaN")), F.lit(default))


def safe_name(c: Column | str) -> Column:
    """A value usable as a file or folder name on any platform."""
    x = trim_u(F.replace(col(c), F.lit("\ufeff"), F.lit("")))
    x = F.regexp_replace(x, r"[\x00-\x1f]", "")
    x = F.translate(x, '/\\:|?*"<>', "____")
    x = F.regexp_replace(x, "[ _]{2,}", "_")
    x = trim_u(F.btrim(trim_u(x), F.lit(".")))
    x = F.rtrim(x, F.lit(". "))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))


def disease_name(line: Column | str) -> Column:
    """Cut a disease line at its first bracket; full-width only when no ASCII one is there."""
    x = trim_u(line)
    cut = (
        F.when(F.contains(x, F.lit("(")), F.substring_index(x, "(", 1))
        .when(F.contains(x, F.lit("（")), F.substring_index(x, "（", 1))
        .otherwise(x)
    )
    return trim_u(cut)


def disease_key(disease_id: Column | str, name: Column | str) -> Column:
    return F.concat_ws("_", col(disease_id).cast("string"), safe_name(name))


def article_file(disease: Column | str, title: Column | str, disease_id: Column | str | None = None,
                 suffix: str = ".txt") -> Column:
    """File name of an article; site 1 (no id) also turns the title's spaces into underscores."""
    if disease_id is None:
        stem = F.concat_ws("_", safe_name(disease), safe_name(F.replace(col(title), F.lit(" "), F.lit("_"))))
    else:
        stem = F.concat_ws("_", col(disease_id).cast("string"), safe_name(disease), safe_name(title))
    return F.concat(stem, F.lit(suffix))


def disease_variants(name: Column | str) -> Column:
    """The name and its shortened forms, distinct, empty ones left out."""
    x = col(name)
    forms = F.array(
        x,
        F.when(x.endswith("型"), _drop_end(x, 1)),
        F.when(x.endswith("综合征"), _drop_end(x, 3)),
        F.when(x.endswith("综合征"), trim_u(F.replace(x, F.lit("综合征"), F.lit("")))),
        F.when(x.endswith("症"), _drop_end(x, 1)),
        F.regexp_replace(x, r"(?dU)\d+型$", ""),
    )
    return F.filter(F.array_distinct(F.array_compact(forms)), lambda v: v != "")


def _drop_end(x: Column, n: int) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - F.lit(n))


def render(template: str, slot: str, c: Column | str) -> Column:
    """Fill the one slot of a template."""
    head, tail = template.split(slot, 1)
    return F.concat(F.lit(head), col(c), F.lit(tail))
