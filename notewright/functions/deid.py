"""De-identification rules for clinical notes, one expression per rule.

All rules run inside the JVM. Only the optional name extractor of
``person_names`` needs Python workers, over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright import fixed_values as V
from notewright.functions.text import col, drop_literal, remove, trim_u


def blank_to_empty(c: Column | str) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    return F.when(trim_u(c) == "", F.lit("")).otherwise(c)


def request_form(c: Column | str) -> Column:
    return drop_literal(c, V.REQUEST_FORM)


def newborn_header(c: Column | str) -> Column:
    return remove(c, V.NEWBORN_HEADER, dotall=True)


def name_block(c: Column | str) -> Column:
    return remove(c, V.NAME_BLOCK)


def phones(c: Column | str) -> Column:
    return remove(c, V.PHONES)


def father_block(c: Column | str) -> Column:
    return remove(c, V.FATHER, dotall=True)


def mother_block(c: Column | str) -> Column:
    return remove(c, V.MOTHER)


def operators(c: Column | str) -> Column:
    return remove(c, V.OPERATOR)


def guidance(c: Column | str) -> Column:
    return remove(c, V.GUIDANCE)


def recorder(c: Column | str) -> Column:
    return remove(c, V.RECORDER)


def physician(c: Column | str) -> Column:
    return remove(c, V.PHYSICIAN)


def signature_label(c: Column | str) -> Column:
    return remove(c, V.SIGNATURE_LABEL)


def usable_names(names: Column | str) -> Column:
    """Trimmed, distinct names of two or more characters, longest first, ties by name."""
    kept = F.filter(
        F.transform(col(names), lambda n: trim_u(n)), lambda n: F.length(n) >= V.MIN_NAME_LENGTH
    )
    keyed = F.transform(F.array_distinct(kept), lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda s: s["n"])


def drop_names(c: Column | str, names: Column | str) -> Column:
    """Remove every name everywhere, longest first, so no short name splits a longer one."""
    ordered = F.coalesce(usable_names(names), F.array().cast("array<string>"))
    return F.aggregate(ordered, col(c), lambda text, n: F.replace(text, n, F.lit("")))


def double_commas(c: Column | str) -> Column:
    return remove(c, V.DOUBLE_COMMA, "，")


def wide_gaps(c: Column | str) -> Column:
    return remove(c, V.WIDE_GAP, " ")


def blank_lines(c: Column | str) -> Column:
    return trim_u(remove(c, V.BLANK_LINES, "\n\n"))


# Rules that run before names are looked for, and after they were removed.
STRUCTURE_RULES = {
    "d01": request_form,
    "d02": newborn_header,
    "d03": name_block,
    "d04": phones,
    "d05a": father_block,
    "d05b": mother_block,
    "d06": operators,
    "d07": guidance,
    "d08": recorder,
    "d09": physician,
    "d10": signature_label,
}
CLEANUP_RULES = {"d12": double_commas, "d13": wide_gaps, "d14": blank_lines}


def structured(c: Column | str) -> Column:
    """All rules for fixed structures, in order; the text names are looked for in."""
    c = blank_to_empty(c)
    for rule in STRUCTURE_RULES.values():
        c = rule(c)
    return c


def deidentify(c: Column | str, names: Column | str | None = None) -> Column:
    c = structured(c)
    if names is not None:
        c = drop_names(c, names)
    for rule in CLEANUP_RULES.values():
        c = rule(c)
    return c


def person_names(c: Column | str, load: Callable[[], Callable[[list[str]], list[list[str]]]]) -> Column:
    """Names found by a caller's model.

    ``load`` runs once per Python worker and returns a function from a batch of
    texts to their name lists. Blank texts give an empty list and never reach it.
    """

    shortest = V.MIN_NAME_LENGTH

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            texts = batch.fillna("")
            out = pd.Series([[] for _ in range(len(texts))], index=texts.index, dtype=object)
            filled = texts[texts.str.strip() != ""]
            if len(filled):
                for at, found in zip(filled.index, model(filled.tolist()), strict=True):
                    kept = {n.strip() for n in found}
                    out.at[at] = sorted(n for n in kept if len(n) >= shortest)
            yield out

    return extract(col(c))
