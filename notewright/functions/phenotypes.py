"""Phenotype strings, label sets and model answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions.text import col, let, trim_u

STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(STRINGS)


def list_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast(STRINGS), no_strings())


def is_no_phenotype(c: Column | str) -> Column:
    return trim_u(c).isin(*V.NO_PHENOTYPE)


def split_phenotypes(c: Column | str) -> Column:
    """Items of a phenotype string, neither trimmed nor deduplicated; none for null."""
    c = col(c)
    marks = V.PHENOTYPE_SEPARATORS
    items = F.filter(F.split(F.translate(c, marks, ";" * len(marks)), ";"), lambda x: x != "")
    return F.when(c.isNull() | is_no_phenotype(c), no_strings()).otherwise(items)


def row_phenotypes(fields: Column | str) -> Column:
    """Phenotypes of a report row given as a list; they sit in its second field."""
    return split_phenotypes(F.try_element_at(col(fields), F.lit(2)))


def first_elements(nested: Column | str) -> Column:
    """The first element of every inner list; null for an empty one."""
    return F.transform(col(nested), lambda x: F.try_element_at(x, F.lit(1)))


def second_elements(nested: Column | str) -> Column:
    """Distinct second elements of the inner lists that have one."""
    has_two = F.filter(col(nested), lambda x: F.size(x) >= 2)
    return F.array_distinct(F.transform(has_two, lambda x: F.element_at(x, 2)))


def union_lists(*lists: Column | str) -> Column:
    """Distinct non-null values of all lists; the empty list for none."""
    if not lists:
        return no_strings()
    # leaving out null also removes repeats
    return F.array_except(F.concat(*[list_or_empty(x) for x in lists]), F.lit([None]).cast(STRINGS))


def default_labels(labels: Column | str, keys: tuple[str, ...] = V.TRUTH_KEYS) -> Column:
    """A label struct with every list present."""
    labels = col(labels)
    return F.struct(*[list_or_empty(labels[k]).alias(k) for k in keys])


def _first_per_id(structs: Column) -> Column:
    ids = F.transform(structs, lambda s: s["hpo_id"])
    return let(ids, lambda known: F.filter(structs, lambda s, i: F.array_position(known, s["hpo_id"]) == i + 1))


def parse_annotations(response: Column | str) -> Column:
    """Rows of a model answer: code fences dropped, malformed JSON gives no rows.

    Inner lists become structs; repeats of an id keep the first.
    """
    body = trim_u(F.regexp_replace(col(response), r"(?s)^\s*```[a-zA-Z]*\s*\n?|\n?\s*```\s*$", ""))
    rows = F.filter(F.from_json(body, "array<array<string>>"), lambda r: F.size(r) >= 1)
    structs = F.transform(
        rows,
        lambda r: F.struct(
            *[F.try_element_at(r, F.lit(i + 1)).alias(n) for i, n in enumerate(("hpo_id", "name_en", "name_zh", "mention"))]
        ),
    )
    firsts = let(structs, _first_per_id)
    return F.coalesce(firsts, F.array().cast("array<struct<hpo_id:string,name_en:string,name_zh:string,mention:string>>"))
