"""Fill-in-the-middle transformation of texts: a text's units are cut into prefix, middle and suffix and put in another order.

``regexp_count`` gives the number n of units. Two cuts from the row's hash make a pattern of the row's own,
``(unit{a})(unit{b - a})(rest)``, whose possessive quantifiers take exactly so many units without looking back. One match
of it, by ``regexp_replace``, captures the three parts and writes them in the form's order with its marks. Only DataFrame
functions are used, and every row is worked on alone, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import free_name


@dataclass(frozen=True)
class Settings:
    unit: str = r"[^\n]*+\n|[^\n]++"  # a line with its end, or what is left without one
    seed: int = 7
    percent: int = 100  # of the texts are transformed
    spm_percent: int = 50  # of these put the suffix first
    prefix: str = "<P>"
    middle: str = "<M>"
    suffix: str = "<S>"

    @property
    def marks(self) -> list[str]:
        return [self.prefix, self.middle, self.suffix]


def draw(doc_id: Column, which: int, s: Settings) -> Column:
    """The ``which``-th (from 0) of eight numbers of 32 bits that seed and id give; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * which + 1, 8), 16, 10).cast("long")


def cut(text: Column, n: Column, doc_id: Column, s: Settings) -> tuple[Column, Column]:
    """How many units the prefix holds, and how many prefix and middle hold together."""
    first, second = (F.pmod(draw(doc_id, k, s), n + 1) for k in (0, 1))
    return F.least(first, second), F.greatest(first, second)


def form_of(text: Column, doc_id: Column, s: Settings) -> Column:
    """``plain`` for texts that are empty, hold a mark or are not drawn; else ``spm`` or ``psm``."""
    marked = F.lit(False)
    for mark in s.marks:
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (F.pmod(draw(doc_id, 2, s), F.lit(100)) >= s.percent)
    return F.when(plain, "plain").when(F.pmod(draw(doc_id, 3, s), F.lit(100)) < s.spm_percent, "spm").otherwise("psm")


def output(text: Column, form: Column, a: Column, b: Column, s: Settings) -> Column:
    """The text in its form, by one match of the row's own pattern."""
    some = lambda n: F.concat(F.lit(f"((?:{s.unit}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), some(a), some(b - a), F.lit(r"((?s:.*+))\z"))
    # marks are letters to the replacement, whatever they are made of
    p, m, x = ("".join(f"\\{c}" if c in "\\$" else c for c in mark) for mark in s.marks)
    order = F.when(form == "spm", f"{x}$3{p}$1{m}$2").otherwise(f"{p}$1{x}$3{m}$2")
    return F.when(form == "plain", text).otherwise(F.regexp_replace(text, pattern, order))


def parts(out: Column, form: Column, s: Settings) -> Column:
    """Prefix, middle and suffix as a struct, read from the output alone; null where the form is plain."""
    # a mark can't arise where a part meets a mark: all marks begin alike, and no part holds one
    between = lambda after, before: F.substring_index(F.substring_index(out, before, 1), after, -1) if before else F.substring_index(out, after, -1)
    spm = form == "spm"
    return F.when(form != "plain", F.struct(
        F.when(spm, between(s.prefix, s.middle)).otherwise(between(s.prefix, s.suffix)).alias("prefix"),
        between(s.middle, "").alias("middle"),
        F.when(spm, between(s.suffix, s.prefix)).otherwise(between(s.suffix, s.middle)).alias("suffix")))


def restored(out: Column, form: Column, s: Settings = Settings()) -> Column:
    """The text that an output of a form stands for."""
    p = parts(out, form, s)
    return F.when(form == "plain", out).otherwise(F.concat(p["prefix"], p["middle"], p["suffix"]))


def transform(df: DataFrame, text: str = "text", doc_id: str = "doc_id", result: str = "infill", s: Settings = Settings()) -> DataFrame:
    """Adds ``result``, a struct of n (units), form, prefix_chars, middle_chars (code points, null if plain) and output.

    A null text counts as empty and stays plain with no units; so does a text that holds a mark, with its units counted.
    A null id draws like an empty one. Rows that repeat an id are cut alike, each by its own text. A column named like the
    result is replaced, no other is touched; an empty table gives an empty result.
    """
    if len({m[0] for m in s.marks}) != 1 or any(m[0] in m[1:] for m in s.marks) or len(set(s.marks)) != 3:
        raise ValueError("marks must differ, begin with one character and hold it nowhere else")
    work = free_name(df, "_infill")
    t, of = F.coalesce(F.col(text), F.lit("")), lambda name: F.col(f"{work}.{name}")
    counted = df.withColumn(work, F.struct(t.alias("text"), F.regexp_count(t, F.lit(s.unit)).cast("long").alias("n"), form_of(t, F.col(doc_id), s).alias("form")))
    a, b = cut(of("text"), of("n"), F.col(doc_id), s)
    done = counted.withColumn(work, F.struct(of("n").alias("n"), of("form").alias("form"), output(of("text"), of("form"), a, b, s).alias("output")))
    p = parts(of("output"), of("form"), s)
    return done.withColumn(result, F.struct(
        of("n").alias("n"), of("form").alias("form"), F.length(p["prefix"]).cast("long").alias("prefix_chars"),
        F.length(p["middle"]).cast("long").alias("middle_chars"), of("output").alias("output"))).drop(work)
