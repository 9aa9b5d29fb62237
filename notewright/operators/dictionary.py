"""Term dictionaries: building, lookup, validation and finding terms in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions.runs import EXACT, FiledTerms, RunFilter, all_runs
from notewright.functions.text import col, trim_u
from notewright.operators.scaling import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join, salted_join
from notewright.sources.scratch import settled

# Terms are looked up by runs of characters. Each kind of run is (length, stride): texts are
# opened at every stride-th place, and terms of at least length + stride - 1 characters can
# be found that way. Terms use the last kind that fits.
RUNS = ((1, 1), (2, 1), (3, 1), (4, 1), (6, 2), (8, 4))


def term_id(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.startswith(V.TERM_PREFIX), c).otherwise(F.concat(F.lit(V.TERM_PREFIX), c))


def term_dictionary(rows: DataFrame, legacy: bool = False) -> DataFrame:
    """``hpo_id`` to ``zh``, the last row of an id winning.

    Rows without a name are dropped; ``legacy`` keeps them under the name ``nan``.
    """
    if legacy:
        rows = rows.withColumn("zh", F.coalesce("zh", F.lit("nan")))
    rows = rows.where(F.col("hpo_id").isNotNull() & F.col("zh").isNotNull())
    return rows.groupBy(term_id("hpo_id").alias("hpo_id")).agg(F.max_by("zh", "row_no").alias("zh"))


def tagged_lines(df: DataFrame, text: str, key: str = "idx") -> DataFrame:
    """Term ids of tagger output: header skipped, then lines of two or more fields that start with an id."""
    lines = F.slice(F.split(F.col(text), "\n"), 2, F.greatest(F.size(F.split(F.col(text), "\n")) - 1, F.lit(0)))
    rows = df.select(key, F.posexplode(lines).alias("pos", "line")).where(trim_u("line") != "")
    fields = F.split("line", "\t")
    return (
        rows.where((F.size(fields) >= 2) & F.col("line").startswith(V.TERM_PREFIX))
        .select(key, "pos", fields[0].alias("hpo_id"))
    )


def translate_ids(extracted: DataFrame, dictionary: DataFrame, key: str = "idx") -> DataFrame:
    """Chinese names of extracted ids; misses and the placeholder are dropped, repeats stay."""
    usable = dictionary.where((F.col("zh") != V.NO_TRANSLATION) & (F.col("zh") != ""))
    return lookup_join(extracted, usable, ["hpo_id"], [key, "pos"])


def term_set(rows: DataFrame, term: str = "zh") -> DataFrame:
    return rows.where(F.col(term).isNotNull()).select(trim_u(term).alias("term")).distinct()


def validate_terms(df: DataFrame, terms: DataFrame, term: str = "term", spread: list[str | Column] | None = None) -> DataFrame:
    """Add ``is_standard`` and ``display``; with no standard terms at all, every term passes."""
    known = terms.select(F.col("term").alias("_trimmed"), F.lit(True).alias("_known"))
    keyed = df.withColumn("_trimmed", trim_u(term))
    joined = lookup_join(keyed, known, ["_trimmed"], spread or list(df.columns), "left")
    no_terms = terms.agg((F.count(F.lit(1)) == 0).alias("e")).scalar()
    standard = F.coalesce(F.col("_known"), no_terms)
    return (
        joined.withColumn("is_standard", standard)
        .withColumn("display", F.when(F.col("is_standard"), F.col(term)).otherwise(F.concat(F.lit("【"), F.col(term), F.lit("】"))))
        .drop("_trimmed", "_known")
    )


def _filed_terms(terms: DataFrame, term: str) -> DataFrame:
    """(term, _run, _earlier): terms with the runs they are looked up by, each with those that were listed before it.

    Of a term's runs these are the ``stride`` consecutive ones that fewest other terms share.
    """
    length, stride = (F.element_at(F.lit([kind[i] for kind in RUNS]), F.col("_kind") + 1) for i in (0, 1))
    sized = terms.select(term, stride.alias("_stride"), all_runs(F.col(term), length).alias("_runs"))
    opened = sized.select(term, "_stride", F.posexplode("_runs").alias("_at", "_run"))
    shared = opened.groupBy("_run").agg(F.count(F.lit(1)).alias("_shared"))
    # one short list per term: its runs in order, and how many terms share each
    listed = F.array_sort(F.collect_list(F.struct("_at", "_run", "_shared")))
    counted = salted_join(opened, shared, ["_run"], [term, "_at"]).groupBy(term, "_stride").agg(listed.alias("_list"))
    choices = F.transform(
        F.sequence(F.lit(1), F.size("_list") - F.col("_stride") + 1),
        lambda i: F.struct(F.array_max(F.transform(F.slice("_list", i, F.col("_stride")), lambda x: x["_shared"])).alias("cost"), i.alias("at")),
    )
    cut = F.slice("_list", F.array_min(choices)["at"], F.col("_stride"))
    chosen = counted.select(term, F.array_distinct(F.transform(cut, lambda x: x["_run"])).alias("_chosen"))
    return chosen.select(term, F.posexplode("_chosen").alias("_at", "_run"), "_chosen").select(
        term, "_run", F.slice("_chosen", F.lit(1), F.col("_at")).alias("_earlier"))


def find_terms(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str, max_rows: int = BROADCAST_ROWS,
               max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every pair ``(key, term)`` where the text contains the term, without comparing all pairs.

    Terms are filed by runs of characters that are as long as their length allows, and among those by the ones that
    fewest other terms share. A membership filter over these runs, whose size is bounded, goes to all tasks. Each text
    tests its runs at every ``stride``-th place against it in its own row and opens only what passes; of ``stride``
    consecutive runs of a term that it contains, one starts at such a place. Runs meet in an equality join, and what meets
    is checked against the whole text. Empty terms match nothing. ``key`` is unique per text, ``term`` per term.

    A dictionary of at most ``max_rows`` terms and ``max_bytes`` goes to all tasks, and nothing is shuffled: a text looks
    its passing runs up and checks the terms that they lead to in its own row, and only what it contains is opened. A
    larger one is joined by shuffle: keys and passing runs travel, salted by key so that a frequent run is spread, and
    texts with such runs come back in for the final check. The filed terms are written out once, since they are read
    several times.
    """
    n = F.length(term)
    kind = F.lit(None).cast("int")
    for i, (length, stride) in enumerate(RUNS):
        kind = F.when(n >= length + stride - 1, i).otherwise(kind)
    filed = settled(_filed_terms(terms.where(n > 0).select(term, kind.alias("_kind")), term), "filed-terms")
    size = F.octet_length(term) + 8 * F.size("_earlier") + 16
    facts = filed.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.sort_array(F.collect_set(kind)).alias("kinds")).first()
    spark, kinds, runs = texts.sparkSession, [RUNS[k] for k in facts["kinds"]], RunFilter.of(filed, "_run", facts["n"])
    if facts["n"] and facts["n"] <= max_rows and facts["bytes"] <= max_bytes:
        known = FiledTerms.of(filed, term, "_run")
        found = texts.select(key, known.contained(spark, F.col(text), runs, kinds).alias("_places"))
        listed = F.broadcast(known.listed(spark, "_place", term))
        return found.select(key, F.explode("_places").alias("_place")).join(listed, "_place").select(key, term)
    texts = texts.select(key, text, runs.opened(spark, F.col(text), kinds).alias("_runs")).where(F.size("_runs") > 0)
    contained = (F.length(term) <= EXACT) | F.contains(F.col(text), F.col(term))
    met = salted_join(texts.select(key, F.explode("_runs").alias("_run")), filed.drop("_earlier"), ["_run"], [key]).select(key, term).distinct()
    return met.join(texts.select(key, text), key).where(contained).select(key, term)


def tag_texts(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """``(key, terms)``: the sorted terms that each text contains, none for a null text; the extractor that needs no service."""
    found = find_terms(texts, terms, key, text, term).groupBy(key).agg(F.array_sort(F.collect_list(term)).alias("terms"))
    return texts.select(key).join(found, key, "left").select(key, F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def match_pages(diseases: DataFrame, pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages that contain a disease's name or one of its variants, with the longest variant that matched.

    ``diseases`` holds disease_id and variants (a list of names).
    """
    by_variant = settled(diseases.select("disease_id", F.explode("variants").alias("variant")).where(F.col("variant") != ""), "variants")
    words = by_variant.select("variant").distinct()
    hits = find_terms(pages, words, key, html, "variant")
    owned = lookup_join(hits, by_variant, ["variant"], [key])
    return owned.groupBy(key, "disease_id").agg(
        F.min(F.struct((-F.length("variant")).alias("k"), F.col("variant"))).getField("variant").alias("variant")
    )


def collect_terms(df: DataFrame, key: str, pos: str, value: str, name: str) -> DataFrame:
    """One ordered list per record, for export in the record form; the list of a record came from one row."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, value)))
    return df.groupBy(key).agg(F.transform(ordered, lambda s: s[value]).alias(name))
