"""Query of the removal of repeated passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm import phrase_dedup
from notewright.llm.common import table
from notewright.llm.registry import query


@query("op12_phrase_dedup")
def op12_phrase_dedup(spark, folder):
    """Every document without the words of windows that also start in a smaller document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    removed = F.aggregate("repeats.spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return phrase_dedup.without_repeats(docs).select(
        "doc_id", "repeats.n_words", removed.alias("n_removed"), F.sha2("repeats.kept", 256).alias("kept_sha256"))
