"""Query of the suffix-array deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm import suffix_dedup
from notewright.llm.common import table
from notewright.llm.registry import query


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, folder):
    """Every document without the bytes of strings that also start in a smaller document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return suffix_dedup.without_repeats(docs).select(
        "doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("repeated_spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
