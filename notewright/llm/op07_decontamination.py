"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm import decontamination as dc
from notewright.llm.common import table
from notewright.llm.registry import query


@query("op7_decontamination")
def op7_decontamination(spark, folder):
    """The benchmark items that every document holds."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dc.leaked_items(docs, table(spark, folder, "benchmark")).select(
        "doc_id", F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"), (F.size("leaks") > 0).alias("contaminated"), "leaks")
