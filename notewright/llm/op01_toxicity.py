"""Query of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm import toxicity
from notewright.llm.common import held_out, table
from notewright.llm.registry import query

THRESHOLD = 0.3


@query("op1_toxicity")
def op1_toxicity(spark, folder):
    """The toxicity of every whole document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels, F.col("text"), "doc_id", "toxic")
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), "toxic_terms")
