"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm import langid
from notewright.llm.common import held_out, table
from notewright.llm.registry import query


def fitted(docs: DataFrame) -> langid.Model:
    """The model of the rows that are not held out."""
    return langid.fit(docs.where(~held_out(F.col("doc_id"))), F.col("text"), F.col("lang"), F.col("doc_id"))


@query("op4_language_id")
def op4_language_id(spark, folder):
    """The predicted language of every whole document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs.drop("lang"), fitted(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
