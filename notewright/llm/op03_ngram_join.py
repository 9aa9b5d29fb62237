"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from notewright.llm import ngram_join
from notewright.llm.common import table
from notewright.llm.registry import query


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, folder):
    """The similarity component of every whole document."""
    return ngram_join.similar(table(spark, folder, "documents").select("doc_id", "text"))
