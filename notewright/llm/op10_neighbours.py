"""Query of the embedding near-duplicates."""

from __future__ import annotations

from notewright.llm import neighbours
from notewright.llm.common import table
from notewright.llm.registry import query


@query("op10_embedding_near_dedup")
def op10_embedding_near_dedup(spark, folder):
    """Links and component of every vector."""
    found, _ = neighbours.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return found
