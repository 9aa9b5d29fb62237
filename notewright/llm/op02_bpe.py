"""Query of the BPE operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from notewright.llm import bpe
from notewright.llm.common import table
from notewright.llm.registry import query

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op2_bpe")
def op2_bpe(spark, folder):
    """Every document's token ids and their decoding, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
