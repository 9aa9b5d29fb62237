"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents
(the last one adds the tokens). Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import bpe, decontamination, langid, ngram_join, secrets
from notewright.llm.common import free_name, shared_folder, table, written
from notewright.llm.op02_bpe import VOCABULARY
from notewright.llm.op04_langid import fitted


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects: those without a letter, or of no learned language."""
    return langid.predict(docs, fitted(docs)).where(~F.col("lang_rejected")).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id; one without an id only where none has one.

    Rows are compared by a number of their own, so texts that share an id, or have none, are told apart. Texts without a
    word are similar to nothing; of those that repeat an id one stays.
    """
    row = free_name(docs, "_row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    groups = ngram_join.similar(docs, doc_id=row).select(F.col("doc_id").alias("_key"), "n_shingles", "component_id")
    ids = docs.select(F.col(row).alias("_key"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    wordless = F.col("n_shingles") == 0
    group = F.struct(F.when(~wordless, F.col("component_id")).alias("c"), F.when(wordless, F.col("_id")).alias("d"), F.when(wordless & F.col("_id").isNull(), F.col("_key")).alias("e"))
    kept = ids.join(groups, "_key").groupBy(group.alias("_group")).agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_hash", "_key")).alias("_first"))
    return docs.join(kept.select(F.col("_first._key").alias(row)), row, "left_semi").drop(row)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    found = decontamination.leaked_items(docs, table(spark, sf_dir, "benchmark"), out="_leaks")
    return found.where(F.size("_leaks") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With a mask in the place of every secret; n_chars follows the text."""
    masked = secrets.redact(docs, shared_folder(spark, "secret-ledger"))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With token ids, their number and what they decode to."""
    out = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    return out.withColumn("n_tokens", F.size("ids").cast("long")).select(*docs.columns, "n_tokens", "ids", "decoded")


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard_join", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("bpe", tokenized),
]

# A trained classifier, connected components and BPE have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
