"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A batch of events inserts, revises or deletes documents' counts. It is turned into signed changes against what the
store holds of those documents, the changes are added up by group, and both are written under the batch's name; the
batch counts from the moment its marker is there. A batch that has its marker is not applied again, one that broke
off is written anew, so repeats change nothing. Totals are sums of the changes.

Layout below the store's folder: ``state/batch=B/attempt=A`` (documents' latest counts as of the batch with their
signed changes), ``deltas/batch=B/attempt=A`` (signed sums by group), ``done/batch=B/attempt=A`` (marker). What an
attempt without a marker left behind is never read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]
EVENTS = "doc_id long, tokenizer string, source string, lang string, n_tokens long, op string, seq long"
STATE = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, changes array<struct<sign:int,source:string,lang:string,n_tokens:long>>, batch long, attempt string"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch long, attempt string"

# Tokenizer versions that need no vocabulary: how they count the tokens of a text.
# The pattern of the word-end vocabulary's pre-tokenizer.
COUNTERS: dict[str, str] = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+",
}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under a tokenizer version; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[tokenizer])), F.lit(0)).cast("long")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _done(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/done", "at timestamp, batch long, attempt string").groupBy("batch").agg(F.min_by("attempt", "at").alias("attempt"))


def is_done(spark: SparkSession, store: str, batch: int) -> bool:
    return not _done(spark, store).where(F.col("batch") == batch).isEmpty()


def state(spark: SparkSession, store: str) -> DataFrame:
    """The latest count of every document and tokenizer version, deleted ones included, of finished batches."""
    rows = _read(spark, f"{store}/state", STATE).join(F.broadcast(_done(spark, store)), ["batch", "attempt"], "left_semi")  # one short row per batch
    # latest batch wins; documents' keys are unique within one
    latest = F.max_by(F.struct("source", "lang", "n_tokens", "alive"), "batch").alias("s")
    return rows.groupBy("doc_id", "tokenizer").agg(latest).select("doc_id", "tokenizer", "s.*")


def signed(events: DataFrame, before: DataFrame) -> DataFrame:
    """Signed changes of a batch: what a document counted before is taken off, what it counts now is put on.

    The last event of a document and tokenizer (largest seq) stands for the batch; inserting what is there replaces
    it, deleting or revising what is not there changes nothing and inserts, in this order. Null ids are left out.
    """
    last = events.where(F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull()).groupBy("doc_id", "tokenizer").agg(
        F.max_by(F.struct("source", "lang", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "op"), F.struct("seq", "op", "n_tokens", "source", "lang")).alias("now"))
    was = before.where("alive").select("doc_id", "tokenizer", F.struct("source", "lang", "n_tokens").alias("was"))
    both = last.join(was, ["doc_id", "tokenizer"], "left")
    put = F.when(F.col("now.op") != "delete", F.struct(F.lit(1).alias("sign"), "now.source", "now.lang", "now.n_tokens"))
    off = F.when(F.col("was").isNotNull(), F.struct(F.lit(-1).alias("sign"), "was.source", "was.lang", "was.n_tokens"))
    return both.select("doc_id", "tokenizer", "now", F.array_compact(F.array(put, off)).alias("changes"))


def apply_batch(spark: SparkSession, store: str, batch: int, events: DataFrame) -> bool:
    """Applies one batch of ``EVENTS`` rows; False if it was applied before.

    Batches come in ascending order, gaps allowed, since a later one overrides: one below the last that was applied is
    refused with a ValueError. An event without text or tokens counts none; further columns are passed over.
    """
    if is_done(spark, store, batch):
        return False
    last = _done(spark, store).agg(F.max("batch")).first()[0]
    if last is not None and batch < last:
        raise ValueError(f"batch {batch} comes after batch {last}")
    end = f"batch={batch}/attempt={uuid.uuid4().hex}"
    signed(events, state(spark, store)).select(
        "doc_id", "tokenizer", "now.source", "now.lang", "now.n_tokens", (F.col("now.op") != "delete").alias("alive"), "changes",
    ).write.parquet(f"{store}/state/{end}")
    # tokens were counted once; the sums come from what was written
    rows = spark.read.schema(STATE).parquet(f"{store}/state/{end}").select("tokenizer", F.inline("changes"))
    rows.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).write.parquet(f"{store}/deltas/{end}")
    spark.range(1).select(F.current_timestamp().alias("at")).write.parquet(f"{store}/done/{end}")
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Documents and tokens of each source, language and tokenizer version that has documents; null sources and languages are groups too."""
    rows = _read(spark, f"{store}/deltas", DELTAS).join(F.broadcast(_done(spark, store)), ["batch", "attempt"], "left_semi")
    return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
