"""Submissions as a stream: the first one of an id is accepted, all later ones are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notewright.operators.review import id_bits, percent


def newly_accepted(stream: DataFrame, key: str = "index", arrival: str = "seq", logged: DataFrame | None = None) -> DataFrame:
    """First submission of every id, emitted in the micro-batch in which the id first appears.

    An aggregation keeps one row per id in the state store: its earliest arrival. The
    micro-batch time stamps of an id's first and latest row tell new ids from known ones,
    so the log is never read again. Rows of a busy id are folded before the shuffle.
    Use with output mode "update".

    ``logged`` is a stream of the submissions from before the first start. It runs into the same state and comes first
    within its micro-batch, so that its ids are known and only its new files are read in later batches.
    """
    rest = [c for c in stream.columns if c != key]
    rows = stream.where(F.col(key).isNotNull()).withColumn("_new", F.lit(True))
    if logged is not None:
        empty = [F.lit(None).cast(stream.schema[c].dataType).alias(c) for c in rest]
        old = logged.where(F.col(key).isNotNull()).select(key, *empty, F.lit(False).alias("_new"))
        rows = rows.unionByName(old)
    stamped = rows.withColumn("_at", F.current_timestamp())
    firsts = stamped.groupBy(key).agg(
        F.min_by(F.struct("_new", *rest), F.struct("_at", "_new", arrival)).alias("_row"),
        F.min("_at").alias("_first"), F.max("_at").alias("_last"),
    )
    fresh = (F.col("_first") == F.col("_last")) & F.col("_row._new")
    return firsts.where(fresh).select(key, "_row.*").select(*stream.columns)


def write_batch(log_path: str, after: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer with one log folder per micro-batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{log_path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        if after is not None:
            after(batch.sparkSession.read.schema(batch.schema).parquet(target), batch_id)

    return write


def accept_stream(stream: DataFrame, log_path: str, checkpoint: str, key: str = "index", arrival: str = "seq",
                  after: Callable[[DataFrame, int], None] | None = None, logged: DataFrame | None = None) -> StreamingQuery:
    """Start the stream into the log; it stops when the input present at its start is used up.

    ``logged`` is a stream of submissions from before the first start, given again at every start; their ids are not
    accepted again.
    """
    return (
        newly_accepted(stream, key, arrival, logged).writeStream.outputMode("update")
        .foreachBatch(write_batch(log_path, after))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def progress_writer(queued: DataFrame, path: str, key: str = "index") -> Callable[[DataFrame, int], None]:
    """Per micro-batch counts for the queue: newly accepted ids, and those that were in the queue.

    ``queued`` holds the samples' ids as bits (``review.id_bits``), a row for every 32,768 ids, written once before the
    stream starts. A batch's ids become bits as well, and rows of equal buckets are laid over each other; the samples
    are not read again. Batches accept disjoint ids, so queue state at any time is a running sum of these rows.
    """

    def after(accepted: DataFrame, batch_id: int) -> None:
        both = id_bits(accepted, key).unionByName(queued.withColumn("side", F.lit(2)))
        met = both.groupBy("bucket").agg(
            F.max(F.when(F.col("side") == 1, F.bitmap_count("bits"))).alias("accepted"),
            F.when(F.count(F.lit(1)) == 2, F.bitmap_count(F.bitmap_and_agg("bits"))).alias("met"))
        met.where("accepted is not null").agg(
            F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"), F.coalesce(F.sum("met"), F.lit(0)).alias("from_queue"),
        ).select(F.lit(batch_id).cast("bigint").alias("batch_id"), "accepted", "from_queue").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return after


def progress_after_batches(total: int, counts: DataFrame) -> DataFrame:
    """Progress after the last batch from the written per-batch counts (one small row per batch) and the number of samples."""
    sums = counts.agg(
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("annotated"),
        F.coalesce(F.sum("from_queue"), F.lit(0)).alias("_from_queue"),
    )
    return sums.select(
        F.lit(total).cast("bigint").alias("total"), "annotated", (F.lit(total) - F.col("_from_queue")).alias("remaining"),
    ).withColumn("percentage", percent(F.col("annotated"), F.col("total")))
