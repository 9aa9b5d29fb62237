"""Review queue: what is left to annotate, which submissions count, how far the work is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions.phenotypes import default_labels, first_elements, list_or_empty
from notewright.operators.scaling import neighbours


def prepared_samples(samples: DataFrame) -> DataFrame:
    """Samples as the queue shows them: all label lists present, predictions cut to their first element."""
    out = samples.withColumn("human_annotated", default_labels("human_annotated"))
    if "llm_predict" in samples.columns:
        out = out.withColumn("llm_predict", first_elements("llm_predict"))
    return out


def review_queue(samples: DataFrame, log: DataFrame, key: str = "index") -> DataFrame:
    """Samples without a submission. The log is reduced to distinct ids before the join."""
    done = log.where(F.col(key).isNotNull()).select(key).distinct()
    return samples.join(done, key, "left_anti")


def with_submission_defaults(submissions: DataFrame) -> DataFrame:
    out = submissions
    for name in V.TRUTH_KEYS:
        out = out.withColumn(name, list_or_empty(name))
    return out.withColumn("is_sure", F.coalesce("is_sure", F.lit(True)))


def accept(submissions: DataFrame, log: DataFrame | None = None, key: str = "index", arrival: str = "seq") -> DataFrame:
    """Add ``accepted``: true for the first submission of an id that is not in the log yet.

    The first arrival per id is a partial aggregate and comes back on id and arrival
    together, so an id that is sent again and again stays spread out.
    """
    firsts = submissions.groupBy(key).agg(F.min(arrival).alias(arrival))
    if log is not None:
        firsts = firsts.join(log.select(key).distinct(), key, "left_anti")
    return (
        submissions.join(firsts.withColumn("_first", F.lit(True)), [key, arrival], "left")
        .withColumn("accepted", F.coalesce("_first", F.lit(False)))
        .drop("_first")
    )


def percent(part: Column, total: Column) -> Column:
    """Share in percent, one decimal, halves to even; 0 of an empty total."""
    return F.when(total > 0, F.bround(part / total * F.lit(100), 1)).otherwise(F.lit(0.0))


def id_bits(df: DataFrame, key: str = "index") -> DataFrame:
    """(bucket, bits, side): the distinct ids of a table as bits, one row for every 32,768 possible ids; side is 1. Null ids are passed over.

    Bits are set in every task before rows move, so neither repeated ids nor busy buckets cost more than a bitmap a task.
    """
    ids = df.where(F.col(key).isNotNull()).select(F.bitmap_bucket_number(F.col(key).cast("bigint")).alias("bucket"), F.bitmap_bit_position(F.col(key).cast("bigint")).alias("_bit"))
    return ids.groupBy("bucket").agg(F.bitmap_construct_agg("_bit").alias("bits")).select("bucket", "bits", F.lit(1).alias("side"))


def submitted_ids(log: DataFrame, key: str = "index") -> DataFrame:
    """The number of distinct ids in the log."""
    return id_bits(log, key).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def progress(samples: DataFrame, log: DataFrame, key: str = "index") -> DataFrame:
    """Total, annotated, remaining and percentage; ids are unique among the samples.

    ``annotated`` counts every id in the log, also ids without a sample. Ids are compared as bits, so what is shuffled is
    a bitmap for every 32,768 ids and task.
    """
    sides = id_bits(samples, key).unionByName(id_bits(log, key).withColumn("side", F.lit(2)))
    of = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.bitmap_count("bits"))), F.lit(0))
    both = F.when(F.count(F.lit(1)) == 2, F.bitmap_count(F.bitmap_and_agg("bits"))).otherwise(0)
    per_bucket = sides.groupBy("bucket").agg(of(1).alias("s"), of(2).alias("l"), both.alias("b"))
    counts = per_bucket.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("annotated"),
        F.coalesce(F.sum(F.col("s") - F.col("b")), F.lit(0)).alias("remaining"),
    )
    return counts.withColumn("percentage", percent(F.col("annotated"), F.col("total")))


def queue_neighbours(queue: DataFrame, key: str = "index", position: str = "index") -> DataFrame:
    """Previous and next entry of each queued sample; the first one's previous is itself."""
    return neighbours(queue, position, key).withColumn("prev", F.coalesce("prev", F.col(key)))


def navigate(queue: DataFrame, requests: DataFrame, key: str = "index", position: str = "index") -> DataFrame:
    """The entry each request ``(action, current_id)`` leads to; null past the end.

    An id that is not queued (or 0, or none) counts as the first position.
    """
    linked = queue_neighbours(queue, key, position).select(
        F.col(key).alias("_at"), F.col("prev").alias("_prev"), F.col("next").alias("_next")
    )
    head = queue.select(F.col(position).alias("p"), F.col(key).alias("k")).orderBy("p").limit(2)
    lowest = head.agg(F.sort_array(F.collect_list(F.struct("p", "k"))).alias("two")).scalar()
    first, second = (F.try_element_at(lowest, F.lit(i)).getField("k") for i in (1, 2))
    found = F.col("_at").isNotNull()
    target = (
        F.when(F.col("action") == "init", first)
        .when(F.col("action") == "next", F.when(found, F.col("_next")).otherwise(second))
        .when(F.col("action") == "prev", F.when(found, F.col("_prev")).otherwise(first))
        .otherwise(F.when(found, F.col("_at")).otherwise(first))
    )
    return (
        requests.join(linked, (requests["current_id"] == linked["_at"]) & (requests["current_id"] != 0), "left")
        .select(*requests.columns, target.alias("target"))
    )


def sure(submissions: DataFrame, is_sure: bool = True) -> DataFrame:
    return submissions.where(F.col("is_sure") if is_sure else ~F.col("is_sure"))
