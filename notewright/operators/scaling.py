"""Joins and numbering that hold up when one key carries much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A lookup table is sent to every executor only when it has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# A hot key of the large side is spread over this many tasks.
SALTS = 16
# Rows of a task that folds narrow rows in memory.
TASK_ROWS = 500_000
# Positions per numbering bucket; a bucket never holds more rows than this.
BUCKET = 1 << 17
# Buckets per bucket of the level above; also the most that any position layout leaves at the top.
FAN = 1 << 23


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than that, for work that is heavy per row.

    Inputs of many splits, which is every large one, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(rows: int, *sides: tuple[DataFrame, str], per_task: int = TASK_ROWS) -> list[DataFrame]:
    """Sides of a join dealt by their keys over tasks of about ``per_task`` of the ``rows`` of the largest.

    Where it sizes tasks itself, Spark goes by the bytes of the shuffle, and those of narrow rows are so few that a
    task would sort and fold millions of rows. What is grouped by the key afterwards stays in these tasks.
    """
    parts = [max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)) for df, _ in sides]
    return [df.repartition(n, key) for (df, key), n in zip(sides, parts, strict=True)]


def salted_join(fact: DataFrame, dim: DataFrame, on: list[str], spread: list[str | Column], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join with ``dim`` (unique on ``on``) after spreading every fact key over ``salts`` tasks.

    ``spread`` names fact columns that vary inside a key. ``dim`` is repeated once
    per salt, so this suits sides much smaller than the fact. Both sides are shuffled: the
    planner's estimate leaves the repeats out, so without the hint it may broadcast them all.
    """
    left = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.lit(list(range(salts))))).hint("merge")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(fact: DataFrame, dim: DataFrame, on: list[str], spread: list[str | Column], how: str = "inner",
                max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a lookup table: broadcast when its counted rows and bytes allow it, salted otherwise."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*dim.columns))))
    rows, size = dim.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        return fact.join(F.broadcast(dim), on, how)
    return salted_join(fact, dim, on, spread, how)


def _bucket(position: str, width: int) -> Column:
    """First position of the bucket that a position falls into."""
    return F.col(position) - F.pmod(F.col(position), F.lit(width))


def is_first(df: DataFrame, key: str, order: str, others: Column | None = None) -> DataFrame:
    """Add ``is_first``: whether a row has the lowest ``order`` (an integer, unique within the key) of its key.

    The lowest order of each key comes from narrow rows, folded in every task before they
    move; a key with very many rows is nowhere gathered, and the join leaves its rows to be
    split. With ``others``, rows that are not first stay only where it holds.
    """
    lowest = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_lowest"))
    joined = df.join(lowest, F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_lowest")), "left")
    out = joined.withColumn("is_first", F.col("_lowest").isNotNull()).drop("_key", "_lowest")
    return out if others is None else out.where(F.col("is_first") | others)


def _rows_before(counts: DataFrame, lead: list[str], widths: list[int]) -> DataFrame:
    """``_before`` of each bucket: the rows in all earlier ones.

    Buckets are summed inside the buckets of the next level, and those in turn, so that
    no window covers more than one bucket of the level above, however sparse positions are.
    """
    if not widths:
        earlier = Window.orderBy(*lead, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(*lead, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    up = counts.withColumn("_up", _bucket("_bucket", widths[0]))
    earlier = Window.partitionBy(*lead, "_up").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = up.withColumn("_inside", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    parents = up.groupBy(*lead, F.col("_up").alias("_bucket")).agg(F.sum("_n").alias("_n"))
    above = _rows_before(parents, lead, widths[1:]).select(*lead, F.col("_bucket").alias("_up"), F.col("_before").alias("_above"))
    return inside.join(above, [*lead, "_up"]).select(*lead, "_bucket", (F.col("_inside") + F.col("_above")).alias("_before"))


def running_index(df: DataFrame, position: str, lead: list[str] | None = None, name: str = "index",
                  start: int = 0, width: int = BUCKET) -> DataFrame:
    """Number rows from ``start`` in the order of ``lead`` and then ``position``.

    ``position`` is an integer that is unique within ``lead`` (which has few values).
    Rows are ranked inside buckets of ``width`` positions, and each bucket is shifted
    by the number of rows before it, which comes from the bucket counts alone.
    """
    lead = lead or []
    keys = [*lead, "_bucket"]
    placed = df.withColumn("_bucket", _bucket(position, width))
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return (
        placed.withColumn("_rank", rank)
        .join(_rows_before(counts, lead, [width * FAN]), keys)
        .withColumn(name, F.col("_before") + F.col("_rank") - F.lit(1) + F.lit(start))
        .drop("_bucket", "_rank", "_before")
    )


def _edges(ends: DataFrame, widths: list[int]) -> DataFrame:
    """The last value before and the first value after each bucket, level by level as in ``_rows_before``."""
    if not widths:
        order = Window.orderBy("_bucket")
        return ends.select("_bucket", F.lag("_last").over(order).alias("_before"), F.lead("_first").over(order).alias("_after"))
    up = ends.withColumn("_up", _bucket("_bucket", widths[0]))
    order = Window.partitionBy("_up").orderBy("_bucket")
    inside = up.withColumn("_prev", F.lag("_last").over(order)).withColumn("_next", F.lead("_first").over(order))
    parents = up.groupBy(F.col("_up").alias("_bucket")).agg(
        F.min_by("_first", "_bucket").alias("_first"), F.max_by("_last", "_bucket").alias("_last")
    )
    above = _edges(parents, widths[1:]).withColumnRenamed("_bucket", "_up")
    return inside.join(above, "_up").select(
        "_bucket", F.coalesce("_prev", "_before").alias("_before"), F.coalesce("_next", "_after").alias("_after")
    )


def neighbours(df: DataFrame, position: str, value: str, width: int = BUCKET) -> DataFrame:
    """Add ``prev`` and ``next``: the values of the rows before and after, by ``position`` (unique integers).

    Neighbours inside a bucket come from a window over the bucket; the first and last
    row of a bucket take theirs from the table of bucket ends.
    """
    placed = df.withColumn("_bucket", _bucket(position, width))
    ends = placed.groupBy("_bucket").agg(F.min_by(value, position).alias("_first"), F.max_by(value, position).alias("_last"))
    inside = Window.partitionBy("_bucket").orderBy(position)
    return (
        placed.withColumn("_prev", F.lag(value).over(inside)).withColumn("_next", F.lead(value).over(inside))
        .join(_edges(ends, [width * FAN]), "_bucket")
        .withColumn("prev", F.coalesce("_prev", "_before"))
        .withColumn("next", F.coalesce("_next", "_after"))
        .drop("_bucket", "_prev", "_next", "_before", "_after")
    )
