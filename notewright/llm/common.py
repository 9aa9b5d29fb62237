"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_REMAINDER = 2
BATCH_BYTES = 8 << 20  # of the rows that a Python worker gets at once, while a step is written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trim() -> None:
    """Gives freed room back to the system, as it stays with a process otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def worker_cache(owner: str) -> dict:
    """An operator's dictionary in the Python worker; functions travel by value, so globals of this package don't.

    Workers go on from one operator's tasks to the next one's. What an operator kept stays while tasks that use it follow each
    other; when the first task of another operator begins it is let go, and its room is given back to the system before that
    task goes on, so that a worker never holds the tables of two operators that don't share a task.
    """
    import gc

    import pyarrow as pa
    import pyspark

    kept = pyspark.__dict__.setdefault("_notewright_worker_cache", {"task": None, "now": {}, "before": {}})
    context = pyspark.TaskContext.get()
    task = context.taskAttemptId() if context else None
    if kept["task"] != task:
        gone = any(kept["before"].values()) or owner not in kept["now"]
        kept.update(task=task, now={}, before=kept["now"] if owner in kept["now"] else {})
        if gone:
            gc.collect()  # tables and their caches refer to each other
            trim()
        pa.default_memory_pool().release_unused()  # of the batches before
    if owner not in kept["now"]:
        kept["now"][owner] = kept["before"].pop(owner, {})
    return kept["now"][owner]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for testing: crc32 of the id as text leaves 2 when divided by 4 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that setting is absent and Spark runs in one process, a temporary folder takes its place; on a
    cluster the setting is required, as executors do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="notewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def lean_steps(spark: SparkSession):
    """Within it, the shuffle files of a query go as soon as it has ended, and Python workers get their rows in small batches."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back; cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    with lean_steps(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Written tables of one job, in a folder of its own below the shared one; those that are used up can be dropped."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.base = spark, shared_folder(spark, job)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As ``written`` does; a name is used once."""
        with lean_steps(self.spark):
            df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
