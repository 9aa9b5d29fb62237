"""Batch calls of a model or service, one prompt per row, with retries and a rate cap.

The call itself is a Python function given by the user. It runs on the executors,
over Arrow batches; rows that need no call are filtered out before.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions.text import render
from notewright.operators.scaling import running_index
from notewright.sources.scratch import scratch_path

# Rows of an Arrow batch whose prompts and answers a task holds as Python objects at once.
ROWS_AT_ONCE = 500
RESULT_FIELDS = "client int, response string, tokens bigint, attempts int, error string"


def render_prompt(description: Column | str, template: str = V.ANNOTATION_PROMPT) -> Column:
    return render(template, V.PROMPT_SLOT, description)


def assign_clients(df: DataFrame, clients: int, position: str, name: str = "client") -> DataFrame:
    """Clients in turn by position in the list (a unique integer)."""
    numbered = running_index(df, position, name="_turn")
    return numbered.withColumn(name, F.pmod("_turn", F.lit(clients)).cast("int")).drop("_turn")


class RateCap:
    """Lets at most ``rate`` calls start per second: each waits until the last one's start is ``1 / rate`` seconds ago."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic,
                 sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.free_at, self.lock = 1.0 / rate, clock, sleep, None, Lock()

    def wait(self) -> None:
        with self.lock:  # threads start one after the other
            while self.free_at is not None and (left := self.free_at - self.clock()) > 0:
                self.sleep(left)
            self.free_at = self.clock() + self.gap


def call_with_retries(call: Callable[[int, str], Any], client: int, prompt: str, attempts: int,
                      is_failure: Callable[[Any], bool] | None, cap: RateCap | None = None) -> tuple[Any, int, str | None]:
    """Answer, number of tries and last error; the answer is None when every try failed. Every try waits for the cap."""
    error = None
    for n in range(1, attempts + 1):
        if cap:
            cap.wait()
        try:
            answer = call(client, prompt)
        except Exception as e:  # the service may fail in any way; the row records how
            error = f"{type(e).__name__}: {e}"
            continue
        if is_failure is not None and is_failure(answer):
            error = "rejected answer"
            continue
        return answer, n, None
    return None, attempts, error


def infer(df: DataFrame, key: str, prompt: str, call: Callable[[int, str], Any], clients: int = 1,
          rate: float | None = V.POOL_RATE, attempts: int = V.ATTEMPTS,
          is_failure: Callable[[Any], bool] | None = None, lanes: int = 4, threads: int = 8,
          position: str | None = None) -> DataFrame:
    """``(key, client, response, tokens, attempts, error)`` for every row; a failed row has a null response.

    ``call(client, prompt)`` returns a text, or a pair of text and token count. Rows
    take clients in turn. Under a rate each client works in ``lanes`` tasks that share it
    evenly, so calls per second stay under ``rate`` for each client however many tasks
    run, and a lost executor costs one lane; tries after a failure count as calls and wait
    as well. Without a rate the input's own partitions do the calls. Rows stream
    through in Arrow batches.

    The order of turns follows ``position``, or ``key`` where none is given (unique integers).
    Write the result before using it more than once: every evaluation calls again.
    """
    position = position or key
    prompts = df.select(*dict.fromkeys([key, position]), F.col(prompt).alias("_prompt"))
    # one client needs no turns
    turned = assign_clients(prompts, clients, position) if clients > 1 else prompts.withColumn("client", F.lit(0))
    placed = turned.select(key, "client", "_prompt")
    if rate:
        lane = F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")
        placed = placed.withColumn("_part", F.col("client") * lanes + lane).repartitionById(clients * lanes, F.col("_part")).drop("_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cap = RateCap(rate / lanes) if rate else None

        with ThreadPoolExecutor(threads) as pool:
            # a few rows at a time become Python objects, however many a batch holds
            for rows in (batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
                jobs = []
                for client, text in zip(rows["client"].to_pylist(), rows["_prompt"].to_pylist(), strict=True):
                    jobs.append(pool.submit(call_with_retries, call, client, text, attempts, is_failure, cap))
                out = [j.result() for j in jobs]
                answers = [a if isinstance(a, tuple) else (a, None) for a, _, _ in out]
                yield pa.RecordBatch.from_pydict({
                    key: rows[key],
                    "client": rows["client"],
                    "response": pa.array([a for a, _ in answers], pa.string()),
                    "tokens": pa.array([t for _, t in answers], pa.int64()),
                    "attempts": pa.array([n for _, n, _ in out], pa.int32()),
                    "error": pa.array([e for _, _, e in out], pa.string()),
                })

    kind = df.schema[key].dataType.simpleString()
    return placed.mapInArrow(run, f"{key} {kind}, {RESULT_FIELDS}")


def pending(df: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    return df.join(done.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def infer_pending(df: DataFrame, done: DataFrame, key: str, prompt: str, call: Callable[[int, str], Any],
                  **options: Any) -> DataFrame:
    """Results for all rows: kept ones from ``done``, new ones for the rows it lacks."""
    todo = pending(df, done, key)
    fresh = infer(todo, key, prompt, call, **options)
    return done.select(*fresh.columns).unionByName(fresh)


def infer_in_steps(df: DataFrame, key: str, prompt: str, call: Callable[[int, str], Any], path: str, steps: int = 20,
                   **options: Any) -> DataFrame:
    """Run inference in ``steps`` shares and write each under ``path``; a restart skips finished shares.

    A share is a hash range of the key and has its own folder. The input is read once, to lay its shares apart in the
    shared folder. A finished share leaves a note of the fingerprint of its input rows under ``path/_finished``, so a
    share whose rows have changed is run anew, one that has lost all its rows is emptied, and a job that dies repeats one
    share at most.
    """
    spark, position = df.sparkSession, options.get("position") or key
    share = F.pmod(F.xxhash64(key), F.lit(steps)).cast("int")
    staged = scratch_path(spark, "prompts")
    rows = df.select(*dict.fromkeys([key, position, prompt]), share.alias("step"))
    rows.write.partitionBy("step").parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    mark = F.xxhash64(*dict.fromkeys([key, position, prompt]))
    print_ = F.concat_ws(":", F.count(F.lit(1)), F.sum(mark.cast("decimal(38,0)")), F.bit_xor(mark))
    wanted = {r["step"]: r["mark"] for r in rows.groupBy("step").agg(print_.alias("mark")).collect()}
    finished = {r["step"]: r["mark"] for r in _read_or_empty(spark, f"{path}/_finished", "mark string, step int").collect()}
    for step in sorted(wanted.keys() | finished.keys()):
        if wanted.get(step) == finished.get(step):
            continue
        infer(rows.where(F.col("step") == step), key, prompt, call, **options).write.mode("overwrite").parquet(f"{path}/step={step}")
        spark.range(1).select(F.lit(wanted.get(step)).cast("string").alias("mark")).write.mode("overwrite").parquet(f"{path}/_finished/step={step}")
    kind = df.schema[key].dataType.simpleString()
    return _read_or_empty(spark, path, f"{key} {kind}, {RESULT_FIELDS}, step int").drop("step")


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def counters(results: DataFrame) -> DataFrame:
    """Successes, failures and tokens per client."""
    return results.groupBy("client").agg(
        F.count("response").alias("succeeded"),
        F.count_if(F.col("response").isNull()).alias("failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )


def with_responses(df: DataFrame, results: DataFrame, key: str, name: str) -> DataFrame:
    """All columns of ``df`` and the response of each row, null where there is none."""
    return df.join(results.select(key, F.col("response").alias(name)), key, "left")
