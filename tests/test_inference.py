import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from notewright.operators import inference as I

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(client, prompt):
    return f"{client}:{prompt}"


def test_rate_cap_spaces_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    cap = I.RateCap(4, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        cap.wait()
    assert sum(slept) == pytest.approx(1.0)
    now[0] += 10
    cap.wait()
    assert len(slept) == 4


def test_retries():
    tries = []

    def call(client, prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise ValueError("busy")
        return "ok"

    assert I.call_with_retries(call, 0, "p", 3, None) == ("ok", 3, None)
    tries.clear()
    assert I.call_with_retries(call, 0, "p", 2, None) == (None, 2, "ValueError: busy")
    assert I.call_with_retries(lambda c, p: "bad", 0, "p", 3, lambda a: a == "bad") == (None, 3, "rejected answer")


def test_clients_take_turns_and_every_prompt_is_answered(spark):
    df = spark.range(10, 200, 3).select(F.col("id").alias("index"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    got = {r["index"]: r for r in I.infer(df, "index", "prompt", answer, clients=4, rate=None).collect()}
    order = sorted(got)
    assert order == list(range(10, 200, 3))
    assert all(got[i]["client"] == n % 4 and got[i]["response"] == f"{n % 4}:p{i}" for n, i in enumerate(order))


def test_rate_holds_across_lanes(spark):
    import time

    df = spark.range(24).select(F.col("id").alias("index"), F.lit("p").alias("prompt"))
    start = time.time()
    assert I.infer(df, "index", "prompt", answer, clients=1, rate=20, lanes=2).count() == 24
    assert time.time() - start > 0.4


def test_only_pending_rows_are_sent(spark):
    df = spark.range(20).select(F.col("id").alias("index"), F.lit("p").alias("prompt"))

    def only_high(client, prompt):
        return "new"

    done = I.infer(df.where("index < 5"), "index", "prompt", lambda c, p: "old", rate=None)
    got = {r["index"]: r["response"] for r in I.infer_pending(df, done, "index", "prompt", only_high, rate=None).collect()}
    assert got == {i: "old" if i < 5 else "new" for i in range(20)}


def test_steps_resume(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("index"), F.lit("p").alias("prompt"))
    path = str(tmp_path / "out")

    def run(rows, said):
        out = I.infer_in_steps(rows, "index", "prompt", lambda c, p: f"{said}:{p}", path, steps=4, rate=None)
        return {r["index"]: r["response"] for r in out.collect()}

    share = {r["index"]: r["s"] for r in df.select("index", F.pmod(F.xxhash64("index"), F.lit(4)).alias("s")).collect()}
    assert run(df, "first") == {i: "first:p" for i in range(60)}
    assert run(df, "second") == {i: "first:p" for i in range(60)}
    # a share that broke off before its note is run again
    (tmp_path / "out" / "_finished" / "step=1").rename(tmp_path / "lost")
    assert run(df, "third") == {i: "third:p" if share[i] == 1 else "first:p" for i in range(60)}
    # as many rows as before, one of them changed
    changed = df.withColumn("prompt", F.when(F.col("index") == 7, "q").otherwise(F.col("prompt")))
    got = run(changed, "fourth")
    assert got[7] == "fourth:q" and {i for i in got if got[i].startswith("fourth")} == {i for i in share if share[i] == share[7]}
    # rows that are gone take their results along, also where none of a share is left
    left = df.where(F.pmod(F.xxhash64("index"), F.lit(4)) != 2)
    assert set(run(left, "fifth")) == {i for i in share if share[i] != 2}
    assert run(df.limit(0), "none") == {}


def test_the_input_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(40).select(F.col("id").alias("index"), F.lit("p").alias("prompt")).mapInArrow(counted, "index bigint, prompt string")
    assert I.infer_in_steps(df, "index", "prompt", answer, str(tmp_path / "out"), steps=3, rate=None).count() == 40
    assert seen.value == 40


def test_every_try_waits_for_the_cap():
    now, starts = [0.0], []

    def sleep(s):
        now[0] += s

    def call(client, prompt):
        starts.append(now[0])
        raise ValueError("busy")

    cap = I.RateCap(10, clock=lambda: now[0], sleep=sleep)
    for _ in range(4):
        I.call_with_retries(call, 0, "p", 3, None, cap)
    assert len(starts) == 12 and all(b - a > 0.0999 for a, b in zip(starts, starts[1:]))


def test_counters_and_responses(spark):
    df = spark.range(6).select(F.col("id").alias("index"), F.col("id").cast("string").alias("prompt"))

    def call(client, prompt):
        if prompt == "3":
            raise RuntimeError("no")
        return prompt, 10

    out = I.infer(df, "index", "prompt", call, clients=2, rate=None)
    assert sorted(map(tuple, I.counters(out).collect())) == [(0, 3, 0, 30), (1, 2, 1, 20)]
    merged = {r["index"]: r["label"] for r in I.with_responses(df, out, "index", "label").collect()}
    assert merged[3] is None and merged[4] == "4"


def test_prompt(spark):
    text = spark.range(1).select(I.render_prompt(F.lit("{x} 发热"))).first()[0]
    assert "## 给定文本\n{x} 发热\n" in text and "{description}" not in text


def test_a_batch_is_answered_a_few_rows_at_a_time(spark):
    rows = spark.range(0, 2000, 1, 1).selectExpr("id as k", "case when id % 3 <> 0 then concat('p', id) end as p")
    out = I.infer(rows, "k", "p", lambda client, prompt: (prompt.upper(), client), clients=1, rate=None, threads=2)
    sizes = out.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows])}) for b in batches), "n bigint")
    assert out.count() == 2000
    got = {r["k"]: (r["response"], r["tokens"], r["attempts"], r["error"]) for r in out.collect()}
    assert got[1] == ("P1", 0, 1, None) and got[3][0] is None and got[3][2] == 3 and "AttributeError" in got[3][3]
    assert sum(r["n"] for r in sizes.collect()) == 2000 and I.ROWS_AT_ONCE < 2000
