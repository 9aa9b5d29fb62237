import pyarrow as pa
from pyspark.sql import functions as F

from notewright.llm import bpe, langid
from notewright.llm.common import worker_cache
from notewright.llm.op02_bpe import VOCABULARY


def test_a_worker_lets_go_of_what_operators_before_kept(spark):
    @F.arrow_udf("int")
    def held(x: pa.Array) -> pa.Array:
        import gc

        return pa.array([sum(type(o).__name__ == "BpeTables" for o in gc.get_objects())] * len(x), pa.int32())

    docs = spark.createDataFrame([(i, "some words") for i in range(64)], "doc_id long, text string").repartition(32)
    model = langid.train([], langid.Settings())
    bpe.encode(docs, VOCABULARY).agg(F.sum(F.size("ids"))).collect()
    for _ in range(3):
        langid.predict(docs, model).agg(F.count("lang_pred")).collect()
    assert max(r[0] for r in docs.select(held("text")).collect()) == 0


def test_operators_of_one_task_keep_their_own(spark):
    @F.arrow_udf("int")
    def both(x: pa.Array) -> pa.Array:
        a, b = worker_cache("a"), worker_cache("b")
        a["n"], b["n"] = a.get("n", 0) + 1, b.get("n", 0) + 1
        return pa.array([min(worker_cache("a")["n"], worker_cache("b")["n"])] * len(x), pa.int32())

    out = spark.range(64, numPartitions=1).select(both("id").alias("n"))
    assert out.first()[0] >= 1
    assert worker_cache("x") is worker_cache("x") and worker_cache("x") is not worker_cache("y")


def test_a_worker_lets_go_before_the_first_task_of_another_operator(monkeypatch):
    import pyspark

    task = iter(range(100))
    monkeypatch.setitem(pyspark.__dict__, "_notewright_worker_cache", {"task": None, "now": {}, "before": {}})
    kept = pyspark.__dict__["_notewright_worker_cache"]

    def begun(*owners):
        now = next(task)
        monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"taskAttemptId": lambda self: now})()))
        return [worker_cache(o) for o in owners]

    a, b = begun("a", "b")
    a["table"], b["table"] = 1, 2
    assert begun("a", "b") == [{"table": 1}, {"table": 2}]
    assert begun("c") == [{}]
    assert kept["now"] == {"c": {}} and not any(kept["before"].values())


def test_fitting_lets_go_of_what_operators_before_kept(spark):
    @F.arrow_udf("int")
    def held(x: pa.Array) -> pa.Array:
        import gc

        return pa.array([sum(type(o).__name__ == "BpeTables" for o in gc.get_objects())] * len(x), pa.int32())

    docs = spark.createDataFrame([(i, "some words", "en") for i in range(64)], "doc_id long, text string, lang string").repartition(32)
    bpe.encode(docs, VOCABULARY).agg(F.sum(F.size("ids"))).collect()
    for _ in range(3):
        langid.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    assert max(r[0] for r in docs.select(held("text")).collect()) == 0
