import random

from pyspark.sql import functions as F

from notewright.operators import review as Q


def test_first_submission_wins_with_a_hot_id(spark):
    rnd = random.Random(2)
    subs = [(s, rnd.choice([1, 1, 1, *range(50)])) for s in rnd.sample(range(10_000), 3000)]
    df = spark.createDataFrame(subs, "seq bigint, index bigint").repartition(6)
    log = spark.createDataFrame([(3,), (3,), (7,)], "index bigint")
    seen, expected = {3, 7}, {}
    for s, i in sorted(subs):
        expected[s] = i not in seen
        seen.add(i)
    assert {r["seq"]: r["accepted"] for r in Q.accept(df, log).collect()} == expected


def test_progress(spark):
    samples = spark.range(8).withColumnRenamed("id", "index")
    log = spark.createDataFrame([(1,), (1,), (99,), (None,)], "index bigint")
    assert tuple(Q.progress(samples, log).first()) == (8, 2, 7, 25.0)
    assert tuple(Q.progress(samples.where("index < 0"), log.where("index < 0")).first()) == (0, 0, 0, 0.0)
    # 1 of 16 is 6.25 percent: halves go to the even digit
    sixteen = spark.range(16).withColumnRenamed("id", "index")
    assert Q.progress(sixteen, log.where("index = 1")).first()["percentage"] == 6.2


def test_queue_and_navigation(spark):
    samples = spark.createDataFrame([(i,) for i in (5, 0, 9, 12, 20)], "index bigint")
    queue = Q.review_queue(samples, spark.createDataFrame([(9,), (None,)], "index bigint"))
    order = [0, 5, 12, 20]
    assert sorted(r[0] for r in queue.collect()) == order
    asked = [(a, c) for a in ("init", "next", "prev", "stay") for c in (0, 5, 20, 9, None)]
    requests = spark.createDataFrame(asked, "action string, current_id bigint")

    def target(action, current):
        at = order.index(current) if current and current in order else 0
        at = {"init": 0, "next": at + 1, "prev": max(at - 1, 0)}.get(action, at)
        return order[at] if at < len(order) else None

    got = {(r["action"], r["current_id"]): r["target"] for r in Q.navigate(queue, requests).collect()}
    assert got == {(a, c): target(a, c) for a, c in asked}


def test_defaults(spark):
    schema = "index bigint, is_sure boolean, patient_phenotypes array<string>, family_phenotypes array<string>, patient_phenotypes_neg array<string>, family_phenotypes_neg array<string>"
    df = spark.createDataFrame([(1, None, ["a"], None, None, None), (2, False, None, None, None, None)], schema)
    got = {r["index"]: r for r in Q.with_submission_defaults(df).collect()}
    assert (got[1]["is_sure"], got[1]["patient_phenotypes"], got[1]["family_phenotypes"]) == (True, ["a"], [])
    assert [r["index"] for r in Q.sure(Q.with_submission_defaults(df), False).collect()] == [2]


def test_prepared_samples(spark):
    labels = "struct<patient_phenotypes:array<string>,family_phenotypes:array<string>,patient_phenotypes_neg:array<string>,family_phenotypes_neg:array<string>>"
    df = spark.createDataFrame(
        [(1, None, [["HP:1", "a"], []]), (2, (["x"], None, None, None), None)],
        f"index bigint, human_annotated {labels}, llm_predict array<array<string>>",
    )
    got = {r["index"]: r for r in Q.prepared_samples(df).collect()}
    assert tuple(got[1]["human_annotated"]) == ([], [], [], [])
    assert got[1]["llm_predict"] == ["HP:1", None]
    assert tuple(got[2]["human_annotated"]) == (["x"], [], [], [])


def test_sure_flags(spark):
    df = spark.range(4).withColumn("is_sure", F.col("id") % 2 == 0)
    assert Q.sure(df).count() == Q.sure(df, False).count() == 2
