import random

import pytest
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.operators import notes as N

RAW = "sheet string, row_no bigint, content string, template string, diagnosis string, patient string, admission string"


def one_pass(notes, k=200):
    """The rule as a plain loop over notes in order."""
    seen, kept = set(), []
    for index, patient, scenario, text in notes:
        if not 10 <= len(text) <= k:
            continue
        if scenario == V.DAILY_SCENARIO and patient in seen:
            continue
        if V.STOP_PHRASE in text:
            continue
        seen.add(patient)
        kept.append(index)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_sub_k_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    notes = []
    for i in range(1500):
        patient = "p0" if rnd.random() < 0.4 else f"p{rnd.randint(1, 60)}"
        text = "字" * rnd.choice([3, 9, 10, 50, 200, 201]) + rnd.choice(["", "", V.STOP_PHRASE])
        notes.append((i, patient, rnd.choice([V.DAILY_SCENARIO, "emr-x"]), text))
    df = spark.createDataFrame(notes, "index bigint, patient_id string, scenario string, description string").repartition(8)
    assert sorted(r["index"] for r in N.sub_k(df).select("index").collect()) == one_pass(notes)


def test_standardise(spark):
    raw = spark.createDataFrame(
        [
            ("儿科", 5, "记录者：李四\n病情平稳", "日常病程记录", " 肺炎 ", "123", "2024-01-01"),
            (" 产科", 9, None, None, "NaN", "1234567890123", None),
            ("儿科", 2, "  ", " 入院记录　", None, None, "2024-01-02"),
        ],
        RAW,
    )
    got = [tuple(r) for r in N.standardise_notes(raw).orderBy("index").select(
        "index", "description", "department", "scenario", "patient_id", "admission_date", "disease").collect()]
    assert got == [
        (0, "", "obstetrics", "emr-", "1234567890123", "", []),
        (1, "", "pediatrics", "emr-入院记录", "000000000000", "2024-01-02", []),
        (2, "病情平稳", "pediatrics", "emr-日常病程记录", "000000000123", "2024-01-01", ["肺炎"]),
    ]


def test_numeric_patient_ids(spark):
    raw = spark.createDataFrame([("儿科", 1, "x", "t", "d", 123.0, "a"), ("儿科", 2, "x", "t", "d", float("nan"), "a")],
                                RAW.replace("patient string", "patient double"))
    assert sorted(r[0] for r in N.standardise_notes(raw).select("patient_id").collect()) == ["000000000000", "000000000123"]


def test_unknown_department_fails(spark):
    raw = spark.createDataFrame([("外科", 1, "x", "t", "d", "1", "a")], RAW)
    with pytest.raises(Exception, match="unknown department"):
        N.standardise_notes(raw).collect()


def test_disease_list_is_sorted_by_code_point(spark):
    df = spark.createDataFrame([(["b", "😀"],), (["a", "肺炎", "b"],), ([],)], "disease array<string>")
    assert [r[0] for r in N.disease_list(df).collect()] == ["a", "b", "肺炎", "😀"]


def test_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "department string")
    assert sorted(map(tuple, N.count_by(df, "department").collect())) == [("a", 2), ("b", 1)]
    assert N.from_row(spark.range(1, 6).withColumnRenamed("id", "row_no"), 2).count() == 3
    assert N.unlabelled(df.withColumn("label", F.when(F.col("department") == "b", "x"))).count() == 2


def test_missing_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (3.5,)], "x double")
    assert [r[0] for r in df.select(N.scenario("x")).collect()] == [N.V.SCENARIO_PREFIX, N.V.SCENARIO_PREFIX, N.V.SCENARIO_PREFIX + "3.5"]
