from pyspark.sql import functions as F

from notewright.functions import phenotypes as H
from notewright import fixed_values as V
from notewright.operators import reports as R


def cells(spark, tables):
    rows = [(d, t, r, c, x) for d, ts in tables.items() for t, rs in enumerate(ts, 1) for r, cs in enumerate(rs) for c, x in enumerate(cs)]
    return spark.createDataFrame(rows, "doc string, table int, row int, col int, cell string")


def test_layouts_and_sentinel(spark):
    head = [["h"]] * 3 + [["描述"]] + [["h"]] * 2
    tables = {
        "long": [head + [["a", "m", "m", "b", "m"], ["p", "p", "q"], ["分析结果：无"], ["z"]]],
        "short": [[["h"]] * 3 + [["短"]], [["h"], ["分析结果：早"], ["x", "y"], ["分析结果："], ["z"]]],
        "open": [head + [["k"]]],
        "endless": [head + [[str(i)] for i in range(6, 130)]],
    }
    df = cells(spark, tables)
    assert dict(map(tuple, R.description_cells(df).collect())) == {"long": "描述", "short": "短", "open": "描述", "endless": "描述"}
    got = {}
    for r in R.report_rows(R.body_cells(df, legacy=True)).orderBy("doc", "row").collect():
        got.setdefault(r["doc"], []).append(r["fields"])
    assert got["long"] == [["long", "a", "m", "b", "m"], ["long", "p", "q"]]
    assert got["short"] == [["short", "x", "y"]]
    assert got["open"] == [["open", "k"]]
    assert [f[1] for f in got["endless"]] == [str(i) for i in range(6, 100)]


def test_accepted_text(spark):
    runs = [(1, 1, 3, 0, 1, 0, "下", False), (1, 1, 3, 0, 0, 1, "b", None), (1, 1, 3, 0, 0, 0, "a", False), (1, 1, 3, 0, 0, 2, "gone", True)]
    df = spark.createDataFrame(runs, "doc int, table int, row int, col int, para int, run int, text string, is_deleted boolean")
    assert [r["cell"] for r in R.accepted_text(df).collect()] == ["ab下"]


def test_split(spark):
    df = spark.createDataFrame([("a；b。c，d,e、 f ;;a",), (" - ",), ("正常表型　",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(H.split_phenotypes("x")).collect()] == [["a", "b", "c", "d", "e", " f ", "a"], [], [], [], []]


def test_row_fields(spark):
    df = spark.createDataFrame([(["n", "a；b"],), (["n"],), ([],), (None,)], "r array<string>")
    assert [r[0] for r in df.select(H.row_phenotypes("r")).collect()] == [["a", "b"], [], [], []]


def test_public_fields(spark):
    df = spark.createDataFrame([(list("abcdef"),), (list("abc"),)], "r array<string>")
    assert [r[0] for r in df.select(R.public_fields("r")).collect()] == [["e", "f"], []]


def test_patient_specific(spark):
    rows = spark.createDataFrame(
        [(1, 0, "b；a；b"), (1, 1, "c；a"), (1, 2, "c"), (2, 0, "-"), (3, 1, "x")], "report_id bigint, row_no int, phenotypes string"
    )
    got = sorted((r["report_id"], r["labels"], -1 if r["pos"] is None else r["pos"], r["phenotype"]) for r in R.patient_specific(rows).collect())
    assert got == [
        (1, "all", -1, "a"), (1, "all", -1, "b"), (1, "all", -1, "c"), (1, "family", -1, "a"), (1, "family", -1, "c"),
        (1, "patient", 0, "b"), (1, "patient", 1, "a"), (1, "patient", 2, "b"), (3, "all", -1, "x"), (3, "family", -1, "x"),
    ]


def test_label_records(spark):
    rows = [
        (30, "d1", [["n", "b；a；b"], ["n", "c；a"], ["n", "c"]]), (10, "d2", [["n", "-"]]), (20, "d3", []), (40, "d4", None), (50, "d5", [["n"], ["n", "x"]])
    ]
    df = spark.createDataFrame(rows, "place bigint, description string, results array<array<string>>")
    got = {r["index"]: (r["description"], *map(list, r["human_annotated"])) for r in R.label_records(df, "place").collect()}
    assert got == {
        0: ("d2", [], [], []), 1: ("d3", [], [], []), 2: ("d1", ["b", "a", "b"], ["c", "a"], ["b", "a", "c"]),
        3: ("d4", [], [], []), 4: ("d5", [], ["x"], ["x"]),
    }


def test_a_report_with_most_rows(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("report_id"), (F.col("id") % 1000).alias("row_no"),
        F.concat(F.lit("表型"), (F.col("id") % 50).cast("string")).alias("phenotypes"),
    )
    assert R.family_phenotypes(rows).where("report_id = 7").count() == 50


def test_answers(spark):
    df = spark.createDataFrame(
        [('```json\n[["HP:1","a","b","c"],["HP:1","x"],["HP:2"],[]]\n```',), ("[]",), ("no",), (None,)], "r string"
    )
    got = [[tuple(x) for x in r[0]] for r in df.select(H.parse_annotations("r")).collect()]
    assert got == [[("HP:1", "a", "b", "c"), ("HP:2", None, None, None)], [], [], []]


def test_long_tables_are_read_to_the_sentinel(spark):
    rows = [("a", 1, r, 0, f"r{r}") for r in range(150)] + [("b", 1, r, 0, V.RESULT_SENTINEL if r == 120 else f"r{r}") for r in range(150)]
    cells = spark.createDataFrame(rows, "doc string, table int, row int, col int, cell string")
    count = lambda df: {r.doc: r["count"] for r in df.groupBy("doc").count().collect()}
    assert count(R.rows_before(cells)) == {"a": 150, "b": 120}
    assert count(R.rows_before(cells, legacy=True)) == {"a": 100, "b": 120}
    assert count(R.body_cells(cells))["a"] > count(R.body_cells(cells, legacy=True))["a"]
    assert {r.doc for r in R.without_sentinel(cells).collect()} >= {"a"}
