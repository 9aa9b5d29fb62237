import json

import pytest
from pyspark.sql import functions as F

from notewright.operators import notes as N
from notewright.sources import readers as R
from notewright.sources import writers as W


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_json_array_with_missing_keys(spark, tmp_path):
    p = write(tmp_path / "a.json", json.dumps([{"index": 1, "description": "é"}, {"index": 2, "human_annotated": {"patient_phenotypes": ["x"]}, "other": 1}], indent=2))
    got = {r["index"]: r for r in R.read_samples(spark, p).collect()}
    assert got[1]["description"] == "é" and got[1]["human_annotated"] is None
    assert got[2]["human_annotated"]["patient_phenotypes"] == ["x"] and got[2]["human_annotated"]["family_phenotypes"] is None


def test_lines_strict_and_tolerant(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"index": 1}\n\n{"index": 2\n{"description": "x"}\nnonsense\n{"index": 3}\n')
    assert sorted(r["index"] for r in R.read_samples(spark, p, R.SUBMISSION_SCHEMA, lines=True, tolerant=True).collect()) == [1, 3]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        R.read_samples(spark, p, R.SUBMISSION_SCHEMA, lines=True).collect()


def test_sheets(spark, tmp_path):
    for sheet, n in (("产科", 2), ("儿科", 3)):
        spark.range(n).select(
            F.col("id").alias("row_no"), F.lit("病历").alias("病历内容"), F.lit("t").alias("病历模板类型"), F.lit("d").alias("诊断"),
            F.col("id").cast("string").alias("患者ID"), F.lit("2024").alias("入院时间"),
        ).write.parquet(str(tmp_path / "notes" / f"sheet={sheet}"))
    raw = R.read_sheets(spark, str(tmp_path / "notes"))
    got = N.standardise_notes(raw).orderBy("index").collect()
    assert [r["department"] for r in got] == ["obstetrics"] * 2 + ["pediatrics"] * 3
    assert [r["index"] for r in got] == list(range(5))


def test_sheets_with_columns_and_types_of_their_own(spark, tmp_path):
    path = str(tmp_path / "notes")
    spark.createDataFrame([(0, "a", 12.0), (1, "b", float("nan"))], "row_no bigint, `病历内容` string, `患者ID` double").write.parquet(f"{path}/sheet=产科")
    spark.createDataFrame([(0, "c", "7x", "肺炎")], "row_no int, `病历内容` string, `患者ID` string, `诊断` string").write.parquet(f"{path}/sheet=儿科")
    got = {(r.sheet, r.row_no): (r.content, r.patient, r.diagnosis) for r in R.read_sheets(spark, path).collect()}
    assert got == {("产科", 0): ("a", "12", None), ("产科", 1): ("b", None, None), ("儿科", 0): ("c", "7x", "肺炎")}
    spark.createDataFrame([(0, "d")], "row_no bigint, `病历内容` string").write.parquet(f"{path}/sheet=别科")
    with pytest.raises(Exception, match="unknown department"):
        N.standardise_notes(R.read_sheets(spark, path)).collect()


def test_sheets_are_numbered_by_place(spark, tmp_path):
    raw = spark.range(0, 6000, 3).select(
        F.col("id").alias("row_no"), F.element_at(F.lit([" 神经内科", "产科　"]), (F.col("id") % 2 + 1).cast("int")).alias("sheet"), F.lit("病历").alias("content"),
        *[F.lit(None).cast("string").alias(c) for c in ("template", "diagnosis", "patient", "admission")])
    path = str(tmp_path / "notes")
    W.write_sheets(raw, path)
    read = R.read_sheets(spark, path, numbered=True)
    got = read.orderBy("index").select("index", "sheet", "row_no").collect()
    assert len(list((tmp_path / "notes").rglob("*.parquet"))) > 4
    assert [r["index"] for r in got] == list(range(2000))
    assert [(r.sheet, r.row_no) for r in got] == [("产科", i) for i in range(3, 6000, 6)] + [("神经内科", i) for i in range(0, 6000, 6)]
    # no exchange carries a text
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = N.standardise_notes(read)._jdf.queryExecution().explainString(mode)
    moved = [x for x in plan.split("\n\n") if "Exchange" in x.split("\n")[0] and "Input" in x]
    assert moved, plan[:3000]
    assert not [x for x in moved if "content" in x or "description" in x or "病历" in x]


def test_no_folder_or_no_sheets_give_no_rows(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for name in ("empty", "missing"):
        for numbered in (False, True):
            assert R.read_sheets(spark, str(tmp_path / name), numbered=numbered).count() == 0


def test_terms_of_several_files(spark, tmp_path):
    for i in (0, 1):
        write(tmp_path / f"t{i}.csv", "HPO编号,中文翻译\n" + "".join(f"HP:{k},{i}-{k}\n" for k in range(3)))
    got = R.read_terms(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r.row_no, r.zh) for r in got] == [(3 * i + k + 1, f"{i}-{k}") for i in (0, 1) for k in range(3)]


def test_terms(spark, tmp_path, capsys):
    p = write(tmp_path / "t.csv", "HPO编号,中文翻译\nHP:1,发热\n2,\n")
    assert [(r["hpo_id"], r["zh"]) for r in R.read_terms(spark, p).orderBy("row_no").collect()] == [("HP:1", "发热"), ("2", None)]
    assert R.read_terms(spark, str(tmp_path / "missing.csv")).count() == 0
    assert R.read_terms(spark, write(tmp_path / "u.csv", "a,b\n1,2\n")).count() == 0
    assert capsys.readouterr().out.count("warning") == 2


def test_term_names(spark, tmp_path):
    p = write(tmp_path / "names.tsv", "HP:1\told\nHP:2\nHP:3\tc\textra\n\nHP:1\tnew\n")
    assert sorted(map(tuple, R.read_term_names(spark, p).collect())) == [("HP:1", "new"), ("HP:3", "c")]


def test_diseases(spark, tmp_path):
    p = write(tmp_path / "d.csv", '﻿甲 (OMIM:1),x\n\n"乙, 丙（OMIM:2）"\n   \n丁（a(b)\n(x)\n')
    assert [tuple(r) for r in R.read_diseases(spark, p).orderBy("id").collect()] == [(1, "甲"), (3, "乙, 丙"), (5, "丁（a"), (6, "")]
    with pytest.raises(Exception, match="quoted field"):
        R.read_diseases(spark, write(tmp_path / "q.csv", '"a\nb"\n')).collect()


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i}" * (i % 5) for i in range(5000)]
    p = write(tmp_path / "big.txt", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = R.numbered_lines(spark, p)
        assert [r["line"] for r in df.orderBy("line_no").collect()] == lines
        assert df.agg(F.min("line_no"), F.max("line_no")).first() == (1, 5000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_report_paths(spark, tmp_path):
    for name in ("a.docx", "~b.docx", "c.txt", "d.docx"):
        write(tmp_path / name, "x")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in R.report_paths(spark, str(tmp_path)).collect()) == ["a.docx", "d.docx"]


def test_parts_are_pruned(spark, tmp_path):
    p = str(tmp_path / "parts")
    spark.range(25).withColumn("part", F.col("id") % 5).write.partitionBy("part").parquet(p)
    df = R.only_parts(spark.read.parquet(p))
    assert df.count() == 15
    assert "PartitionFilters: [part" in df._jdf.queryExecution().toString().replace("isnotnull(", "").replace("#", " #").replace("part ", "part")


def test_samples_keep_text_unescaped(spark, tmp_path):
    p = str(tmp_path / "out")
    W.write_samples(spark.createDataFrame([(1, "发热 \"x\"\n😀")], "index bigint, description string"), p)
    text = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "out").glob("part-*"))
    assert "发热" in text and "😀" in text
    assert R.read_samples(spark, p, lines=True).first()["description"] == '发热 "x"\n😀'


def test_report_rows_in_two_forms(spark, tmp_path):
    df = spark.createDataFrame([("d", [list("abcdef"), list("ab")])], "description string, results array<array<string>>")
    W.write_report_rows(df, str(tmp_path / "full"), str(tmp_path / "public"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "public")).first()["results"] == [["e", "f"], []]
    assert spark.read.schema(df.schema).json(str(tmp_path / "full")).first()["results"] == [list("abcdef"), list("ab")]


def test_errors_only_when_there_are_any(spark, tmp_path):
    none = spark.createDataFrame([], "disease string, error string")
    assert W.write_errors(none, str(tmp_path / "e")) is False and not (tmp_path / "e").exists()
    assert W.write_errors(spark.createDataFrame([("甲", 'a "b", c')], none.schema), str(tmp_path / "e")) is True
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "e")).first()
    assert (row["disease"], row["error"]) == ("甲", 'a "b", c') and len(row["time"]) == 19


def test_appended_log_and_sorted_list(spark, tmp_path):
    p = str(tmp_path / "log")
    for i in range(3):
        W.append_submissions(spark.createDataFrame([(i, True)], "index bigint, is_sure boolean"), p)
    assert R.read_samples(spark, p, R.SUBMISSION_SCHEMA, lines=True, tolerant=True).count() == 3
    W.write_sorted_list(spark.createDataFrame([(x,) for x in ("b", "a", "😀", "肺")], "d string"), "d", str(tmp_path / "list"))
    text = "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "list").glob("part-*")))
    assert text.split() == ["a", "b", "肺", "😀"]
