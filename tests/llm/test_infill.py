import re

import pytest
from compare import connect, differences

from notewright.llm import infill
from notewright.llm.queries import ORACLES, QUERIES


def plainly(text, doc_id, s):
    """(n, form, prefix, middle, suffix, output), step by step."""
    from conftest import sha

    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = sha(f"{s.seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in s.marks) or h3 % 100 >= s.percent:
        return len(units), "plain", None, None, t
    if h4 % 100 < s.spm_percent:
        return len(units), "spm", len(pre), len(mid), s.suffix + suf + s.prefix + pre + s.middle + mid
    return len(units), "psm", len(pre), len(mid), s.prefix + pre + s.suffix + suf + s.middle + mid


TEXTS = [None, "", "\n", "\n\n\n", "one line", "one\n", "a\nb\nc", "a\r\nb\u2028c\u0085d\x0be\n\nf", "é😀\n😀😀\n\U0001f9d1\u200d\U0001f33e", "has <P> inside\nx", "a<\nP><S\n>x<", "<M>",
         "$1 \\2 \\E\n\\Q$3\n", "x" * 300_000, "line\n" * 40_000, "\n" * 50_000 + "end", " \t\n \x00 \n"]


@pytest.mark.parametrize("s", [infill.Settings(), infill.Settings(seed=3, percent=60, spm_percent=0), infill.Settings(prefix="$a", middle="$\\", suffix="$1")])
def test_against_plain_python(spark, s):
    rows = [(i, t, "x", i % 3) for i in range(12) for t in TEXTS] + [(None, "a\nb\nc\n", "x", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, form int").repartition(5)
    got = infill.transform(df, s=s).withColumn("back", infill.restored(infill.F.col("infill.output"), infill.F.col("infill.form"), s)).collect()
    assert len(got) == len(rows)
    for r in got:
        x = r.infill
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plainly(r.text, r.doc_id, s)
        assert r.back == (r.text or "") and r.n == "x"
    assert infill.transform(df.limit(0), s=s).count() == 0


def test_marks_that_could_run_together(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in ({"prefix": "<<P"}, {"prefix": "[P]"}, {"prefix": "<S>"}):
        with pytest.raises(ValueError):
            infill.transform(df, s=infill.Settings(**marks))


def test_result_replaces_its_own_column_only(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, 6)], "doc_id long, text string, infill int, _infill int")
    row = infill.transform(df).first()
    assert row._infill == 6 and row.infill.n == 2


def test_no_shuffle(spark, small):
    plan = QUERIES["op11_infill"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_query_against_sql(spark, small):
    rows, wrong = differences(QUERIES["op11_infill"](spark, small), connect(small), ORACLES["op11_infill"])
    assert rows and not wrong, wrong
