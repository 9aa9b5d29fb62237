"""Text expressions against Python's own str and re on random strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from notewright import fixed_values as V
from notewright.functions import deid as D
from notewright.functions import text as X
from notewright.operators import notes as N

PIECES = [
    "姓名：", "姓名:", "性别：男", "性别:女", "年龄：", "13岁", "科室:", "床号:", "父姓名：", "母姓名：", "操作者：", "操作医师:", "记录者：", "记录者",
    "医师签字：", "无", "申请医师签名：", "会诊医师签名:", "以上处理是在", "指导下进行的", "转科时间：2023年07月13日", "２０２３年", "科室联系电话：",
    "医务处联系电话:", "张三", "。", "，", ",", " ", "　", "\n", "\r", "\t", "\x1c", "\x85", "\xa0", " ", "😀", "a", "B.", "9", "２", "/", "\\",
    ":", "|", "?", "*", '"', "<", ">", "_", ".", "﻿", "\x00", "(", "（", "综合征", "型", "症", "2024-01-05 08:30", "2024-13-05 08:30",
]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    out = ["", " ", "　 \x1ca b \x1f", "﻿", "...", "a.. ", " .a. "]
    out += ["".join(rnd.choices(PIECES, k=rnd.randint(1, 25))) for _ in range(3000)]
    return out


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(8).cache()


def check(rows, texts, column, expected):
    got = {r[0]: r[1] for r in rows.select("i", column).collect()}
    wrong = [(x, got[i], expected(x)) for i, x in enumerate(texts) if got[i] != expected(x)]
    assert not wrong, wrong[:3]


def test_trim(rows, texts):
    check(rows, texts, X.trim_u("x"), str.strip)


def test_ltrim(rows, texts):
    check(rows, texts, X.ltrim_u("x"), str.lstrip)


def test_zero_pad(rows, texts):
    check(rows, texts, X.zero_pad("x", 12), lambda x: x.rjust(12, "0"))


def safe(x):
    x = re.sub(r"[\x00-\x1f]", "", x.replace("﻿", "").strip())
    x = x.translate({ord(c): "_" for c in "/\\:|"} | {ord(c): None for c in '?*"<>'})
    x = re.sub("[ _]{2,}", "_", x)
    return x.strip().strip(".").strip().rstrip(". ") or "unknown"


def test_safe_name(rows, texts):
    check(rows, texts, X.safe_name("x"), safe)


def test_safe_name_of_null(spark):
    assert spark.range(1).select(X.safe_name(F.lit(None).cast("string"))).first()[0] == "unknown"


def bracketless(x):
    x = x.strip()
    mark = "(" if "(" in x else "（"
    return x.split(mark)[0].strip()


def test_disease_name(rows, texts):
    check(rows, texts, X.disease_name("x"), bracketless)


def variants(x):
    out = {x, re.sub(r"\d+型$", "", x)}
    if x.endswith("型") or x.endswith("症"):
        out.add(x[:-1])
    if x.endswith("综合征"):
        out |= {x[:-3], x.replace("综合征", "").strip()}
    return sorted(out - {""})


def test_disease_variants(rows, texts):
    check(rows, texts, F.array_sort(X.disease_variants("x")), lambda x: sorted(variants(x), key=lambda v: v.encode("utf-8")))


RULES = [
    (D.newborn_header, V.NEWBORN_HEADER, re.DOTALL, ""), (D.name_block, V.NAME_BLOCK, 0, ""), (D.phones, V.PHONES, 0, ""),
    (D.father_block, V.FATHER, re.DOTALL, ""), (D.mother_block, r"母姓名[：:].*?(?=[。\n]|$)", re.DOTALL, ""),
    (D.operators, V.OPERATOR, 0, ""), (D.guidance, V.GUIDANCE, 0, ""), (D.recorder, V.RECORDER, 0, ""),
    (D.physician, V.PHYSICIAN, 0, ""), (D.signature_label, V.SIGNATURE_LABEL, 0, ""), (D.double_commas, V.DOUBLE_COMMA, 0, "，"),
    (D.wide_gaps, V.WIDE_GAP, 0, " "),
]


@pytest.mark.parametrize("rule,pattern,flags,repl", RULES, ids=[r[0].__name__ for r in RULES])
def test_rule(rows, texts, rule, pattern, flags, repl):
    check(rows, texts, rule("x"), lambda x: re.sub(pattern, repl, x, flags=flags))


def test_whole_deidentification(rows, texts):
    def expected(x):
        if not x.strip():
            return ""
        x = x.replace(V.REQUEST_FORM, "")
        for _, pattern, flags, repl in RULES[:10]:
            x = re.sub(pattern, repl, x, flags=flags)
        x = x.replace("张三", "")
        x = re.sub(V.WIDE_GAP, " ", re.sub(V.DOUBLE_COMMA, "，", x))
        return re.sub(V.BLANK_LINES, "\n\n", x).strip()

    check(rows, texts, D.deidentify("x", F.lit(["张三", "张", " 张三 "])), expected)


def test_names_go_longest_first(spark):
    df = spark.createDataFrame([("张小明和张小", ["张小", "张小明", "明"])], "x string, n array<string>")
    assert df.select(D.drop_names("x", "n")).first()[0] == "和"
    assert df.select(D.usable_names("n")).first()[0] == ["张小明", "张小"]


def test_deidentify_runs_in_the_jvm(rows):
    plan = rows._jdf.queryExecution().toString() + rows.select(D.deidentify("x"))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan


def test_name_extractor_skips_blank_texts(spark):
    df = spark.createDataFrame([(1, "张三来"), (2, " "), (3, None)], "i int, x string")

    def load():
        def model(batch):
            assert all(b.strip() for b in batch)
            return [["张三", " 张三 ", "张"] for _ in batch]

        return model

    got = {r[0]: r[1] for r in df.select("i", D.person_names("x", load)).collect()}
    assert got == {1: ["张三"], 2: [], 3: []}


def test_stamp(rows, texts):
    stamp = re.compile(V.STAMP)

    def expected(x):
        m = stamp.match(x)
        return x[m.end():].lstrip() if m else x

    def legacy(x):
        m = stamp.match(x)
        return x[m.end():][:1].strip() if m else x

    check(rows, texts, N.strip_stamp("x"), expected)
    check(rows, texts, N.strip_stamp("x", legacy=True), legacy)


def test_preview(rows, texts):
    check(rows, texts, X.preview("x", 5), lambda x: x[:5] + "..." if len(x) > 5 else x)


def test_boilerplate_order(spark):
    df = spark.createDataFrame([("".join(V.BOILERPLATE) + "其余",)], "x string")
    assert df.select(N.strip_boilerplate("x")).first()[0] == "其余"
