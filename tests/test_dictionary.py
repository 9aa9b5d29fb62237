import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.functions.runs import MOST_WORDS, RunFilter, Runs
from notewright.operators import dictionary as T


def brute(texts, terms):
    return sorted((k, w) for k, x in texts if x for w in terms if w and w in x)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    letters = "ab症型\n😀é"
    texts = [(i, "".join(rnd.choices(letters, k=rnd.choice([0, 1, 5, 40, 300])))) for i in range(250)]
    terms = {"".join(rnd.choices(letters, k=rnd.randint(1, 14))) for _ in range(150)}
    # terms cut from the texts, and a third of all terms with the same long beginning
    terms |= {x[s:s + n] for _, x in texts for s, n in [(rnd.randint(0, max(len(x) - 1, 0)), rnd.choice([1, 3, 4, 7, 11, 15, 30]))] if x}
    terms |= {"常染色体显性遗传的综合征" + str(i) for i in range(120)}
    texts += [(1000 + i, f"见常染色体显性遗传的综合征{i}。") for i in range(40)]
    return texts, sorted(terms)


def test_equal_runs_have_equal_numbers():
    rnd, seen = random.Random(12), {}
    for _ in range(200):
        text = "".join(rnd.choices("ab\x00症😀", k=rnd.randint(0, 30)))
        for length, stride in [*T.RUNS, (15, 1), (7, 3)]:
            got = Runs(text).of(length, stride).tolist()
            want = [text[i : i + length] for i in range(0, len(text) - length + 1, stride)]
            assert len(got) == len(want) and all(seen.setdefault(w, g) == g for w, g in zip(want, got))
    assert len(set(seen.values())) == len(seen)


def test_filter_lets_all_members_through_and_few_others(spark):
    rnd = random.Random(13)
    members, others = ([rnd.getrandbits(64) - 2**63 for _ in range(20_000)] for _ in range(2))
    made = RunFilter.of(spark.createDataFrame([(m,) for m in members], "r long"), "r", len(members))
    assert made.passing(np.array(members)).tolist() == members
    assert len(made.passing(np.array(others))) < 400 and made.words.nbytes <= 8 * MOST_WORDS


@pytest.mark.parametrize("max_rows", [10**6, 0], ids=["broadcast", "shuffled"])
def test_find_terms(spark, corpus, max_rows):
    texts, terms = corpus
    texts = [*texts, (5000, None)]
    a = spark.createDataFrame(texts, "k bigint, x string").repartition(4)
    b = spark.createDataFrame([(w,) for w in [*terms, ""]], "w string")
    assert sorted(map(tuple, T.find_terms(a, b, "k", "x", "w", max_rows).collect())) == brute(texts, terms)


def test_find_terms_without_terms(spark):
    a = spark.createDataFrame([(1, "abc")], "k bigint, x string")
    assert T.find_terms(a, spark.createDataFrame([], "w string"), "k", "x", "w").count() == 0


def test_no_pair_is_compared_without_a_shared_run(spark, corpus):
    texts, terms = corpus
    a = spark.createDataFrame(texts, "k bigint, x string")
    b = spark.createDataFrame([(w,) for w in terms], "w string")
    for max_rows in (10**6, 0):
        plan = T.find_terms(a, b, "k", "x", "w", max_rows)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_known_dictionary_moves_no_text(spark, corpus):
    texts, terms = corpus
    a = spark.createDataFrame(texts, "k bigint, x string")
    b = spark.createDataFrame([(w,) for w in terms], "w string")
    plan = T.find_terms(a, b, "k", "x", "w")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    # beyond the bytes the shuffle form takes over
    assert "_salt" in T.find_terms(a, b, "k", "x", "w", max_bytes=100)._jdf.queryExecution().executedPlan().toString()


def test_match_pages_takes_the_longest_variant(spark):
    pages = spark.createDataFrame([(1, "a 甲型肝炎综合征 b"), (2, "甲型肝炎"), (3, "nothing")], "page_id bigint, html string")
    diseases = spark.createDataFrame([(7, ["甲型肝炎综合征", "甲型肝炎"]), (8, ["乙"])], "disease_id bigint, variants array<string>")
    assert sorted(map(tuple, T.match_pages(diseases, pages).collect())) == [(1, 7, "甲型肝炎综合征"), (2, 7, "甲型肝炎")]


def test_dictionary(spark):
    rows = spark.createDataFrame(
        [(1, "0000001", "一"), (2, "HP:0000001", "二"), (3, "HP:0000002", None), (4, None, "三"), (5, "HP:3", "未找到中文翻译")],
        "row_no bigint, hpo_id string, zh string",
    )
    d = T.term_dictionary(rows)
    assert sorted(map(tuple, d.collect())) == [("HP:0000001", "二"), ("HP:3", "未找到中文翻译")]
    assert ("HP:0000002", "nan") in map(tuple, T.term_dictionary(rows, legacy=True).collect())
    found = spark.createDataFrame([(1, 0, "HP:3"), (1, 1, "HP:0000001"), (1, 2, "HP:0000001"), (2, 0, "HP:9")], "idx bigint, pos int, hpo_id string")
    translated = T.translate_ids(found, d)
    assert T.collect_terms(translated, "idx", "pos", "zh", "names").collect() == [(1, ["二", "二"])]


def test_tagger_output(spark):
    text = "id\tname\nHP:1\ta\n\n  \nHP:2\nMP:3\tx\nHP:4\tb\tc"
    df = spark.createDataFrame([(1, text), (2, "only header"), (3, ""), (4, None)], "idx bigint, t string")
    assert [r["hpo_id"] for r in T.tagged_lines(df, "t").orderBy("idx", "pos").collect()] == ["HP:1", "HP:4"]


def test_validation(spark):
    df = spark.createDataFrame([(1, " 发热　"), (2, "咳嗽"), (3, None)], "i int, term string")
    terms = T.term_set(spark.createDataFrame([("发热 ",), (None,)], "zh string"))
    got = {r["i"]: (r["is_standard"], r["display"]) for r in T.validate_terms(df, terms).collect()}
    assert got == {1: (True, " 发热　"), 2: (False, "【咳嗽】"), 3: (False, None)}
    assert all(r["is_standard"] for r in T.validate_terms(df, terms.where(F.lit(False))).collect())


def test_a_known_dictionary_opens_only_what_a_text_contains(spark):
    """The rows that leave a text's own row are its terms: no text is repeated for each of its runs."""
    texts = [(1, "abcdefgh ijklmnop"), (2, "bcdef xyz"), (3, None), (4, ""), (1, "abcdefgh")]
    terms = ["abcd", "cdef", "efgh ij", "abcdefgh ijklmnop", "z", "xy", "nop", "klmnop", "bcdefg", "cdefX", "gh ijklmnopq", "術語"]
    a, b = spark.createDataFrame(texts, "k bigint, x string"), spark.createDataFrame([(w,) for w in terms], "w string")
    found = T.find_terms(a, b, "k", "x", "w")
    assert sorted(tuple(r) for r in found.collect()) == sorted((k, w) for k, x in texts for w in terms if x and w in x)
    before = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[-1]
    assert "ArrayType(StringType" not in before and "_runs" not in before


def test_terms_looked_up_in_a_text(spark):
    import numpy as np
    from notewright.functions.runs import FiledTerms, Runs

    terms = ["abcd", "abcdz", "zabcd", "術語"]
    filed = FiledTerms.made(np.array([7, 7, 7, 3]), np.array([0, 1, 2, 3]), terms)
    for text, runs, want in (("xabcdx", [7], [0]), ("zabcdz", [7], [0, 1, 2]), ("zz術語", [3, 5], [3]), ("abc", [7], []), ("", [], [])):
        assert filed.within(text, Runs(text), np.array(runs, np.int64)) == want
