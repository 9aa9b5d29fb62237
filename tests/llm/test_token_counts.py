import random

import pytest
from compare import connect, differences

from notewright.llm import token_counts as tc
from notewright.llm.common import shared_folder
from notewright.llm.queries import ORACLES, QUERIES


def test_random_batches_against_plain_python(spark):
    r, store, now = random.Random(5), shared_folder(spark, "counts"), {}
    for batch in range(4):
        events = []
        for seq in range(40):
            doc, tok = r.choice([*range(12), None]), r.choice(["a", "b"])
            op, n = r.choice(["insert", "revise", "delete"]), r.choice([None, 0, 3, 50])
            e = (doc, tok, r.choice(["s", None]), r.choice(["en", "de"]), n, op, seq)
            events.append(e)
            if doc is not None:
                if op == "delete":
                    now.pop((doc, tok), None)
                else:
                    now[doc, tok] = (e[2], e[3], n or 0)
        df = spark.createDataFrame(events, tc.EVENTS)
        assert tc.apply_batch(spark, store, batch, df)
        assert not tc.apply_batch(spark, store, batch, df)
        want = {}
        for (_, tok), (source, lang, n) in now.items():
            docs, tokens = want.get((source, lang, tok), (0, 0))
            want[source, lang, tok] = docs + 1, tokens + n
        assert {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in tc.totals(spark, store).collect()} == want


def test_a_batch_that_broke_off_is_written_anew(spark):
    store = shared_folder(spark, "counts")
    df = spark.createDataFrame([(1, "a", "s", "en", 7, "insert", 0)], tc.EVENTS)
    tc.apply_batch(spark, store, 1, df)
    # state and sums of batch 2 are there, its marker is not
    df.selectExpr("doc_id", "tokenizer", "source", "lang", "n_tokens * 9 as n_tokens", "true as alive").write.parquet(f"{store}/state/batch=2/attempt=x")
    df.selectExpr("source", "lang", "tokenizer", "99L as n_docs", "99L as n_tokens").write.parquet(f"{store}/deltas/batch=2/attempt=x")
    assert [tuple(x) for x in tc.totals(spark, store).collect()] == [("s", "en", "a", 1, 7)]
    tc.apply_batch(spark, store, 2, df.selectExpr("doc_id", "tokenizer", "source", "lang", "9L as n_tokens", "'revise' as op", "seq"))
    assert [tuple(x) for x in tc.totals(spark, store).collect()] == [("s", "en", "a", 1, 9)]
    assert tc.totals(spark, shared_folder(spark, "none")).count() == 0
    tc.apply_batch(spark, store, 3, df.limit(0))
    assert tc.totals(spark, store).count() == 1


def test_batches_out_of_order_are_refused(spark):
    store = shared_folder(spark, "counts")
    for batch, n in ((1, 10), (3, 20)):
        tc.apply_batch(spark, store, batch, spark.createDataFrame([(1, "a", "s", "en", n, "insert", 0, "extra")], tc.EVENTS + ", batch string"))
    with pytest.raises(ValueError, match="comes after"):
        tc.apply_batch(spark, store, 2, spark.createDataFrame([(1, "a", "s", "en", 30, "revise", 0)], tc.EVENTS))
    assert not tc.apply_batch(spark, store, 1, spark.createDataFrame([], tc.EVENTS))
    tc.apply_batch(spark, store, 7, spark.createDataFrame([(1, "a", "s", "en", 40, "revise", 0)], tc.EVENTS))
    assert [x.n_tokens for x in tc.totals(spark, store).collect()] == [40]


def test_null_texts_count_no_tokens(spark):
    got = spark.createDataFrame([(None,), ("",), ("a b",)], "text string").select(*[tc.count_tokens(tc.F.col("text"), x) for x in tc.COUNTERS]).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (2, 2)]


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    n, wrong = differences(QUERIES["op9_token_counts"](spark, folder), connect(folder), ORACLES["op9_token_counts"])
    assert n and not wrong, wrong
