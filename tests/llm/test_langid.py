import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from notewright.llm import langid
from notewright.llm.queries import QUERIES


def test_subwords_do_not_depend_on_stretches(monkeypatch):
    text = "Hallo wärst du dà 12 x " * 50
    whole = np.bincount(np.concatenate(list(langid.subwords(text, 12))), minlength=4096)
    monkeypatch.setattr(langid, "PIECE", 64)
    parts = np.bincount(np.concatenate(list(langid.subwords(text, 12))), minlength=4096)
    assert (whole == parts).all() and whole.sum() > 0


def test_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the and of " * 9, "en"), ("der und die " * 9, "de")] * 30)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "de"), (None, "the of and", None), (103, "中文字" * 3, None), (104, "und die der " * 100_000, None), (0, "the and", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    model = langid.fit(df, F.col("text"), F.col("lang"), F.col("doc_id"))
    got = langid.predict(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].lang_score == 0 and by[i].lang_rejected for i in (100, 101, 102))
    assert by[103].lang_rejected and by[103].lang_pred in ("en", "de")
    assert by[104].lang_pred == "de" and by[None].lang_pred == "en" and not by[104].lang_rejected
    empty = langid.fit(df.limit(0), F.col("text"), F.col("lang"), F.col("doc_id"))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_held_out_accuracy_and_same_model_at_any_partitioning(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = QUERIES["op4_language_id"](spark, folder).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    assert sum(r.rejected for r in got) / len(got) < 0.01
    models = [langid.fit(d, F.col("text"), F.col("lang"), F.col("doc_id")) for d in (docs, docs.repartition(7))]
    assert np.array_equal(models[0].embeddings, models[1].embeddings)


def test_rejection_by_the_calibrated_limit_and_any_number_of_languages():
    r = np.random.default_rng(1)
    scores = 1 / (1 + np.exp(-(4 + r.exponential(1, 400_000) * -0.5)))
    few = langid.limit_of(scores[:3000], 0.0005)
    assert abs(np.log(few / (1 - few)) - np.log(np.quantile(scores, 0.0005) / (1 - np.quantile(scores, 0.0005)))) < 0.6
    assert langid.limit_of(np.array([]), 0.1) == 0.0 and langid.limit_of(np.full(50, 0.9), 0.001) <= 0.9
    s = langid.Settings(epochs=2)
    model = langid.train([(f"l{i:03}", *langid.bag(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3, s.bits)) for i in range(520) for _ in range(2)], s)
    assert len(model.languages) == 520


def test_fitting_holds_no_lists_and_sorts_as_before():
    r = np.random.default_rng(2)
    rows = [(lang, *langid.bag("".join(r.choice(list("abcdef "), 60)), 15)) for lang in ("x", "y") for _ in range(40)]
    rows += rows[:5]
    table = pa.table({"label": pa.array([x[0] for x in rows]), "at": pa.array([x[1] for x in rows], pa.list_(pa.int32())), "share": pa.array([x[2] for x in rows], pa.list_(pa.float32()))})
    table = pa.concat_tables([table.slice(0, 30), table.slice(30)])
    got = langid.sampled(table)
    assert [(x, a.tolist(), v.tolist()) for x, a, v in got] == [(x, a.tolist(), v.tolist()) for x, a, v in rows]
    assert all(a.base is not None and v.base is not None and v.dtype == np.float32 for _, a, v in got)  # parts of the table's arrays
    wide = [(x, a.astype(np.int64), v.astype(np.float64)) for x, a, v in rows]
    s = langid.Settings(epochs=2)
    assert np.array_equal(langid.train(got, s).embeddings, langid.train(wide[::-1], s).embeddings)
    assert langid.sampled(table.slice(0, 0)) == []
