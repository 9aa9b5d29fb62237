import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from notewright.llm import decontamination as dc
from notewright.llm.op04_langid import fitted

from test_decontamination import brute as brute_leaks
from test_ngram_join import brute as brute_join
from test_secrets import brute as brute_secrets


def masked(text):
    out, at = "", 0
    for start, _, end in brute_secrets(text):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def test_run_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = fitted(docs)
    ids = sorted(i for i, r in rows.items() if not model.predict(r.text)[2])
    assert len(ids) > 0.98 * len(rows)
    groups = brute_join([(i, rows[i].text) for i in ids])
    ids = [i for i, (_, c) in zip(ids, groups) if i == c]
    items = [(r.item_id, *dc.question_and_answer(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    ids = [i for i in ids if not brute_leaks(rows[i].text, items, dc.Settings())]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert sorted(got) == ids and 0 < len(ids) < len(rows)
    for i in ids:
        text = masked(rows[i].text)
        assert got[i].text == text and got[i].n_chars == len(text) and got[i].lang == rows[i].lang
        assert got[i].ids == library.encode(text, add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids)


def test_stages_on_odd_rows(spark, small):
    words = "the and of to in is that for with by "
    rows = [(i, words * 3 + f"row {i} " + " ".join(f"w{i}{j}" for j in range(20)), "en", "s", None) for i in range(30)]
    rows += [(100, None, "en", "s", 0), (101, "", None, None, 0), (102, "12 34", "en", "s", 5), (None, words + "password=abcdefgh", "en", "s", 1),
             (1, rows[1][1], "en", "s", 9), (103, words * 20_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as ids", "1 as blob")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "bpe":
            assert out.columns == docs.columns, name
        got = out.collect()
        n = {"language_id": 33, "ngram_jaccard_join": 35}.get(name, 36)
        assert len(got) == n, (name, len(got))
        if name == "secret_scans":
            assert [r.text for r in got if r.doc_id is None] == [words + "[secret]"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark, small):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, text(0)), (2, text(0)), (2, text(1)), (2, text(2)), (3, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (4, text(4)),
            (5, ""), (5, None), (None, ""), (None, None), (6, text(5)), (6, text(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.deduplicated(spark, docs, small)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text or "") for r in out.collect()]
    want = [(1, text(0)), (2, text(1)), (2, text(2)), (None, text(3)), (4, text(4)), (5, ""), (None, ""), (None, ""), (6, text(5))]
    assert sorted(got, key=str) == sorted(want, key=str)
