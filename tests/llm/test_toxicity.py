import random
import zlib

from pyspark.sql import functions as F

from notewright.llm import toxicity as tox
from notewright.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def test_automaton_against_edit_distance():
    terms = [tox.Term("idiot", False, 1, 1), tox.Term("worthless", False, 2, 2), tox.Term("scum", False, 1, 0), tox.Term("abcdefg", True, 1, 1), tox.Term("idle", False, 1, 1)]
    a, r = tox.Automaton(terms), random.Random(3)
    words = ["idiot", "idiiot", "worthles", "wrothless", "scum", "scam", "abcdefgxyz", "abdefgxyz", "xbcdefg", "", "idlo", "idio"]
    for _ in range(3000):
        w = list(r.choice(terms).text)
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(w))
            w[i : i + r.randint(0, 1)] = r.choice(["", "e", "o", "abc"])
        words.append("".join(w) + r.choice(["", "xy"]))
    for w in words:
        best = None
        for t in terms:
            d = min(distance(t.text, w)) if t.stem else distance(t.text, w)[-1]
            if d <= t.edits:
                best = d if best is None else min(best, d)
        got = a.match(w)
        assert (got and got[1]) == best, w


def test_quotation_and_misspelling_count_less():
    model = tox.Model([tox.Term("idiot", False, 1.0, 1)], weights=(4.0, -0.3), bias=-2.0)
    s = model.scanner()
    score = lambda t: model.score(*s.sums(s.hits(t)))
    assert score("you idiot") > score("an idiot here") > score("an idiott here") > score("none here")
    assert score("an idiot here") > score('he said "an idiot here" today') > score("")
    assert score(None) == score("") and s.hits("") == []


def test_odd_rows(spark):
    rows = [(i, t, 0) for i, t in enumerate([None, "", "x " * 200_000 + "blorgit", "fine words", "fine words"])]
    r = random.Random(1)
    words = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(12))
    rows += [(10 + i, f"{words()} blorgit {words()}", 1) for i in range(60)] + [(100 + i, words(), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity int")
    labels = df.where("doc_id >= 10").selectExpr("doc_id", "toxicity as toxic").union(spark.createDataFrame([(None, 1), (11, 1), (12, None)], "doc_id long, toxic int"))
    model = tox.fit(df, labels, F.col("text"), "doc_id", "toxic")
    got = {r.doc_id: r for r in tox.score(df, model).collect()}
    assert got[2].toxicity > 0.3 and got[0].toxicity == got[1].toxicity < 0.3 and got[3].toxicity < 0.3 and got[2].toxic_terms[0].term == "blorgit"
    none = tox.fit(df, labels.limit(0), F.col("text"), "doc_id", "toxic")
    assert {r.toxicity < 0.3 for r in tox.score(df, none).collect()} == {True}
    assert tox.score(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op1_toxicity"](spark, folder).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    tested = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hit = sum(p and t for p, t in tested)
    assert hit / sum(t for _, t in tested) > 0.75 and hit / sum(p for p, _ in tested) > 0.9


def test_unlike_rows_that_share_a_word_are_all_learned_from(spark):
    rows = [(i, f"the {'vile' if i % 2 else 'mild'} word{i}") for i in range(200)] + [(200 + i, f"WORD{i} the {'vile' if i % 2 else 'mild'}!") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    chosen, share = tox.sample(df, labels, F.col("text"), "doc_id", "toxic", tox.Settings())
    assert chosen.count() == 200 and share == 0.5  # the last fifty repeat the words of the first
