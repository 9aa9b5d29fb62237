import random
import re

import pytest
from conftest import sha

from notewright.llm import phrase_dedup as pd
from notewright.llm.queries import QUERIES


def brute(rows, length):
    """(n_words, removed places, kept) of every row, from a dictionary of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - length + 1):
                x = tuple(w[k : k + length])
                first[x] = min(first.get(x, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((len(w), gone, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def made(r, n):
    vocab = ["".join(r.choice("abcdé𝒳") for _ in range(r.randint(1, 4))) for _ in range(50)] + [" ", "　x", "\x1c", " "]
    passages = [[r.choice(vocab) for _ in range(r.randint(6, 30))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(0, 40))]
        for _ in range(r.choice([0, 0, 1, 2])):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 1)
            w += p[a : a + r.randint(1, 30)] + [r.choice(vocab) for _ in range(r.randint(0, 5))]
        rows.append((i * 3 - 20, r.choice(["", " ", "\n"]) + "".join(x + r.choice([" ", "  ", "\n", "\t\r\n", "\x0b\x0c"]) for x in w)))
    return rows


def test_words_and_pieces():
    r, s, powers = random.Random(1), pd.Settings(words=6, gram=2, run=7), pd.Powers()
    seen, marks = {}, {}
    for _, t in [*made(r, 60), (0, "a " * 300), (0, "x" * 3_000_000 + " y " * 20)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        h = pd.word_hashes(t.encode(), powers)
        assert len(h) == len(words)
        for w, x in zip(words, h.tolist()):
            assert seen.setdefault(w, x) == x
        first, count, key, mark = pd.pieces_of(h, s, powers)
        assert count.sum() == max(0, len(words) - 5) and (not len(count) or count.max() <= 7)
        for f, n, k, m in zip(first.tolist(), count.tolist(), key.tolist(), mark.tolist()):
            assert marks.setdefault(("piece", *words[f : f + n + 5]), m) == m
            for i in range(f, f + n):
                assert marks.setdefault(tuple(words[i : i + 6]), k) == k
    assert len(set(seen.values())) == len(seen)
    pieces = [m for k, m in marks.items() if k[0] == "piece"]
    assert len(set(pieces)) == len(pieces)


@pytest.mark.parametrize("s", [pd.Settings(words=6, gram=2, run=7, hot=10**6, shard_words=200), pd.Settings(words=6, gram=2, run=4, hot=1, shard_words=500), pd.Settings(words=5, gram=1, hot=6)])
def test_rows_against_brute_force(spark, s):
    r = random.Random(2)
    rows = made(r, 150) + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "a " * 500), (905, "a " * 100), (906, "b a " * 60)]
    rows += [(1000 + i, rows[30 + i][1]) for i in range(8)] + [(1100, " ".join(t or "" for _, t in rows[:90]))]
    rows += [rows[70], rows[70], (rows[60][0], rows[61][1]), (rows[62][0], rows[20][1] + " and more of it here now"), (None, rows[20][1]), (None, None)]
    df = spark.createDataFrame([(i, t, "k", "x", 7) for i, t in rows], "doc_id long, text string, kept string, _spans string, doc int").repartition(6)
    got = pd.without_repeats(df, s=s).collect()
    key = lambda i, t: (i is None, i or 0, t is None, t or "")
    want = sorted(((key(i, t), *b) for (i, t), b in zip(rows, brute(rows, s.words))), key=lambda x: x[0])
    got = sorted(got, key=lambda x: key(x.doc_id, x.text))
    assert len(got) == len(want) and sum(bool(x.repeats.spans) for x in got) > 20
    for x, (_, n, gone, kept) in zip(got, want):
        spans = x.repeats.spans
        assert {k for y in spans for k in range(y.start, y.end)} == gone and all(a.end < b.start for a, b in zip(spans, spans[1:]))
        assert (x.repeats.n_words, x.repeats.kept) == (n, kept) and (x.kept, x._spans, x.doc) == ("k", "x", 7)
    assert pd.without_repeats(df.limit(0), s=s).count() == 0


def test_query_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: b for (i, _), b in zip(rows, brute(rows, 13))}
    got = QUERIES["op12_phrase_dedup"](spark, small).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, len(gone), sha(kept))
