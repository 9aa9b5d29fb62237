import hashlib
import random

import numpy as np

from notewright.llm import suffix_dedup as sd
from notewright.llm.queries import QUERIES


def brute(rows, length):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)} from a dictionary of all strings."""
    data = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(data):
        for k in range(len(data[i]) - length + 1):
            first.setdefault(data[i][k : k + length], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_suffix_order_against_sorting():
    r = random.Random(1)
    for _ in range(300):
        k = r.choice([1, 2, 5])
        s = [r.randint(1, k) for _ in range(r.randint(1, 200))] + [0]
        got = sd.suffix_order(np.array(s, dtype=np.int16), k + 1, 1000, r.choice([100, 10**6]))
        assert got.tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_equal_windows():
    r = random.Random(2)
    for _ in range(200):
        parts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(8, 30))) for _ in range(r.randint(1, 20))]
        owner, place, group = sd.equal_windows(parts, 8, 1000)
        assert len(owner) == sum(len(x) - 7 for x in parts)
        keys = {}
        for a, b, c in zip(owner, place, group):
            assert keys.setdefault(c, parts[a][b : b + 8]) == parts[a][b : b + 8]
        assert len(set(keys.values())) == len(keys)


def test_equal_strings_have_equal_anchors():
    r, s = random.Random(3), sd.Settings(length=12, gram=4)
    text = bytes(r.choice(b"abc") for _ in range(600))
    seen = {}
    first, count, key = sd.anchors(text, s)
    assert count.sum() == len(text) - 11
    for f, n, k in zip(first, count, key):
        for i in range(f, f + n):
            assert seen.setdefault(text[i : i + 12], k) == k


def test_rows_against_brute_force(spark):
    r, s = random.Random(4), sd.Settings(length=20, gram=4, shard_bytes=3000)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    passage = [" ".join(r.choice(vocab) for _ in range(12)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "x" * 3000), (4, "x" * 500), (5, "x" * 20), (6, "x" * 19)]
    for i in range(10, 130):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(1, 60)))
        if r.random() < 0.5:
            t += r.choice(passage)[r.randint(0, 9) :] + t[: r.randint(0, 30)]
        rows.append((i, t))
    rows += [(200 + i, rows[20 + i][1]) for i in range(8)] + [(300, "".join(t or "" for _, t in rows[:90]))]
    df = spark.createDataFrame([(i, t, "k", "x") for i, t in rows] + [(None, rows[20][1], "k", "x")], "doc_id long, text string, kept string, first string")
    want = brute(rows, 20)
    got = sd.without_repeats(df, s=s).collect()
    assert len(got) == len(rows) + 1
    for x in got:
        if x.doc_id is None:
            assert x.repeated_spans == [] and bytes(x.kept) == rows[20][1].encode()
        else:
            n, removed, spans, kept = want[x.doc_id]
            assert (len(x.repeated_spans), sum(y.end - y.start for y in x.repeated_spans), bytes(x.kept)) == (spans, removed, kept), x.doc_id
    assert sd.without_repeats(df.limit(0), s=s).count() == 0


def test_rows_that_share_an_id_and_clashing_names(spark):
    c, x, y = "one passage of forty letters or more, it is" * 3, "with an end" * 9, "nothing that stands anywhere else " * 5
    df = spark.createDataFrame([(1, c, 5), (2, c + x, 6), (2, y, 7)], "doc_id long, text string, _spans int")
    got = {(r.doc_id, r.text): (bytes(r.kept).decode(), r._spans) for r in sd.without_repeats(df).collect()}
    assert got == {(1, c): (c, 5), (2, c + x): (x, 6), (2, y): (y, 7)}


def test_query_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 50)
    got = QUERIES["op5_suffix_dedup"](spark, small).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_runs_of_stretches_are_ranked_as_one_number(monkeypatch):
    monkeypatch.setattr(np, "lexsort", None)  # sorting by two columns took most of a shard's time
    r = random.Random(11)
    for letters in ("ab", "abcd"):
        block = "".join(r.choice(letters) for _ in range(30))
        text = "".join(r.choice([block, block[::-1], r.choice(letters)]) for _ in range(200))
        s = np.array([ord(c) - 96 for c in text] + [0], dtype=np.int16)
        order = sd.suffix_order(s, 6, 50, 1 << 20)
        cut = [tuple(s[i : i + 50].tolist()) for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(s))) and cut == sorted(cut)


def test_a_shard_takes_a_bounded_number_of_bytes_for_each_byte():
    import tracemalloc

    r = random.Random(12)
    vocab = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(500)]
    parts = [" ".join(r.choice(vocab) for _ in range(14)).encode()[:70] for _ in range(8000)]
    tracemalloc.start()
    try:
        sd.equal_windows(parts, 50, 1 << 20)
        assert tracemalloc.get_traced_memory()[1] < 65 * sum(map(len, parts))
    finally:
        tracemalloc.stop()


def test_anchors_of_texts_together_are_those_of_each():
    r = random.Random(13)
    for s in (sd.Settings(length=12, gram=4), sd.Settings()):
        for _ in range(100):
            texts = [bytes(r.choice(b"abc") for _ in range(r.choice([0, 3, 11, 12, 13, 49, 50, 51, 200]))) for _ in range(r.randint(1, 9))]
            text, first, count, key = sd.anchors_of(b"".join(texts), np.array([len(t) for t in texts]), s)
            want = [(i, *row) for i, t in enumerate(texts) for row in zip(*(x.tolist() for x in sd.anchors(t, s)))]
            assert list(zip(text.tolist(), first.tolist(), count.tolist(), key.tolist())) == want
            assert sum(count) == sum(max(0, len(t) - s.length + 1) for t in texts)


def test_a_short_phrase_in_common_gives_no_common_key():
    r, s = random.Random(14), sd.Settings()
    phrase = b"of twenty-four bytes all"
    texts = [bytes(r.choice(b"abcdefgh ") for _ in range(80)) + phrase + bytes(r.choice(b"abcdefgh ") for _ in range(80)) for _ in range(60)]
    keys = [set(sd.anchors(t, s)[2].tolist()) for t in texts]
    assert sum(map(len, keys)) == len(set.union(*keys))  # with keys of 16 bytes, stretches around the phrase were sorted


def test_strings_with_grams_that_come_again_have_their_own_key():
    r, s = random.Random(15), sd.Settings()
    seen, n = {}, 0
    for _ in range(200):
        block = bytes(r.choice(b"ab") for _ in range(r.randint(1, 40)))
        text = b"".join(r.choice([block, block[: r.randint(0, len(block))], bytes([r.choice(b"ab")])]) for _ in range(20))
        halves = [row for half in range(sd.HALVES) for row in zip(*(x.tolist() for x in sd.anchors_of(text, np.array([len(text)]), s, half)))]
        assert sorted(halves) == sorted(zip(*(x.tolist() for x in sd.anchors_of(text, np.array([len(text)]), s))))
        for _, f, count, k in halves:
            for i in range(f, f + count):
                assert seen.setdefault(text[i : i + 50], k) == k
                n += 1
    assert n > 10_000


def test_values_of_many_rows_travel_in_one():
    r = np.random.default_rng(16)
    values = [r.integers(-(1 << 62), 1 << 62, 1000), r.integers(0, 99, 1000), r.integers(0, 9, 1000), r.integers(9, 99, 1000)]
    part = values[1] % 7
    batch = sd.dealt(sd.SPAN, values, part, 12)
    assert batch["part"].to_pylist() == list(range(7))
    for i in range(7):
        for got, x in zip(sd.gathered(batch.slice(i, 1), sd.SPAN), values):
            assert got.tolist() == x[part == i].tolist()


def test_many_parts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "PART_BYTES", 2000)
    r, s = random.Random(17), sd.Settings(length=20, gram=4, shard_bytes=500)
    passage = ["".join(r.choice("abcdef ") for _ in range(90)) for _ in range(4)]
    rows = [(i, "".join(r.choice("abcdef ") for _ in range(r.randint(0, 120))) + r.choice(passage)[r.randint(0, 60) :] + "ab" * r.randint(0, 30)) for i in range(150)]
    rows += [(1000 - i, rows[i][1]) for i in range(10)]
    want = brute(rows, 20)
    for x in sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), s=s).collect():
        n, removed, spans, kept = want[x.doc_id]
        assert (len(x.repeated_spans), sum(y.end - y.start for y in x.repeated_spans), bytes(x.kept)) == (spans, removed, kept), x.doc_id
