import random
import re

import pytest
from pyspark.sql import functions as F

from notewright.llm import graph, ngram_join
from notewright.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows, percent=80):
    """(n_shingles, component) by row number, from all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j > i}:
            inter = len(s & sets[j])
            if 100 * inter >= percent * (len(s) + len(sets[j]) - inter):
                parent[root(j)] = root(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [(len(sets[i]), low.get(root(i))) for i in range(len(rows))]


def families(r, n, long=False):
    vocab = ["w%d" % i for i in range(400)]
    texts = [None, "", "  \t", "one", "ONE", "a b c d", "a b c d", "É é x y z"]
    line = " ".join(r.choice(vocab) for _ in range(30))
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(4, 300 if long else 60))]
        if r.random() < 0.3:
            base += line.split()
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    r.shuffle(texts)
    return [(i * 7 % 100_003, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("s", [
    ngram_join.Settings(), ngram_join.Settings(frequent=1, per_bucket=4), ngram_join.Settings(frequent=3, per_bucket=8, block_sets=5, block_tokens=300),
    ngram_join.Settings(frequent=0, per_bucket=1000),
])
def test_against_all_pairs(spark, s):
    rows = families(random.Random(s.per_bucket + s.block_sets), 120, long=True)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "id": F.lit(1), "_tokens": F.lit(0)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(df, s=s).collect()}
    want = {d: b for (d, _), b in zip(rows, brute(rows))}
    assert got == want and len({c for _, c in want.values()}) < len(rows) - 50


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert ngram_join.similar(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, ""), (9, "A b c d e f")]
    got = sorted(((r.doc_id or -1), r.component_id) for r in ngram_join.similar(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 5), (5, 5), (5, 5), (7, 7), (8, 8), (9, 5)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1090)] + [(5, None), (3, 3)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_ngram_jaccard_join"](spark, folder).collect()}
    assert got == {d: b for (d, _), b in zip(rows, brute(rows))}
