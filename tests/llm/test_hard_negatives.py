import math
import random

import numpy as np
import pytest
from compare import connect, differences

from notewright.llm import hard_negatives as hn
from notewright.llm.queries import ORACLES, QUERIES


def plainly(rows, s):
    """All result rows, from exact Python integers."""
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = (label, tuple(math.floor(s.scale * x) for x in v))
        best[i] = min(best.get(i, whole), whole)
    out = []
    for a, (label, v) in best.items():
        if a % s.anchors_every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in best.items() if i != a and len(w) == len(v))
        for p, i, _ in [x for x in scored if x[2] == label][: s.positives]:
            fits = [x for x in scored if x[2] != label and s.low_percent * -p <= 100 * -x[0] <= s.high_percent * -p]
            out += [(a, i, k + 1, j, -p, -n) for k, (n, j, _) in enumerate(fits[: s.negatives])]
    return sorted(out)


def test_products_against_whole_numbers():
    r = random.Random(5)
    for bits, dim in ((3, 1), (9, 64), (20, 130), (28, 7), (30, 1), (20, 0)):
        a, b = ([[r.randint(-(1 << bits), 1 << bits) for _ in range(dim)] for _ in range(9)] for _ in range(2))
        a[0], b[0], b[1] = [1 << bits] * dim, [1 << bits] * dim, [-(1 << bits)] * dim
        moduli = hn.primes(max(1, dim << (2 * bits)))
        assert math.prod(moduli) > 2 * (dim << (2 * bits)) and max(moduli) == 1021
        x, y = (np.array(m, dtype=np.int64).reshape(9, dim) for m in (a, b))
        got = hn.products([hn.residues(x, p) for p in moduli], [hn.residues(y, p) for p in moduli], moduli)
        assert got.tolist() == [[sum(p * q for p, q in zip(u, w)) for w in b] for u in a]


def test_take_best_against_sorting():
    r = random.Random(6)
    for _ in range(50):
        best, ids = np.full((4, 3), hn.LEAST), np.zeros((4, 3), np.int64)
        seen, at = [[] for _ in range(4)], 0
        for _ in range(r.randint(1, 5)):
            n = r.randint(1, 6)
            scores = np.array([[r.choice([hn.LEAST, -2, 0, 5, 2**63 - 1, hn.LEAST + 1]) for _ in range(n)] for _ in range(4)])
            for k in range(4):
                seen[k] += [(-int(x), at + j) for j, x in enumerate(scores[k]) if x > hn.LEAST]
            hn.take_best(scores, np.arange(at, at + n), best, ids)
            at += n
        for k in range(4):
            assert [(-int(x), int(i)) for x, i in zip(best[k], ids[k]) if x > hn.LEAST] == sorted(seen[k])[:3]


@pytest.mark.parametrize("s", [hn.Settings(anchors_every=5), hn.Settings(anchors_every=3, group=7, block_factor=3, tile_anchors=2, tile_rows=3, positives=2, negatives=4)])
def test_rows_against_plain_python(spark, s):
    r = random.Random(8)
    vec = lambda d=4: [r.choice([-0.5, 0.0, 0.25, 0.3, 0.9, 1.0]) + r.random() * r.choice([0, 0.01]) for _ in range(d)]
    rows = [(i, vec(), r.choice([0, 0, 0, 1, 2])) for i in range(-20, 90)]
    rows += [(100 + i, rows[30][1], i % 2) for i in range(12)]  # ties
    rows += [(200 + i, vec(2), i % 2) for i in range(11)] + [(220 + i, [], i % 2) for i in range(6)]
    rows += [(300, None, 1), (305, vec(), None), (310, [None, 1.0, 1.0, 1.0], 1), (315, [float("nan")] * 4, 1), (320, [float("inf"), 0.0, 0.0, 0.0], 1), (None, vec(), 1)]
    rows += [rows[3], rows[25], (30, vec(), 0), (30, vec(), 1)]
    df = spark.createDataFrame([(i, v, label, "x", i) for i, v, label in rows], "vec_id long, embedding array<double>, label int, id string, block long").repartition(4)
    got = sorted(tuple(x) for x in hn.mine(df, s=s).collect())
    assert got == plainly(rows, s) and len(got) > 50
    assert hn.mine(df.limit(0), s=s).count() == 0 and hn.mine(df.where("vec_id = 1"), s=s).count() == 0


def test_hot_label_and_large_components(spark):
    r, s = random.Random(9), hn.Settings(anchors_every=10)
    rows = [(i, [r.randint(-9, 9) * 2.0**k for k in (18, 17, 16)], 0 if r.random() < 0.9 else i) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    assert sorted(tuple(x) for x in hn.mine(df, s=s).collect()) == plainly(rows, s)
    for x in (2.0**24, 1e300):
        with pytest.raises(Exception, match="too large"):
            hn.mine(spark.createDataFrame([(0, [x, x], 1), (1, [x, x], 1)], df.schema)).collect()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, folder):
    rows, wrong = differences(QUERIES["op13_hard_negatives"](spark, folder), connect(folder), ORACLES["op13_hard_negatives"])
    assert rows and not wrong, wrong
