import numpy as np
import pytest

from notewright.llm import neighbours as nn
from notewright.llm.queries import QUERIES


def brute(ids, vectors, threshold=0.9):
    """{id: (n_links, component)} from all pairs."""
    good = {i: np.array(v, float) for i, v in zip(ids, vectors) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    keys = sorted(good)
    x = np.array([good[k] / np.linalg.norm(good[k]) for k in keys])
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    comp = np.arange(len(keys))
    while True:
        new = np.array([min(comp[i], *comp[hit[i]]) if hit[i].any() else comp[i] for i in range(len(keys))])
        if (new == comp).all():
            break
        comp = new
    out = {i: (0, i) for i in ids}
    return out | {k: (int(hit[i].sum()), keys[comp[i]]) for i, k in enumerate(keys)}


def test_odd_vectors_and_dense_groups(spark):
    r = np.random.default_rng(1)
    base, rows = r.standard_normal((40, 16)), []
    for i in range(900):
        c = base[0] if i % 3 == 0 else base[i % 40] if i % 3 == 1 else r.standard_normal(16)
        rows.append((i * 3, (c * r.uniform(0.5, 2) + 0.08 * r.standard_normal(16)).tolist()))
    odd = [(1, None), (2, []), (4, [0.0] * 16), (5, [None] + [1.0] * 15), (7, [float("nan")] * 16), (8, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, component_id string")
    found, recall = nn.near_duplicates(df, s=nn.Settings(block=100, bucket=32))
    got = {x.vec_id: (x.n_links, x.component_id) for x in found.collect()}
    want = brute([i for i, _ in rows + odd], [v for _, v in rows + odd])
    assert got.keys() == want.keys() and recall >= 0.98
    assert all(g[0] <= want[k][0] for k, g in got.items())
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())
    assert all(got[i] == (0, i) for i, _ in odd)
    empty, _ = nn.near_duplicates(df.limit(0))
    assert empty.count() == 0


def test_counts_by_radii_equal_counts_by_pairs():
    r = np.random.default_rng(2)
    for spread in (0.01, 0.1, 0.3, 1.0):
        x, y = (c + spread * r.standard_normal((30, 8)) for c in (np.ones(8), np.ones(8) * [1, 1, 1, 1, 1, 1, 1, 1 - 2 * spread]))
        x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
        hits = x @ y.T >= 0.9
        a, b = nn.count_links(x, y, 0.9)
        assert (a == hits.sum(axis=1)).all() and (b == hits.sum(axis=0)).all()


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {x.vec_id: (x.n_links, x.component_id) for x in QUERIES["op10_embedding_near_dedup"](spark, folder).collect()}
    assert got.keys() == want.keys() and all(g[0] <= want[k][0] for k, g in got.items())
    assert sum(g == want[k] for k, g in got.items()) >= 0.99 * len(want)
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values())


def near(r, centre, cosine):
    """A unit vector at this cosine to a unit vector."""
    e = r.standard_normal(len(centre))
    e -= (e @ centre) * centre
    return cosine * centre + np.sqrt(1 - cosine**2) * e / np.linalg.norm(e)


def grouped(seed, dim=32):
    """Rows of saturated groups linked across, exact copies, a hot group and planted pairs."""
    r = np.random.default_rng(seed)
    unit = lambda: (z := r.standard_normal(dim)) / np.linalg.norm(z)
    out = []
    for _ in range(4):
        a = unit()
        for c in (a, near(r, a, 0.93)):
            out += [near(r, c, 0.9995) for _ in range(20)]
    for _ in range(4):
        a = unit()
        out += [a] * 9 + [near(r, a, 0.93)] * 9
    hot = unit()
    out += [near(r, hot, 0.99) for _ in range(300)]
    for _ in range(60):
        a = unit()
        out += [a, near(r, a, 0.91)]
    out += [unit() for _ in range(200)]
    return [(int(i), out[j].tolist()) for j, i in enumerate(r.permutation(len(out)))]


def test_saturated_groups_copies_and_pairs_beside_a_hot_group(spark):
    rows = grouped(3)
    found, recall = nn.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), s=nn.Settings(block=100, bucket=32))
    got = {x.vec_id: (x.n_links, x.component_id) for x in found.collect()}
    want = brute([i for i, _ in rows], [v for _, v in rows])
    assert recall >= 0.98 and got.keys() == want.keys() and all(g[0] <= want[k][0] for k, g in got.items())
    few = [k for k, w in want.items() if w[0] == 1]
    many = [k for k, w in want.items() if w[0] in (17, 39)]
    assert len(few) >= 100 and len(many) >= 200
    assert all(got[k] == want[k] for k in many)
    assert sum(got[k] == want[k] for k in few) >= 0.95 * len(few)


def test_audit_weighs_vectors_and_a_missed_recall_raises(spark):
    hot = [(i, [1.0, 0.001 * i, 0.0], 1, 0) for i in range(90)]
    lone = [(100 + i, [0.0, 0.0, 1.0 - 0.001 * i], 1, 100 + i) for i in range(10)]
    vectors = spark.createDataFrame(hot + lone, "id long, v array<double>, weight long, component long")
    assert nn.audit(vectors, nn.Settings()) == pytest.approx(0.9)
    with pytest.raises(RuntimeError):
        nn.near_duplicates(vectors.select("id", "v"), "id", "v", nn.Settings(recall=1.1, attempts=1))


def test_vectors_of_every_length_link_among_themselves(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (4, [2.0, -1.0]), (5, [7.0])]
    rows += [(10 + i, [1.0, float(i % 2), 0.0]) for i in range(6)]
    got, recall = nn.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    assert by == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (0, 5, True)} | {
        10 + i: (2, 10 + i % 2, i < 2) for i in range(6)}
    assert recall == 1.0
