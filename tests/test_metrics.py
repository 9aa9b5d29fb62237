import random

import pytest

from notewright import fixed_values as V
from notewright.operators import metrics as M

LABELS = "struct<" + ", ".join(f"{k}: array<string>" for k in V.TRUTH_KEYS) + ">"


def score(samples, method, nested=False):
    """Macro scores by plain loops over sets."""
    ps, rs = [], []
    for s in samples:
        truth = {x for k in V.TRUTH_KEYS for x in ((s["labels"] or {}).get(k) or [])}
        raw = s.get(method) or []
        pred = {e[1] for e in raw if len(e) >= 2} if nested else set(raw)
        if not truth and not pred:
            p = r = 1.0
        elif not truth or not pred:
            p = r = 0.0
        else:
            p, r = len(truth & pred) / len(pred), len(truth & pred) / len(truth)
        ps.append(p)
        rs.append(r)
    p, r = sum(ps) / len(ps), sum(rs) / len(rs)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def random_samples(n, seed):
    rnd = random.Random(seed)
    terms = [f"表型{i}" for i in range(12)]

    def some(k):
        return rnd.choices(terms, k=rnd.randint(0, k))

    return [
        {
            "index": i, "source": rnd.choice(["a", "b", None]), "department": rnd.choice(["x", None]),
            "labels": None if rnd.random() < 0.1 else {k: (None if rnd.random() < 0.3 else some(3)) for k in V.TRUTH_KEYS},
            "m1": None if rnd.random() < 0.2 else some(8), "m2": some(2),
            "base": [rnd.choices(terms, k=rnd.randint(0, 4)) for _ in range(rnd.randint(0, 5))],
        }
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def samples():
    return random_samples(400, 1)


@pytest.fixture(scope="module")
def frame(spark, samples):
    schema = f"index bigint, source string, department string, human_annotated {LABELS}, m1 array<string>, m2 array<string>, base array<array<string>>"
    rows = [(s["index"], s["source"], s["department"], s["labels"] and tuple(s["labels"][k] for k in V.TRUTH_KEYS), s["m1"], s["m2"], s["base"]) for s in samples]
    return spark.createDataFrame(rows, schema)


def close(row, expected):
    assert (row["precision"], row["recall"], row["f1"]) == pytest.approx(expected)


def test_overall(frame, samples):
    got = {r["method"]: r for r in M.metrics(M.sample_sets(frame, ("m1", "m2", "base", "absent"))).collect()}
    close(got["m1"], score(samples, "m1"))
    close(got["m2"], score(samples, "m2"))
    close(got["base"], score(samples, "base", nested=True))
    close(got["absent"], score(samples, "absent"))
    assert got["m1"]["n"] == 400


def test_report(frame, samples):
    rows = M.report(M.sample_sets(frame, ("m1", "m2"))).collect()
    assert len(rows) == 2 * (1 + 3 + 2)
    for r in rows:
        part = [s for s in samples if r["grouping"] == "overall" or (s[r["grouping"]] or "unknown") == r["value"]]
        close(r, score(part, r["method"]))
        assert r["n"] == len(part)


def test_truth_keys(frame, samples):
    positive = V.TRUTH_KEYS[:2]
    only = [s | {"labels": s["labels"] and {k: s["labels"][k] for k in positive}} for s in samples]
    close(M.metrics(M.sample_sets(frame, ("m1",), positive)).first(), score(only, "m1"))


def test_flat_predictions_of_a_nested_method(spark):
    df = spark.createDataFrame([(1, (["a"], None, None, None), ["a", "a"])], f"index bigint, human_annotated {LABELS}, base array<string>")
    assert M.metrics(M.sample_sets(df, ("base",))).first()["f1"] == 1.0
    assert M.metrics(M.sample_sets(df, ("base",), legacy=True)).first()["f1"] == 0.0


EDGES = [
    ([], [], 1.0, 1.0), ([], ["a"], 0.0, 0.0), (["a"], [], 0.0, 0.0), (["a"], None, 0.0, 0.0),
    (["a", "b"], ["a", "a", "c"], 0.5, 0.5), (["a", "a"], ["a"], 1.0, 1.0),
]


def test_edges(spark):
    rows = [(i, (t, None, [], None), p) for i, (t, p, _, _) in enumerate(EDGES)]
    df = spark.createDataFrame(rows, f"index bigint, human_annotated {LABELS}, m array<string>")
    got = {r["index"]: (r["precision"], r["recall"]) for r in M.scored(M.sample_sets(df, ("m",))).collect()}
    assert got == {i: (p, r) for i, (_, _, p, r) in enumerate(EDGES)}


def test_no_samples(spark):
    df = spark.createDataFrame([], f"index bigint, human_annotated {LABELS}, m array<string>")
    assert M.metrics(M.sample_sets(df, ("m",))).count() == 0


def test_long_form_equals_record_form(spark, frame, samples):
    rows = []
    for s in samples:
        truth = {x for k in V.TRUTH_KEYS for x in ((s["labels"] or {}).get(k) or [])}
        m1, m2 = set(s["m1"] or []), set(s["m2"])
        terms = truth | m1 | m2 or {None}
        rows += [(s["index"], s["source"], s["department"], t, int(t in truth), int(t in m1), int(t in m2)) for t in terms for _ in range(2)]
    long = spark.createDataFrame(rows, "idx bigint, source string, department string, term string, is_truth int, a int, b int")
    sizes = M.term_sets(long, {"m1": "a", "m2": "b"})
    cols = ["index", "source", "department", "method", "n_truth", "n_pred", "n_hit"]
    assert sorted(map(tuple, sizes.select(cols).collect())) == sorted(map(tuple, M.sample_sets(frame, ("m1", "m2")).select(cols).collect()))


def test_order_of_groups_and_methods(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), ("a", 5), ("b", 4), (None, 0)], "source string, index bigint")
    assert [tuple(r) for r in M.groups_by_size(df, "source", "index").collect()] == [("a", 2, 1), ("b", 2, 3), ("unknown", 1, 0)]
    ranked = M.ranked_methods(spark.createDataFrame([("x", 0.5), ("y", 0.9), ("z", 0.5)], "method string, f1 double"))
    assert {r["method"]: r["rank"] for r in ranked.collect()} == {"y": 1, "x": 2, "z": 2}
