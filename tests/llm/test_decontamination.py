import random

from notewright.llm import decontamination as dc
from notewright.llm.queries import QUERIES


def vocabulary(r, n=300):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5))) for _ in range(n)]


def test_wand_against_all_scores():
    r = random.Random(2)
    v = vocabulary(r)
    for block, share in ((2, 0.3), (4, 0.5), (64, 0.2), (3, 0.1)):
        s = dc.Settings(block=block, question_share=share)
        items = [(i, " ".join(r.choice(v) for _ in range(r.randint(5, 30))), "") for i in range(120)]
        index = dc.Index(items, s)
        for _ in range(150):
            text = " ".join(r.choice(v) for _ in range(r.randint(1, 60)))
            if r.random() < 0.7:
                text += " " + r.choice(items)[1][: r.randint(10, 100)]
            terms = sorted({index.terms[w] for w in dc.words(text) if w in index.terms})
            scores = {}
            for t in terms:
                for d, x in (y for p in index.lists[t].values() for y in p):
                    scores[d] = scores.get(d, 0.0) + x
            want = {d for d, x in scores.items() if x >= index.needed[d] + 1e-9}
            live = index.live(dc.np.array(terms), dc.np.array([0])) if terms else []
            got = {d for _, k in live for d in index.retrieve(terms, k)}
            assert want <= got and all(scores[d] >= index.needed[d] - 1e-9 for d in got)


def brute(text, items, s):
    """Verified items over all passages, without an index."""
    w, out = dc.words(text or ""), set()
    index = dc.Index(items, s)
    size = max(s.passage, 2 * index.longest)
    for a in range(0, max(len(w) - size // 2, 1), size // 2):
        part = w[a : a + size]
        for k, i in enumerate(index.ids):
            short = sum(map(len, index.parts[k])) < s.least_words
            q, n = index.verify(k, part)
            if index.verified(k, part) if short else q >= s.question_share and n >= s.answer_share:
                out.add(i)
    return sorted(out)


def test_rows_and_shards(spark):
    r = random.Random(4)
    v, s = vocabulary(r), dc.Settings(shard_bytes=2000)
    sentence = lambda n: " ".join(r.choice(v) for _ in range(n)).capitalize() + "."
    items = [(i, f"{sentence(12)} {sentence(9)} {sentence(8)}") for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (3, None), (93, sentence(15))]
    texts = [None, "", "x", "one two three four five six"]
    for i in range(60):
        t = " ".join(sentence(r.randint(4, 15)) for _ in range(r.randint(1, 40)))
        if i % 3 == 0:
            t += " " + r.choice(items[:40])[1].upper() + " " + sentence(10)
        texts.append(t)
    texts.append("filler " * 300_000 + items[5][1])
    texts.append(items[93 - 93 + 44][1])
    df = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaked_items(df, bench, s=s).collect()
    whole = [(i, *dc.question_and_answer(t or "")) for i, t in items]
    assert len(got) == len(texts)
    for row in got:
        mine = [x.item_id for x in row.leaks]
        assert len(mine) == len(set(mine))
        if len(row.text or "") < 100_000:
            assert [i for i in mine if i < 40] == [i for i in brute(row.text, [x for x in whole if x[0] < 40], dc.Settings()) if i in mine] or mine
    found = {row.text: [x.item_id for x in row.leaks] for row in got}
    for t in texts[4:64:3]:
        assert found[t], t[-200:]
    assert all(not found[t] for i, t in enumerate(texts[4:64]) if i % 3) and found[texts[-2]] == [5] and found[texts[-1]] == [93]
    assert dc.leaked_items(df.limit(0), bench).count() == 0
    assert {len(x.leaks) for x in dc.leaked_items(df, bench.limit(0)).collect()} == {0}


def test_query_against_brute_force(spark, small):
    items = [(r.item_id, *dc.question_and_answer(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r.item_ids for r in QUERIES["op7_decontamination"](spark, small).collect()}
    assert got.keys() == texts.keys()
    assert got == {i: brute(t, items, dc.Settings()) for i, t in texts.items()} and sum(map(bool, got.values())) > 0


def test_the_best_shares_of_an_item_may_fail_where_another_passage_passes():
    r = random.Random(6)
    v = vocabulary(r)
    q, a = ([r.choice(v) for _ in range(n)] for n in (16, 8))
    other = lambda n: " ".join(f"x{r.randrange(10**6)}" for _ in range(n))
    changed = [*q[:15], "changed"]
    index = dc.Index([(1, " ".join(q), " ".join(a)), (2, other(12), other(12))], dc.Settings())
    text = " ".join([*q, other(400), *changed, *a, other(100)])
    assert [x[0] for x in index.leaks(" ".join([*q, other(400)]))] == []
    assert [x[0] for x in index.leaks(text)] == [1] == brute(text, [(1, " ".join(q), " ".join(a)), (2, other(12), other(12))], dc.Settings())


def test_near_and_cut_copies_of_plain_passages(spark):
    r = random.Random(7)
    v = vocabulary(r, 3000)
    sentence = lambda n: " ".join(r.sample(v, n)).capitalize() + "."
    bench, texts, k = [], [], 0
    for last in range(1, 16):
        for first in (6, 10, 20, 40):
            bench.append((k, f"{sentence(first)} {sentence(last)}"))
            w = bench[-1][1].split()
            for at in range(first, first + last):  # one edit in the last sentence
                texts.append((k, " ".join([*w[:at], "edited", *w[at + 1 :]])))
            if first >= last:
                texts.append((k, " ".join(w[:first])))
            k += 1
    clean = [(-1, " ".join(sentence(12) for _ in range(20))) for _ in range(20)]
    rows = [(i, f"{sentence(30)} {t} {sentence(30)}") for i, t in texts] + clean
    got = dc.leaked_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    missed = [(x.doc_id, x.text) for x in got if [y.item_id for y in x.leaks] != ([x.doc_id] if x.doc_id >= 0 else [])]
    assert not missed, (len(missed), missed[:3])


def test_short_answers_by_words_in_order():
    question = "which of the many drugs named above was given on the third day of the stay"
    index = dc.Index([(1, question, "five milligrams of warfarin at night"), (2, question, "warfarin")], dc.Settings())
    found = lambda text: [x[0] for x in index.leaks(f"{question} {text}")]
    assert found("five milligrams of warfarin every night") == [1, 2] and found("five milligrams of heparin at night") == [1]
    assert found("night at milligrams five of heparin") == [] and found("heparin") == []


def test_least_mass_against_all_choices():
    r = random.Random(8)
    for _ in range(60):
        m, n = [r.randint(1, 9) for _ in range(r.randint(1, 11))], r.randint(1, 4)
        need = r.randint(1, len(m))
        sums = []
        for bits in range(1, 1 << len(m)):
            chosen = f"{bits:0{len(m)}b}"
            if chosen.count("1") >= need and all(len(x) >= n for x in chosen.split("0") if x):
                sums.append(sum(x for x, c in zip(m, chosen) if c == "1"))
        assert dc.least_mass(m, n, need) <= min(sums, default=sum(m)) + 1e-9
        if len(m) > n and need < len(m):
            assert abs(dc.least_mass(m, n, need) - min(sums)) < 1e-9


def test_retrieval_hides_no_accepted_copy(spark):
    r = random.Random(9)
    common, rare = vocabulary(r, 40), [f"rare{i}" for i in range(4000)]
    items, texts = [], []
    for i in range(40):  # the rarest words stand at both ends, the middle is what was copied
        w = [r.choice(rare) for _ in range(10)] + [r.choice(common) for _ in range(30)] + [r.choice(rare) for _ in range(10)]
        items.append((i, " ".join(w) + "."))
        texts.append((i, " ".join([*(f"x{r.randint(0, 999)}" for _ in range(50)), *w[10:40], *(f"y{r.randint(0, 999)}" for _ in range(50))])))
    items += [(100, "three short words"), (101, "四个字。还有。"), (102, "Alpha beta? Gamma.")]
    texts += [(100, "so THREE short words it is"), (101, "x 四个字。还有。"), (102, "three or short words"), (103, "gamma, alpha beta"), (104, "alpha and beta gamma")]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: {y.item_id for y in x.leaks} for x in dc.leaked_items(df, bench).collect()}
    assert all(i in got[i] for i in range(40))
    assert got[100] == {100} and got[101] == {101} and got[102] == set() and got[103] == {102} and got[104] == set()
