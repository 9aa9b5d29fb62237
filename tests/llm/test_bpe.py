import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notewright.llm import bpe
from notewright.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_same_ids_and_text_as_the_library():
    with open(PATH, "rb") as f:
        tables = bpe.BpeTables(f.read())
    library = Tokenizer.from_file(PATH)
    r = random.Random(7)
    names = [k.replace("</w>", "") for k in library.get_vocab()]
    texts = ["", " ", "ΑΣ Σας İ", "<|endoftext|>x<|startoftext|>", "éà", "it's we'll 12.5!?", "\x00\x85", "՘ Ᲊb", "ab" * 9000, "!" * 3000]
    texts += ["".join(r.choice("etaoin shrdlu") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(r.choice(names) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    texts += [" ".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(5)) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = tables.encode(t)
        assert got.tolist() == want, t[:60]
        assert tables.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "Hello  World", "y"), (3, "a" * 200_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(out) == 5 and [r.decoded for r in out[:3]] == ["", "", ""] and out[3].decoded == "hello</w> world</w>"
    assert out[0].ids == []
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).count() == 0
    lists = spark.createDataFrame([([1, None, 10**6, 2],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(lists, PATH).collect()] == ['" #', ""]


def test_query_on_all_documents(spark, small):
    library = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op2_bpe"](spark, small).orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_all_texts_at_once_as_one_by_one():
    with open(PATH, "rb") as f:
        tables = bpe.BpeTables(f.read())
    r = random.Random(3)
    odd = ["", " ", "<|endoftext|>x<|startoftext|>", "a <| b", "\x1ca\x1fb c", "՘ Ᲊb", "éà it's we'll 12.5!?", "straße ǅx ²½"]
    texts = [r.choice(odd) if r.random() < 0.3 else " ".join(r.choice(["der", "it's", "x.", "été,", "12a"]) for _ in range(r.randint(0, 9))) for _ in range(300)]
    values, counts = tables.encode_all(texts)
    one_by_one = [tables.encode(t).tolist() for t in texts]
    assert counts.tolist() == [len(x) for x in one_by_one] and values.tolist() == sum(one_by_one, [])
    values, counts = tables.encode_all([])
    assert len(values) == 0 and len(counts) == 0


def test_a_piece_that_texts_share_is_looked_up_once():
    with open(PATH, "rb") as f:
        tables = bpe.BpeTables(f.read())
    asked, make = [], tables._pieces.make

    class Counted(bpe.Cache):
        def __getitem__(self, key):
            asked.append(key)
            return self.make(key)

    tables._pieces = Counted(make)
    tables.encode_all(["one two two", "two one three"] * 50)
    assert sorted(asked) == ["one", "three", "two"]


def test_words_are_cut_by_the_plain_engine_as_by_the_full_one():
    with open(PATH, "rb") as f:
        tables = bpe.BpeTables(f.read())
    assert tables._usual_word is not tables._word
    r = random.Random(5)
    for _ in range(20_000):
        piece = "".join(chr(r.randrange(0x250)) if r.random() < 0.5 else r.choice("'stvremld1.") for _ in range(r.randint(1, 9)))
        assert tables._usual_word.findall(piece) == tables._word.findall(piece)


def test_new_pieces_are_laid_together_as_the_library_lays_them(monkeypatch):
    with open(PATH, "rb") as f:
        tables = bpe.BpeTables(f.read())
    library = Tokenizer.from_file(PATH)
    r = random.Random(11)
    names = [k.replace("</w>", "") for k in library.get_vocab()]
    odd = ["", "don't", "x\x1cy", "“quoted”", "éà", "1½", "—", "日本", "a" * 60]
    kinds = (lambda: "".join(r.choice("etaoinshrdluxzq") for _ in range(r.randint(1, 30))), lambda: "".join(r.choice(names) for _ in range(r.randint(1, 4))),
             lambda: "".join(chr(r.choice([r.randrange(33, 127), r.randrange(0xA1, 0x250)])) for _ in range(r.randint(1, 8))), lambda: r.choice(odd))
    texts = [" ".join(r.choice(kinds)() for _ in range(r.randint(0, 20))) for _ in range(2000)]
    alone = []
    word = tables.encode_word
    monkeypatch.setattr(tables, "encode_word", lambda w: alone.append(w) or word(w))
    values, counts = tables.encode_all(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and values.tolist() == sum(want, [])
    assert len(alone) < 1500  # before, each of some 15,000 words
    usual = " ".join(t for t in texts if all(c < "ɐ" for c in t)).split()
    assert tables.encode_pieces(usual) == [*map(tables.encode_piece, usual)]


def test_the_arrays_find_what_the_automaton_finds():
    with open(PATH, "rb") as f:
        tables = bpe.BpeTables(f.read())
    r = random.Random(13)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 40))).encode() for _ in range(2000)]
    codes, ends = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint16), np.cumsum([len(w) for w in words])
    codes[ends - 1] += 256
    want = codes.astype(int)
    for end, (before, token) in tables.matches.iter(codes.tobytes().decode("utf-16-le")):
        want[end - before] = token
    assert np.array_equal(tables._matches.longest(codes, np.append(0, ends[:-1]), ends, tables._length), want)
    pairs = np.array([[r.randrange(len(tables.length)) for _ in range(2)] for _ in range(20_000)] + [*tables.pairs][:20_000])
    want = [tables._border_stands(a, b, len(tables.length)) for a, b in pairs.tolist()]
    for _ in range(2):
        assert tables._compatible_pairs(pairs[:, 0].copy(), pairs[:, 1].copy()).tolist() == want
    assert 0 < sum(want) < len(want)


def test_the_cache_keeps_what_the_last_keys_use(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CACHE", 4)
    made = []
    cache = bpe.Cache(lambda k: k.encode())
    for keys in (["a", "b"], ["b", "c", "d"], ["e", "a", "x" * 99], ["d", "f"], []):
        cache.fill(keys, lambda new: made.extend(new) or [k.encode() for k in new])
        assert all(cache[k] == k.encode() for k in keys)
    assert made == ["a", "b", "c", "d", "e", "f"] and "x" * 99 not in cache
