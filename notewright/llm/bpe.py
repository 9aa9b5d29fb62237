"""BPE encoding by backtracking over longest matches, and decoding through an offset table.

The longest token that starts at each place of a word comes from one Aho-Corasick pass. Tokens are laid
from left to right; two neighbours stand only if merging their joined text would keep the border between them
(the pair-compatibility table). Where no token fits, the last one is taken back and tried shorter, and the
place is never tried again, so a word costs time in proportion to its length and gets exactly the merges'
result.

The vocabulary file (``tokenizers`` JSON with word-end BPE) is read once by the driver; its bytes, of a fixed
size, go to the workers, each of which builds the tables once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Tokenizer

from notewright.llm.common import worker_cache

PIECE_CACHE = 250_000  # pieces between blanks whose tokens a worker keeps at once
CACHED_LENGTH = 48
TOGETHER = 2 << 20  # characters whose distinct pieces are looked up at once
LETTER_BITS = 9
FEW = 256  # words at work below which numpy costs more than it saves
PAIR_BITS = 20  # slots (a power of two) that remember whether a pair of tokens is compatible; also the bits of a token's number
_UNUSUAL = re.compile(r"[^\x00-ɏ]")
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # blanks to Python's split alone


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def _written_out(pattern: str) -> re.Pattern | None:
    """The pattern for Python's own engine, with the characters that ``regex`` counts into a class, up to the usual ones' last."""
    if "\\" in re.sub(r"\[[^\]]*\]", "", pattern) or re.search(r"\\(?!s|p\{[LN]\})", pattern):
        return None
    classes = {c: "".join(f"\\u{i:04x}" for i in range(0x250) if regex.match(c, chr(i))) for c in (r"\s", r"\p{L}", r"\p{N}")}
    for name, letters in classes.items():
        pattern = pattern.replace(name, letters)
    return re.compile(pattern)


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


def _numbered(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The different ones of some texts as they come, and the number of each text's; -1 for nothing."""
    codes = pa.array(texts, pa.large_string()).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1) > 0)  # numbers go up where a text comes for the first time
    return [*map(texts.__getitem__, first.tolist())], codes


def _gathered(packed: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids in the order of their numbers ``codes``, one after the other, and how many each has."""
    pool = np.frombuffer(b"".join(packed), dtype=np.int32)
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    starts, sizes = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class Matches:
    """An Aho-Corasick automaton in arrays, which many words go through a letter at a time."""

    def __init__(self, tokens: dict[str, int]):
        edges, token = {}, [-1]
        for text, number in sorted(tokens.items(), key=lambda x: len(x[0])):  # so nodes are numbered by depth, a level after the other
            node = 0
            for c in map(ord, text):
                after = edges.get(node << LETTER_BITS | c)
                if after is None:
                    after = edges[node << LETTER_BITS | c] = len(token)
                    token.append(-1)
                node = after
            token[node] = number
        pairs = np.array(list(edges.items()), dtype=np.int64).reshape(-1, 2)
        self.bits = len(pairs).bit_length() + 2  # a quarter of the slots is taken at most
        self.keys, self.after = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        left, slot = np.arange(len(pairs)), self.slot(pairs[:, 0])
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.after[slot[free]] = pairs[left[free]].T
            go = self.keys[slot] != pairs[left, 0]
            left, slot = left[go], slot[go] + 1 & (1 << self.bits) - 1
        self.token = np.array(token, dtype=np.int64)
        self.back = np.zeros(len(token), dtype=np.int64)  # the node of the longest text that a node's text ends with
        level = pairs[pairs[:, 0] >> LETTER_BITS == 0, 1]
        while len(level):
            found = pairs[np.isin(pairs[:, 0] >> LETTER_BITS, level)]
            level = found[:, 1]
            self.back[level] = self.step(self.back[found[:, 0] >> LETTER_BITS], found[:, 0] & (1 << LETTER_BITS) - 1)
        # the next node of that kind with a token
        self.more = self.back.copy()
        while len(odd := np.flatnonzero((self.token[self.more] < 0) & (self.more > 0))):
            self.more[odd] = self.back[self.more[odd]]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def followed(self, key: np.ndarray) -> np.ndarray:
        """The node that an edge leads to, or 0."""
        slot = self.slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.after[slot], 0)
        left = np.flatnonzero((held != key) & (held >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            held = self.keys[slot[left]]
            found = held == key[left]
            out[left[found]] = self.after[slot[left[found]]]
            left = left[~found & (held >= 0)]
        return out

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out = self.followed(node << LETTER_BITS | letter)
        at = np.flatnonzero((out == 0) & (node > 0))
        node = node[at]
        while len(at):
            node = self.back[node]
            got = self.followed(node << LETTER_BITS | letter[at])
            out[at] = got
            go = (got == 0) & (node > 0)
            at, node = at[go], node[go]
        return out

    def longest(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: np.ndarray) -> np.ndarray:
        """At each place the number of the longest token that begins there."""
        out = codes.astype(np.int32)  # letters' tokens have the letters' numbers
        at, stop, node = starts, ends, np.zeros(len(starts), dtype=np.int64)
        while len(at):
            node = self.step(node, codes[at].astype(np.int64))
            place, found = at, np.where(self.token[node] >= 0, node, self.more[node])
            while True:
                held = found > 0
                place, found = place[held], found[held]
                if not len(place):
                    break
                token = self.token[found]
                out[place - length[token] + 1] = token  # ends ascend, so the longest match of a start comes last
                found = self.more[found]
            at = at + 1
            go = at < stop
            at, stop, node = at[go], stop[go], node[go]
        return out


class Cache(dict):
    """Remembers what ``make`` gives for short keys; when full, the keys used since the last time stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= PIECE_CACHE:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value

    def fill(self, keys: list[str], make_all) -> None:
        """Remembers short ones of some distinct keys; those that are new are made all at once."""
        found = [*map(self.get, keys)]
        asked = [k for k, v in zip(keys, found) if v is None]
        if len(self) + len(asked) > PIECE_CACHE:
            self.before = dict(self)
            self.clear()
            self.update((k, v) for k, v in zip(keys, found) if v is not None)
        values = [*map(self.before.get, asked)]
        new = [k for k, v in zip(asked, values) if v is None and len(k) <= CACHED_LENGTH]
        self.update((k, v) for k, v in zip(asked, values) if v is not None)
        self.update(zip(new, make_all(new)))


class BpeTables:
    """Everything that encoding and decoding look up, built from a vocabulary file's bytes."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a BPE vocabulary with word-end tokens is needed")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("only vocabularies with NFC, white-space, lower-case normalisation and no decoder are known")
        self._library = Tokenizer.from_str(data.decode("utf-8"))
        self._word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        if "(?" in self._word.pattern:
            raise ValueError("a word must be a word by itself too, whatever stands around it")
        self._usual_word = _written_out(self._word.pattern) or self._word  # many times faster
        self._blank = regex.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are known")
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")") if self._special else None

        # A word's letters are its bytes; the last one is another letter (256 higher), as it carries the word end.
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        names = [*letters, *(c + suffix for c in letters)]
        self.ids = [vocab[n] for n in names]
        self.left, self.right = list(range(512)), list(range(512))
        number = {n: i for i, n in enumerate(names)}
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in model["merges"]:
            made = a + b
            if made in number:
                raise ValueError("a token must come from one merge")
            number[made] = len(names)
            self.pairs[number[a], number[b]] = len(names)
            self.left.append(number[a])
            self.right.append(number[b])
            self.ids.append(vocab[made])
            names.append(made)
        self.length = [0] * len(names)
        texts = []
        for i, n in enumerate(names):
            ends = n.endswith(suffix) and n != suffix
            codes = [byte_of[c] for c in (n[: -len(suffix)] if ends else n)]
            if ends:
                codes[-1] += 256
            self.length[i] = len(codes)
            texts.append("".join(map(chr, codes)))
        self._compatible: dict[int, bool] = {}
        self.packed = [_packed([i]) for i in self.ids]
        self.matches = ahocorasick.Automaton()
        known = {}
        for i, t in enumerate(texts):
            # a token that its own text's merges never reach can't occur
            if i < 512 or self._border_stands(self.left[i], self.right[i], i):
                known[t] = i
                if len(t) > 1:  # a single letter is its own token
                    self.matches.add_word(t, (len(t) - 1, i))
        self.matches.make_automaton()
        # the longest shorter token that a token starts with
        self.shorter = [-1] * len(names)
        for t, i in known.items():
            self.shorter[i] = next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1)

        # the same for many words at once
        self._matches = Matches({t: i for t, i in known.items() if len(t) > 1})
        self._ids, self._length, self._shorter = (np.array(x, dtype=np.int32) for x in (self.ids, self.length, self.shorter))
        self._left, self._right = np.array(self.left, dtype=np.int64), np.array(self.right, dtype=np.int64)
        merged = np.array([(a << PAIR_BITS | b, made) for (a, b), made in self.pairs.items()], dtype=np.int64).reshape(-1, 2)
        merged = merged[np.argsort(merged[:, 0])]
        self._merges = np.append(merged[:, 0], np.iinfo(np.int64).max), np.append(merged[:, 1], len(names))
        if len(names) >> PAIR_BITS:
            raise ValueError("too many tokens")
        self._known_pairs = np.full(1 << PAIR_BITS, -1, dtype=np.int64)  # of a slot: the last pair, and whether it stands

        # offset table: token id -> its text and a blank, in one run of bytes
        by_id = {i: n for n, i in vocab.items()} | {i: n for n, i in self._special.items()}
        pieces = [(by_id[i] + " ").encode("utf-8") if i in by_id else b"" for i in range(max(by_id) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self._pieces = Cache(self.encode_piece)

    def _border_stands(self, a: int, b: int, limit: int) -> bool:
        """Whether merging the joined texts of two tokens, by merges before ``limit``, never crosses their border."""
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < limit:
                return False
            # undo the later of the two merges; what crosses the border must come before it
            if a > b and self.right[a] != a:
                limit, a = a, self.right[a]
            elif self.left[b] != b:
                limit, b = b + 1, self.left[b]
            elif self.right[a] != a:
                limit, a = a, self.right[a]
            else:
                return True

    def _borders_stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_border_stands`` of many pairs, by all merges."""
        stands = np.ones(len(a), dtype=bool)
        at, limit = np.arange(len(a)), np.full(len(a), len(self._length), dtype=np.int64)
        keys, made = self._merges
        while len(at):
            pair = a << PAIR_BITS | b
            place = np.searchsorted(keys, pair)
            crossed = (keys[place] == pair) & (made[place] < limit)
            stands[at[crossed]] = False
            left, right = self._right[a], self._left[b]
            first = (left != a) & ((a > b) | (right == b))
            go = ~crossed & (first | (right != b))
            limit = np.where(first, a, b + 1)[go]
            at, a, b = at[go], np.where(first, left, a)[go], np.where(first, b, right)[go]
        return stands

    def _compatible_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) << PAIR_BITS | b
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self._known_pairs[slot]
        new = np.flatnonzero(held >> 1 != pair)
        if len(new):
            asked, back = np.unique(pair[new], return_inverse=True)
            held[new] = (asked << 1 | self._borders_stand(asked >> PAIR_BITS, asked & ((1 << PAIR_BITS) - 1)))[back]
            self._known_pairs[slot[new]] = held[new]
        return held & 1 == 1

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of texts between blanks: ``encode_piece`` for many, whose different words are laid together."""
        usual = "".join(pieces)
        if not usual.isascii() and _UNUSUAL.search(usual):  # cut one by one where Python's own engine doesn't know the letters
            cut = [(self._usual_word if p.isascii() or not _UNUSUAL.search(p) else self._word).findall(p) for p in pieces]
            words, upto = [w for c in cut for w in c], np.cumsum([len(c) for c in cut], dtype=np.int64)
        else:
            words = self._usual_word.findall(" ".join(pieces))
            ends, piece_ends = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (words, pieces))
            upto = np.searchsorted(ends, piece_ends, "right")  # words up to a piece's end
            if not np.array_equal(np.append(0, ends)[upto], piece_ends):
                return [*map(self.encode_piece, pieces)]  # letters that no word holds
        different, codes = _numbered(words)
        packed = [*map(self._pieces.get, different)]
        made = iter(self.encode_words([w for w, p in zip(different, packed) if p is None]))
        values, sizes = _gathered([next(made) if p is None else p for p in packed], codes)
        data, places = values.tobytes(), (4 * np.append(0, np.cumsum(sizes))[upto]).tolist()
        return [data[a:b] for a, b in zip([0, *places], places)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The packed ids of pre-split words."""
        if len(words) < FEW:
            return [*map(self.encode_word, words)]
        text = "".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        if len(raw) != len(text):
            ends = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[ends]
        codes = raw.astype(np.uint16)
        codes[ends - 1] += 256  # no token holds such a letter but at its end, so matches stay within words
        starts = np.append(0, ends[:-1])
        laid = self._lay(self._matches.longest(codes, starts, ends, self._length), starts, ends, words)
        kept = laid >= 0
        data, places = laid[kept].tobytes(), (4 * np.cumsum(kept)[ends - 1]).tolist()
        return [data[a:b] for a, b in zip([0, *places], places)]

    def _lay(self, longest: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: list[str]) -> np.ndarray:
        """At each place the id of the token that begins there, or -1: the steps of ``encode_word``, taken by all words together."""
        laid = np.full(len(longest), -1, dtype=np.int32)  # numbers of tokens
        before = np.empty(len(longest) + 1, dtype=np.int64)  # of a place: where the token that ends there begins
        dead = np.zeros(len(longest) + 1, dtype=bool)
        word, at, token = np.arange(len(words)), starts, longest[starts]
        while len(word) >= FEW:
            begins, none = at == starts[word], token < 0
            tail = np.where(begins, at, before[at])  # where the last token begins
            last = laid[tail]
            end = np.where(none, at, at + self._length[token])
            fits = ~none & ~dead[end]
            ask = np.flatnonzero(fits & ~begins)
            fits[ask] = self._compatible_pairs(last[ask], token[ask])
            # a token that fits is laid
            laid[at[fits]] = token[fits]
            before[end[fits]] = at[fits]
            # where none is left, the last one is taken back and tried shorter
            dead[at[none]] = True
            laid[tail[none]] = -1
            at = np.where(fits, end, np.where(none, tail, at))
            go = ~fits | (end < ends[word])
            shorter = self._shorter[np.where(none, last, token)]
            token = np.where(fits, longest[np.minimum(at, len(longest) - 1)], shorter)
            word, at, token = word[go], at[go], token[go]
        found = laid >= 0
        laid[found] = self._ids[laid[found]]
        for i in word.tolist():  # the few longest
            ids = np.frombuffer(self.encode_word(words[i]), dtype=np.int32)
            laid[starts[i] : ends[i]] = -1
            laid[starts[i] : starts[i] + len(ids)] = ids
        return laid

    def encode_word(self, word: str) -> bytes:
        """Packed token ids of one pre-split word."""
        codes = word.encode("utf-8")
        n = len(codes)
        text = codes[:-1].decode("latin-1") + chr(codes[-1] + 256)
        longest = list(codes)  # letters' tokens have the letters' numbers
        longest[-1] += 256
        for end, (before, token) in self.matches.iter(text):
            longest[end - before] = token  # ends ascend, so the longest match of a start comes last
        at, token, length, known = 0, longest[0], self.length, self._compatible
        if length[token] == n:
            return self.packed[token]
        tokens: list[int] = []
        dead = bytearray(n + 1)
        last = -1
        while True:
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    if last < 0:
                        break
                    stands = known.get(last << 20 | token)
                    if stands is None:
                        if len(known) > PIECE_CACHE:
                            known.clear()
                        stands = known[last << 20 | token] = self._border_stands(last, token, len(length))
                    if stands:
                        break
                token = self.shorter[token]
            if token >= 0:
                tokens.append(token)
                if end == n:
                    break
                at, last, token = end, token, longest[end]
            else:
                dead[at] = 1
                token = tokens.pop()
                at -= length[token]
                token = self.shorter[token]
                last = tokens[-1] if tokens else -1
        packed = self.packed
        return b"".join([packed[t] for t in tokens])

    def _plain_pieces(self, text: str) -> list[str]:
        """What stands between the blanks of the normalised text."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter, without the final form
        if any(c in text for c in _SEPARATORS):
            return self._blank.sub(" ", text).lower().split(" ")
        return text.lower().split()

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text as int32."""
        out: list[bytes] = []
        for part in self._cut.split(text) if self._cut and "<|" in text else (text,):
            if part in self._special:
                out.append(_packed([self._special[part]]))
            elif not part.isascii() and _UNUSUAL.search(part) and any(unicodedata.category(c) == "Cn" for c in set(part)):
                # letters newer than this Python's tables: the library's own tables decide where words end
                plain = self._library.normalizer.normalize_str(part)
                out += [self.encode_word(plain[a:b]) for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(plain)]
            else:
                out += map(self._pieces.__getitem__, self._plain_pieces(part))  # words hold no blanks
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def _is_plain(self, text: str) -> bool:
        """Whether a text is encoded as what stands between its blanks, without added tokens or letters newer than Python's tables."""
        if self._cut and "<|" in text:
            return False
        return text.isascii() or not _UNUSUAL.search(text) or all(unicodedata.category(c) != "Cn" for c in set(text))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts, one after the other, and how many each has; a piece that many hold is looked up once, new ones are laid together."""
        pieces, ends, others = [], [0], []
        for text in texts:
            if self._is_plain(text):
                pieces += self._plain_pieces(text)
            else:
                pieces.append(None)
                others.append(self.encode(text).tobytes())
            ends.append(len(pieces))
        distinct, codes = _numbered(pieces)
        codes[codes < 0] = len(distinct) + np.arange(len(others))
        self._pieces.fill(distinct, self.encode_pieces)
        packed = [*map(self._pieces.__getitem__, distinct), *others]
        values, sizes = _gathered(packed, codes)
        return values, np.diff(np.append(0, np.cumsum(sizes))[ends])

    def encode_piece(self, piece: str) -> bytes:
        """The packed ids of text between two blanks."""
        words = (self._usual_word if piece.isascii() or not _UNUSUAL.search(piece) else self._word).findall(piece)
        return self.encode_word(piece) if words == [piece] else b"".join([self._pieces[w] for w in words])

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts joined by one blank; unknown ids are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)].astype(np.int64)
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        total = int(sizes.sum())
        if not total:
            return b""
        starts = np.repeat(self.offsets[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.blob[starts + np.arange(total)].tobytes()[:-1]


def _shipped(spark, path: str):
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def _loaded(digest: str, shipped) -> BpeTables:
    cache = worker_cache("bpe")
    if digest not in cache:
        cache[digest] = BpeTables(shipped.value)
    return cache[digest]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of a text column as ``array<int>``, as the vocabulary's library gives them without special tokens.

    A null or empty text has no ids (an empty array). An existing column of the result's name is replaced; rows
    are neither dropped nor joined, so repeated rows and ids stay as they are.
    """
    digest, shipped = _shipped(df.sparkSession, path)

    @arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        tables = _loaded(digest, shipped)
        # some texts at a time: the pieces of a whole batch would take many times the texts' room
        values, counts, held, room = bytearray(), [np.empty(0, np.int64)], [], 0
        for i, t in enumerate(texts, 1):
            held.append(t.as_py() or "")
            room += len(held[-1])
            if room >= TOGETHER or i == len(texts):
                found, n = tables.encode_all(held)
                values += found.data
                counts.append(n)
                held, room = [], 0
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(values, dtype=np.int32)))

    return df.withColumn(ids, ids_of(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of an ``array<int>`` of token ids: the tokens joined by one blank, special ones included.

    Null and empty arrays give the empty text; ids that the vocabulary lacks are left out.
    """
    digest, shipped = _shipped(df.sparkSession, path)

    @arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        tables = _loaded(digest, shipped)
        flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        numbers = flat.fill_null(-1).to_numpy(zero_copy_only=False)
        # the texts' bytes one after the other, as the result holds them
        values, offsets = bytearray(), [0]
        for a, b in zip(ends, ends[1:]):
            values += tables.decode(numbers[a:b])
            offsets.append(len(values))
        return pa.StringArray.from_buffers(len(lists), pa.array(offsets, pa.int32()).buffers()[1], pa.py_buffer(values))

    return df.withColumn(text, text_of(F.col(ids)))
