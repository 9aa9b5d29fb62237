"""Benchmark decontamination: test items under a BM25 index, queried by every training passage with block-max WAND.

Items are cut into shards of bounded size; each shard's index goes to the workers in turn. Documents are read whole
as overlapping passages of words. A passage retrieves the items whose BM25 score reaches the least that any copy has
which verification accepts, so retrieval hides none; those are verified by the overlap of word runs with the item's question and answer, short ones
also by their words in order with some edits, very short ones exactly. Items without an answer of their own are plain passages: they are also
found where runs cover enough of all their words, whichever of their sentences was changed or cut off.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import worker_cache, written

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Settings:
    k1: float = 1.2
    b: float = 0.75
    run: int = 5  # words of a run that is compared
    question_share: float = 0.5  # of the question's runs that the document must hold near the passage; of all words, of a plain passage
    answer_share: float = 0.5  # of the answer's
    block: int = 4  # items of a block
    shard_bytes: int = 1 << 20  # items' text in one index
    least_words: int = 5  # shorter items are looked for word by word as they are, without edits
    matrix: int = 1 << 22  # numbers of the (terms of some passages) by (blocks) matrix
    passage: int = 64  # words; at least twice the step, and never shorter than the shard's longest item


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer; what is before it is its question (all of it, if there is one sentence)."""
    parts = _SENTENCE_END.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def runs(w: list[str], n: int) -> set[tuple[str, ...]]:
    """All runs of n words; all words as one run if there are fewer."""
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def edits(part: list[str], w: list[str]) -> int:
    """The fewest words to change, add or leave out between a part and any stretch of words."""
    row = list(range(len(part) + 1))
    best = row[-1]
    for x in w:
        new = [0]
        for i, y in enumerate(part):
            new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def least_mass(masses: list[float], n: int, words_needed: int) -> float:
    """The least sum that stretches of at least n places each, ``words_needed`` places in all, can have.

    ``free[j]`` has the least sum with j places chosen so far (the last one for any larger number), the current place not chosen;
    ``running[j]`` the same where a stretch of at least n ends or goes on here.
    """
    if len(masses) <= n or words_needed >= len(masses):
        return sum(masses)
    width, total = words_needed + 1, np.concatenate([[0.0], np.cumsum(masses)])
    free, running = np.full(width, np.inf), np.full(width, np.inf)
    free[0] = 0.0
    before = deque([free], maxlen=n)  # what was free up to n places ago

    def moved(row: np.ndarray, by: int, mass: float) -> np.ndarray:
        out = np.full(width, np.inf)
        out[min(by, width - 1) :] = row[: width - min(by, width - 1)]
        out[-1] = min(out[-1], row[max(width - 1 - by, 0) :].min())
        return out + mass

    for i in range(1, len(masses) + 1):
        free, running = np.minimum(free, running), moved(running, 1, masses[i - 1])
        if i >= n:
            running = np.minimum(running, moved(before[0], n, total[i] - total[i - n]))
        before.append(free)
    return float(min(free[-1], running[-1]))


class Index:
    """BM25 postings in blocks of items, with the largest score of each term in each block.

    With ``plain``, questions and answers are the two parts of plain passages.
    """

    def __init__(self, items: list[tuple[int, str, str]], s: Settings, plain: bool = False):
        self.s, self.plain = s, plain
        kept = [(i, words(q), words(a)) for i, q, a in items]
        kept = [x for x in kept if x[1] or x[2]]
        self.ids = [i for i, _, _ in kept]
        self.questions = [runs(q, s.run) for _, q, _ in kept]
        self.answers = [runs(a, s.run) for _, _, a in kept]
        bags = [Counter(q + a) for _, q, a in kept]
        sizes = [sum(b.values()) for b in bags]
        self.longest = max(sizes, default=0)
        mean = sum(sizes) / max(len(sizes), 1)
        df = Counter(t for b in bags for t in b)
        self.terms = {t: i for i, t in enumerate(sorted(df))}
        idf = {t: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        scores = []
        for d, b in enumerate(bags):
            norm = s.k1 * (1 - s.b + s.b * sizes[d] / max(mean, 1e-9))
            scores.append({t: idf[t] * n * (s.k1 + 1) / (n + norm) for t, n in b.items()})
        self.parts = [(q, a) for _, q, a in kept]
        needed = [self.least_score(*self.parts[d], scores[d], bags[d]) for d in range(len(kept))]
        # items that need like scores share a block, so that a block's least threshold says much
        order = sorted(range(len(kept)), key=lambda d: (needed[d], self.ids[d]))
        self.ids, self.questions, self.answers, self.parts = ([x[d] for d in order] for x in (self.ids, self.questions, self.answers, self.parts))
        scores, self.needed = [scores[d] for d in order], [needed[d] for d in order]
        blocks = -(-len(kept) // s.block)
        self.lists: list[dict[int, list[tuple[int, float]]]] = [{} for _ in self.terms]
        self.upper = np.zeros((len(self.terms), blocks), dtype=np.float32)
        for d, x in enumerate(scores):
            for t, y in x.items():
                t, k = self.terms[t], d // s.block
                self.lists[t].setdefault(k, []).append((d, y))
                self.upper[t, k] = max(self.upper[t, k], np.nextafter(np.float32(y), np.float32(np.inf)))
        self.least = np.array([min(self.needed[k * s.block : (k + 1) * s.block]) for k in range(blocks)], dtype=np.float64)

    def least_score(self, q: list[str], a: list[str], score: dict[str, float], bag: Counter) -> float:
        """The least score of any stretch that ``verified`` accepts; a term's score is dealt among its places, so no sum says too much."""
        s, whole = self.s, q + a
        mass = lambda part: [score[t] / bag[t] for t in part]
        if len(whole) < s.least_words:
            return sum(score.values())

        def in_order(part):  # some words of a short part may be edited, wherever they stand
            return sum(sorted(mass(part))[: len(part) - len(part) // 3]) if 3 <= len(part) < 3 * s.run else math.inf

        def by_runs(part, share):
            if not part or share <= 0:
                return 0.0
            matched = max(1, math.ceil(share * len(runs(part, s.run)) - 1e-9))
            return min(in_order(part), least_mass(mass(part), s.run, matched + s.run - 1))

        least = by_runs(q, s.question_share) + by_runs(a, s.answer_share)
        if self.plain:
            least = min(least, in_order(whole), least_mass(mass(whole), s.run, math.ceil(s.question_share * len(whole) - 1e-9)))
        return least

    def live(self, terms: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, block) pairs whose largest scores add up to what an item of the block needs at least.

        ``terms`` has the passages' distinct terms, one passage after the other, each from its place in ``starts``. Some
        passages are added up at a time, so that room is bounded however long the text.
        """
        ends, least = np.append(starts[1:], len(terms)), self.least * (1 - 1e-5)
        most = max(1, self.s.matrix // max(1, self.upper.shape[1]))
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + most, side="right")))
            bounds = np.add.reduceat(self.upper[terms[starts[first] : ends[last - 1]]], starts[first:last] - starts[first], axis=0)
            for i, block in np.argwhere(bounds >= least).tolist():
                yield first + i, block
            first = last

    def retrieve(self, terms: list[int], block: int) -> list[int]:
        """Items of a block whose score for the distinct terms reaches what they need, by WAND with the block's largest scores."""
        cursors = [[p, 0, float(self.upper[t, block])] for t in terms if (p := self.lists[t].get(block))]
        least, out = float(self.least[block]) * (1 - 1e-5), []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[2]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][1]][0]
            if cursors[0][0][cursors[0][1]][0] == item:
                score = sum(c[0][c[1]][1] for c in cursors if c[0][c[1]][0] == item)
                if score >= self.needed[item] - 1e-9:
                    out.append(item)
                item += 1
            kept = []
            for c in cursors:  # nothing before the pivot's item can reach the threshold
                p, at = c[0], c[1]
                while at < len(p) and p[at][0] < item:
                    at += 1
                if at < len(p):
                    c[1] = at
                    kept.append(c)
            cursors = kept
        return out

    def verify(self, item: int, w: list[str]) -> tuple[float, float]:
        """Shares of the question's and the answer's runs among a stretch of words; 1 for an empty answer.

        A part so short that one edit may take half of its runs has its share of words in order, if that is more and no
        more than one word in three was edited.
        """
        n = self.s.run
        have = runs(w, n)
        short = {r for part in (self.questions[item], self.answers[item]) for r in part if len(r) < n}
        if short:  # parts shorter than a run are looked for as they are
            for k in {len(r) for r in short}:
                have |= runs(w, k)
        (q, a), s = self.parts[item], self.s
        share = lambda part: len(part & have) / len(part) if part else 1.0
        question, answer = share(self.questions[item]), share(self.answers[item])
        if question < s.question_share:
            question = max(question, self.in_order(q, w))
        if answer < s.answer_share:
            answer = max(answer, self.in_order(a, w))
        return question, answer

    def in_order(self, part: list[str], w: list[str]) -> float:
        """The share of a short part's words that a stretch holds in order; 0 beyond the edits allowed and for long parts."""
        if not 3 <= len(part) < 3 * self.s.run:
            return 0.0
        n = edits(part, w)
        return 1 - n / len(part) if n <= len(part) // 3 else 0.0

    def verified(self, item: int, w: list[str]) -> tuple[float, float] | None:
        """The shares, if they are large enough or, for a plain passage, if the stretch holds enough of it as a whole."""
        s = self.s
        if sum(map(len, self.parts[item])) < s.least_words:  # exactly, every part
            return (1.0, 1.0) if all(not p or tuple(p) in runs(w, len(p)) for p in self.parts[item]) else None
        q, a = self.verify(item, w)
        if q >= s.question_share and a >= s.answer_share:
            return q, a
        if self.plain:
            whole, n = [*self.parts[item][0], *self.parts[item][1]], s.run
            have, covered = runs(w, n), np.zeros(len(whole), dtype=bool)
            for i in range(len(whole) - n + 1):
                if tuple(whole[i : i + n]) in have:
                    covered[i : i + n] = True
            if max(covered.mean(), self.in_order(whole, w)) >= s.question_share:
                return q, a
        return None

    def leaks(self, text: str) -> list[tuple[int, float, float]]:
        """(item id, question share, answer share) of the verified items of a whole text."""
        if not text or not self.ids:
            return []
        w = words(text)
        get = self.terms.get
        t = np.array([get(x, -1) for x in w], dtype=np.int64)
        size = max(self.s.passage, 2 * self.longest)
        step = size // 2
        passages = max(-(-(len(w) - step) // step), 1)  # each begins a step after the last one
        at = np.flatnonzero(t >= 0)
        if not len(at):
            return []
        # a word is in the passage that begins in its step and in the one before
        n = len(self.terms)
        second = at // step
        keys = np.concatenate([second[second < passages] * n + t[at[second < passages]], (second[second > 0] - 1) * n + t[at[second > 0]]])
        keys = np.unique(keys)
        owner, starts = np.unique(keys // n, return_index=True)
        found: dict[int, tuple[float, float]] = {}
        ends = [*starts[1:].tolist(), len(keys)]
        for i, block in self.live(keys % n, starts):
            a = int(owner[i]) * step
            for item in self.retrieve((keys[starts[i] : ends[i]] % n).tolist(), block):
                shares = self.verified(item, w[a : a + size])  # each passage by itself: the largest shares may fail
                if shares and shares > found.get(item, (-1.0, -1.0)):
                    found[item] = shares
        return sorted((self.ids[k], q, a) for k, (q, a) in found.items())


LEAK = "array<struct<item_id:long,question:double,answer:double>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("question", pa.float64()), ("answer", pa.float64())]))


def shards(items: DataFrame, item_id: str, question: Column, answer: Column, s: Settings):
    """The items in lists of at most ``shard_bytes`` of text (one item alone may be longer), one list at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(question, F.lit("")).alias("q"), F.coalesce(answer, F.lit("")).alias("a"))
    rows = written(rows.where("i is not null").dropDuplicates(), "benchmark-items")
    total = rows.agg(F.sum(F.octet_length("q") + F.octet_length("a"))).first()[0] or 0
    n = max(1, math.ceil(1.5 * total / s.shard_bytes))
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i", "q", "a").collect()]


def leaked_items(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                 question: Column | None = None, answer: Column | None = None, s: Settings = Settings(), out: str = "leaks") -> DataFrame:
    """Adds the verified benchmark items of every row's whole text, with the shares of question and answer found.

    Without ``question`` and ``answer`` the items are plain passages: their ``text`` is divided, its last sentence taken as
    the answer, and an item also leaks where enough of the whole is found, whatever the shares. Null and empty
    texts and items leak nothing; items under ``least_words`` leak where each of their parts stands word for word; repeated
    items count once, repeated rows stay;
    an existing column of the result's name is replaced.
    """
    plain = question is None
    if plain:
        split = F.split(F.trim("text"), r"(?<=[.!?])\s+")
        question = F.when(F.size(split) > 1, F.array_join(F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0))), " ")).otherwise(F.col("text"))
        answer = F.when(F.size(split) > 1, F.element_at(split, -1)).otherwise("")
    parts = [_searcher(df, rows, k, s, plain)(F.col(text)) for k, rows in enumerate(shards(items, item_id, question, answer if answer is not None else F.lit(""), s))]
    return df.withColumn(out, F.array_sort(F.concat(*parts)))


def _searcher(df: DataFrame, rows: list, k: int, s: Settings, plain: bool):
    """The function that searches texts for one shard's items."""
    shipped, token = df.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex  # at most shard_bytes of text

    @F.arrow_udf(LEAK)
    def search(texts: pa.Array) -> pa.Array:
        cache, slot = worker_cache("decontamination"), f"bm25-{k}"
        if cache.get(slot, ("",))[0] != token:
            cache[slot] = token, Index(shipped.value, s, plain)
        index = cache[slot][1]
        return pa.array([[dict(zip(("item_id", "question", "answer"), x)) for x in index.leaks(t.as_py())] for t in texts], _ARROW)

    return search
