"""Runs of characters as numbers of 64 bits, and a membership filter over them that texts are tested against in their row."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = T.ArrayType(T.LongType())
_BASE = 0x9E3779B97F4A7C15
# Runs of at most so many characters have numbers of their own; those of longer ones can meet by chance.
EXACT = 3
# Characters of the runs that are signs of a term, and how many signs are told apart.
SIGN, SIGNS = 4, 1 << 16
# Words of 64 bits of a filter: a quarter of the runs, so 16 bits for each, up to 32 MB. Beyond that a filter lets more
# runs through that no term has, and the join drops them.
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 22


def points(text: str) -> np.ndarray:
    """A text's code points."""
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


class Runs:
    """Numbers of a text's runs of any length up to 15, put together of runs of 1, 2, 4 and 8."""

    def __init__(self, text: str):
        self.parts = {1: points(text) + np.uint64(1)}

    def _part(self, n: int) -> np.ndarray:
        if n not in self.parts:
            half = self._part(n // 2)
            self.parts[n] = half[: len(half) - n // 2] * np.uint64(pow(_BASE, n // 2, 1 << 64)) + half[n // 2 :]
        return self.parts[n]

    def of(self, length: int, stride: int = 1) -> np.ndarray:
        """The run at every ``stride``-th place, in order."""
        n, out, at = len(self.parts[1]) - length + 1, None, 0
        if n < 1:
            return np.empty(0, np.int64)
        if length <= EXACT:  # side by side: 21 bits a character, the highest bit free
            x = self.parts[1][:n:stride]
            for i in range(1, length):
                x = x << np.uint64(21) | self.parts[1][i : i + n : stride]
        else:
            for p in (8, 4, 2, 1):
                if length & p:
                    piece = self._part(p)[at : at + n : stride]
                    out = piece if out is None else out * np.uint64(pow(_BASE, p, 1 << 64)) + piece
                    at += p
            x = (out ^ np.uint64(length << 56)) | np.uint64(1 << 63)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


@F.arrow_udf(NUMBERS)
def all_runs(text: pa.Array, length: pa.Array) -> pa.Array:
    """Every run of a term, in order."""
    return _lists([Runs(t.as_py()).of(n.as_py()) for t, n in zip(text, length)])


class RunFilter:
    """Tells which numbers may be among the given ones; those that are always pass."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(runs: DataFrame, column: str, count: int) -> RunFilter:
        """Of a column of about ``count`` numbers: every word is put together by an aggregation, and the words, of bounded size, come here."""
        n = min(max(1 << max(count // 4, 1).bit_length(), LEAST_WORDS), MOST_WORDS)
        bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({column}, {6 * i}) & 63 as int))" for i in range(4))
        word = F.expr(f"cast(shiftrightunsigned({column}, 24) & {n - 1} as int)")
        filled = runs.select(word.alias("w"), F.expr(bits).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(n, dtype=np.int64)
        words[filled["w"].to_numpy()] = filled["b"].to_numpy()
        return RunFilter(words.view(np.uint64))

    def passing(self, values: np.ndarray) -> np.ndarray:
        v, one = values.view(np.uint64), np.uint64(1)
        mask = one << (v & np.uint64(63))
        for i in range(1, 4):
            mask |= one << ((v >> np.uint64(6 * i)) & np.uint64(63))
        return values[self.words[(v >> np.uint64(24)) & np.uint64(len(self.words) - 1)] & mask == mask]

    def opened(self, spark: SparkSession, text: Column, kinds: Iterable[tuple[int, int]]) -> Column:
        """The distinct runs of a text, of each kind (length, stride), that pass; none of a null text."""
        kinds, shared = list(kinds), spark.sparkContext.broadcast(self.words)

        def kept(texts: pa.Array) -> pa.Array:
            filter_, out = RunFilter(shared.value), []
            for t in texts:
                runs = Runs(t.as_py() or "")
                found = [filter_.passing(runs.of(*kind)) for kind in kinds]
                out.append(np.unique(np.concatenate(found)) if found else np.empty(0, np.int64))
            return _lists(out)

        # marked so that a filter on the result is not evaluated apart from it, before rows are spread
        return F.arrow_udf(kept, NUMBERS).asNondeterministic()(text)


class FiledTerms:
    """The terms of a dictionary that may be broadcast, looked up by the runs that they are filed by."""

    def __init__(self, runs: np.ndarray, places: np.ndarray, terms: list[str], signs: np.ndarray):
        self.runs, self.places, self.terms, self.signs = runs, places, terms, signs

    @staticmethod
    def made(runs: np.ndarray, places: np.ndarray, terms: list[str]) -> FiledTerms:
        """With each term's signs: the low bits of its first, middle and last run of ``SIGN`` characters, if it has any."""
        order, signs = np.argsort(runs, kind="stable"), np.full((len(terms), 3), -1, np.int32)
        for i, t in enumerate(terms):
            if len(own := Runs(t).of(SIGN)):
                signs[i] = own[[0, len(own) // 2, -1]] & (SIGNS - 1)
        return FiledTerms(runs[order], places[order].astype(np.int64), terms, signs)

    @staticmethod
    def of(filed: DataFrame, term: str, run: str) -> FiledTerms:
        rows = filed.select(term, run).toArrow()
        terms = rows[term].cast(pa.string()).combine_chunks().dictionary_encode()
        return FiledTerms.made(rows[run].to_numpy(), terms.indices.to_numpy(zero_copy_only=False), terms.dictionary.to_pylist())

    def within(self, text: str, opened: Runs, runs: np.ndarray) -> list[int]:
        """Places of the terms that a text contains, of those that its distinct ``runs`` lead to.

        Most others lack a sign in the text, so that it need not be searched for them.
        """
        if not len(runs):
            return []
        seen = np.zeros(SIGNS + 1, np.bool_)
        seen[opened.of(SIGN) & (SIGNS - 1)] = True
        seen[-1] = True  # what stands for no sign
        first, last = np.searchsorted(self.runs, runs, "left"), np.searchsorted(self.runs, runs, "right")
        n = last - first
        at = np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())
        met = np.unique(self.places[at])
        met = met[seen[self.signs[met]].all(axis=1)].tolist()
        return [i for i in met if len(self.terms[i]) <= EXACT or self.terms[i] in text]

    def contained(self, spark: SparkSession, text: Column, filter_: RunFilter, kinds: Iterable[tuple[int, int]]) -> Column:
        """The distinct places of the terms that a text contains; a run is one of its kinds (length, stride) that passes the filter."""
        kinds, shared = list(kinds), spark.sparkContext.broadcast((filter_.words, self.runs, self.places, self.terms, self.signs))

        def found(texts: pa.Array) -> pa.Array:
            words, *filed = shared.value
            filter_, filed, out = RunFilter(words), FiledTerms(*filed), []
            for t in texts:
                text = t.as_py() or ""
                opened = Runs(text)
                met = np.unique(np.concatenate([filter_.passing(opened.of(*kind)) for kind in kinds]))
                out.append(np.array(filed.within(text, opened, met), np.int64))
            return _lists(out)

        return F.arrow_udf(found, NUMBERS).asNondeterministic()(text)

    def listed(self, spark: SparkSession, place: str, term: str) -> DataFrame:
        """The terms with their places."""
        return spark.createDataFrame(pa.table({place: pa.array(range(len(self.terms)), pa.int64()), term: pa.array(self.terms, pa.string())}))
