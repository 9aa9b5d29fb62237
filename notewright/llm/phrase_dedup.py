"""Removal of repeated passages across documents, by automata of recurring phrases.

1. Every window of ``words`` words holds an anchor: of its grams of ``gram`` words the one with the least hash. The windows
   around one anchor make a piece. Equal windows have equal anchors, so only pieces whose anchor two documents hold can
   share anything; these are told by one grouping of narrow rows.
2. Equal pieces (64 bits of anchor and 64 of the piece) are folded into one under their least document, so that copies
   cost no more than one of them.
3. The words of the distinct pieces go to shards by anchor. Anchors with very many distinct pieces are hot; their pieces
   go window by window, each to the shard of its own hash, so that no shard holds all of them.
4. A shard's task confirms, on the words themselves, which phrases recur: whole pieces where an anchor has one alone, else
   windows that two documents hold. An Aho-Corasick automaton over word numbers is compiled from them, and all
   pieces of the shard stream through it, which locates every occurrence with the least document of its phrase.
5. What was located is joined back to all pieces of all documents, and the spans of each document are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import Steps, free_name, worker_cache

BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])  # fixed values: what stands between words, for bytes.split() too
BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Settings:
    words: int = 13  # of a window
    gram: int = 5  # words of an anchor
    run: int = 32  # windows of a piece at most; more than words - gram + 1 only where a gram recurs nearby
    hot: int = 2000  # distinct pieces beyond which an anchor's windows are dealt one by one
    shard_words: int = 1_500_000  # of a shard's pieces, about


# ---- words and anchors -------------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2 to the 64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 16)
            for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                f = np.full(n, factor, dtype=np.uint64)
                f[0] = 1
                setattr(self, name, np.multiply.accumulate(f))
        return self.up, self.down


def _powers() -> Powers:
    cache = worker_cache("phrase_dedup")
    if "phrase-powers" not in cache:
        cache["phrase-powers"] = Powers()
    return cache["phrase-powers"]


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of values[start:end] for each pair, equal for equal stretches wherever they stand."""
    up, down = powers.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


LETTERS = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
PIECE = 1 << 20  # bytes that are hashed at a time


def word_hashes(data: bytes, powers: Powers) -> np.ndarray:
    """64 bits for every word of a text."""
    b, parts, at = np.frombuffer(data, dtype=np.uint8), [], 0
    while at < len(b):
        end = min(at + PIECE, len(b))
        while end < len(b) and not BLANK[b[end]]:  # not within a word
            end += 1
        edges = np.flatnonzero(np.diff(BLANK[b[at:end]], prepend=True, append=True))
        parts.append(stretches(LETTERS[b[at:end]], edges[::2], edges[1::2], powers))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def pieces_of(h: np.ndarray, s: Settings, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, print) of a document's pieces, from its words' hashes."""
    n = len(h) - s.words + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 4
    grams = np.zeros(len(h) - s.gram + 1, dtype=np.uint64)
    for i in range(s.gram):
        grams = grams * np.uint64(BASE) + h[i : len(h) - s.gram + 1 + i]
    least, span, target = mixed(grams), 1, s.words - s.gram + 1
    while span < target:
        step = min(span, target - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    counts = np.diff(np.append(starts, n))
    if counts.max() > s.run:
        more = -(-counts // s.run)
        of = np.repeat(np.arange(len(starts)), more)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
        starts, counts = starts[of] + nth * s.run, np.minimum(s.run, counts[of] - nth * s.run)
    prints = stretches(h, starts, starts + counts + s.words - 1, powers)
    return starts, counts, least[starts].view(np.int64), prints.view(np.int64)


def _joined(columns, schema: pa.Schema, most: int = 200_000):
    """Record batches of lists of columns, put together to larger ones."""
    held, n = [], 0
    for c in columns:
        held.append(pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(c, schema.types)], schema=schema))
        n += held[-1].num_rows
        if n >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# ---- automata ----------------------------------------------------------------------------------------------------


def encoded(words: pa.Array) -> list[str]:
    """Texts of words joined by a space as strings of two characters a word, which are equal where the words are.

    Neither character of a word takes more values than about the square root of the number of words, so no node of an
    automaton has many children, and first characters differ from second ones, so matches begin at words.
    """
    split = pc.split_pattern(words, " ")
    numbers = split.flatten().dictionary_encode().indices.to_numpy()
    base = math.isqrt(int(numbers.max(initial=0))) + 1
    pairs = np.stack([numbers // base, numbers % base + base], axis=1).astype("<u4") + 1
    pairs[pairs >= 0xD800] += 0x800  # no surrogates
    text, ends = pairs.tobytes().decode("utf-32-le"), (split.offsets.to_numpy().astype(np.int64) * 2).tolist()
    return [text[a:b] for a, b in zip(ends, ends[1:])]


def located(table: pa.Table, s: Settings) -> pa.Table:
    """For a shard's pieces (route, key, print, at, least, most, words): (key, print, skip, count, low) of recurring windows.

    ``at`` is the first window's place in the piece it was cut from; ``skip`` counts from there too. ``low`` is the least
    document that holds the windows.
    """
    order = np.argsort(table["least"].to_numpy(), kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    least, most = table["least"].to_pylist(), table["most"].to_pylist()
    _, of, together = np.unique(table["route"].to_numpy(), return_inverse=True, return_counts=True)
    alone = (together[of] == 1).tolist()
    texts, length = encoded(table["words"].chunk(0) if table.num_rows else pa.array([], pa.string())), 2 * s.words
    first: dict[str, int] = {}  # least document of each window
    phrases: dict[str, int] = {}  # least document of those that recur
    for single, low, high, t in zip(alone, least, most, texts):
        if single:
            if low < high:
                phrases[t] = low
            continue
        for i in range(0, len(t) - length + 1, 2):
            w = t[i : i + length]
            before = first.setdefault(w, low)  # pieces come by their least document
            if high > before:
                phrases[w] = before
    del first
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, t in enumerate(phrases):
        automaton.add_word(t, k)
    sizes, lows = [len(t) // 2 for t in phrases], list(phrases.values())
    del phrases
    out: tuple[list, list, list, list] = ([], [], [], [])  # piece, skip, count, low
    if sizes:
        automaton.make_automaton()
        for k, t in enumerate(texts):
            runs: list[list[int]] = []  # first window, windows, least document
            for end, phrase in automaton.iter(t):
                start, count, low = (end + 1) // 2 - sizes[phrase], sizes[phrase] - s.words + 1, lows[phrase]
                if runs and runs[-1][2] == low and runs[-1][0] + runs[-1][1] == start:
                    runs[-1][1] += count
                else:
                    runs.append([start, count, low])
            for start, count, low in runs:
                out[0].append(k)
                out[1].append(start)
                out[2].append(count)
                out[3].append(low)
    rows = pa.array(out[0], pa.int64())
    skip = np.array(out[1], np.int32) + table["at"].take(rows).to_numpy().astype(np.int32)
    return pa.table({"key": table["key"].take(rows), "print": table["print"].take(rows), "skip": pa.array(skip, pa.int32()),
                     "count": pa.array(out[2], pa.int32()), "low": pa.array(out[3], pa.int64())})


# ---- jobs --------------------------------------------------------------------------------------------------------


def text_hash(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text)


def repeated(df: DataFrame, text: str = "text", doc_id: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """(doc, text_hash, spans): for texts with any, the ranges [start, end) of words in windows that also start in a smaller document.

    ``spans`` is array<struct<start:int,end:int>>, disjoint, ascending, maximal. Rows that repeat an id don't repeat each other.
    """
    t = F.col(text)
    docs = df.where(F.col(doc_id).isNotNull() & t.isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), text_hash(t).alias("text_hash"), t.cast("binary").alias("data"))

    def placed(batches):
        powers, schema = _powers(), pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int64()), ("key", pa.int64()), ("print", pa.int64())])

        def columns():
            for b in batches:
                for doc, text_hash, data in zip(b["doc"].to_pylist(), b["text_hash"].to_pylist(), b["data"]):
                    first, count, key, mark = pieces_of(word_hashes(data.as_py(), powers), s, powers)
                    if len(key):
                        yield np.full(len(key), doc), np.full(len(key), text_hash), first << 8 | count, key, mark

        yield from _joined(columns(), schema)

    steps = Steps(df.sparkSession, "phrase-dedup")
    pieces = steps.written(docs.mapInArrow(placed, "doc long, text_hash long, place long, key long, print long"), "pieces")
    shared = steps.written(pieces.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("key"), "shared-anchors")
    held = steps.written(pieces.join(shared, "key", "left_semi").select(pieces.columns), "shared-pieces")
    steps.drop("pieces")
    source = F.min(F.struct("doc", "text_hash", "place")).alias("source")
    distinct = steps.written(held.groupBy("key", "print").agg(source, F.max("doc").alias("most")), "distinct-pieces")
    hot = steps.written(distinct.groupBy("key").count().where(F.col("count") > s.hot).select("key", F.lit(True).alias("hot")), "hot-anchors")
    wanted = distinct.join(hot, "key", "left").groupBy(F.col("source.doc").alias("doc"), F.col("source.text_hash").alias("text_hash")).agg(
        F.collect_list(F.struct(F.col("source.place").alias("place"), "key", "print", "most", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))

    def cut(batches):
        powers = _powers()
        schema = pa.schema([("route", pa.int64()), ("key", pa.int64()), ("print", pa.int64()), ("at", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("words", pa.string())])

        def columns():
            for b in batches:
                for doc, data, asked in zip(b["doc"].to_pylist(), b["data"], b["asked"]):
                    words = data.as_py().split()
                    text, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    place, key, mark, most, hot = (asked.values.field(c).to_numpy(zero_copy_only=False) for c in ("place", "key", "print", "most", "hot"))
                    first, count, at, route = place >> 8, place & 255, np.zeros(len(place), np.int64), key
                    if hot.any():  # a row for each of their windows
                        whole, each = np.flatnonzero(~hot), np.repeat(np.flatnonzero(hot), count[hot])
                        nth = np.arange(len(each)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
                        starts = first[each] + nth
                        own = stretches(word_hashes(data.as_py(), powers), starts, starts + s.words, powers).view(np.int64)
                        route = np.concatenate([key[whole], own])
                        first, count = np.concatenate([first[whole], starts]), np.concatenate([count[whole], np.ones(len(each), np.int64)])
                        at, of = np.concatenate([at[whole], nth]), np.concatenate([whole, each])
                        key, mark, most = key[of], mark[of], most[of]
                    last = ends[first + count + s.words - 2]
                    begin = np.where(first > 0, ends[first - 1] + 1, 0)
                    cuts = pa.array([text[x:y] for x, y in zip(begin.tolist(), last.tolist())], pa.binary()).cast(pa.string())
                    yield route, key, mark, at.astype(np.int32), np.full(len(key), doc), most, cuts

        yield from _joined(columns(), schema, 20_000)

    # rows that repeat id and text meet in their tasks first
    once = docs.groupBy("doc", "text_hash").agg(F.first("data").alias("data"))
    texts = once.join(wanted, ["doc", "text_hash"]).select("doc", "data", "asked")
    texts = texts.mapInArrow(cut, "route long, key long, print long, at int, least long, most long, words string")
    volume = distinct.agg(F.sum(F.col("source.place").bitwiseAND(F.lit(255)) + s.words - 1)).first()[0] or 0
    shards = max(1, -(-volume // s.shard_words))
    judged = texts.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).groupBy("shard").applyInArrow(
        lambda table: located(table.drop_columns("shard"), s), "key long, print long, skip int, count int, low long")
    told = steps.written(judged.groupBy("key", "print").agg(F.collect_set(F.struct("skip", "count", "low")).alias("runs")), "located-phrases")
    first = F.shiftright("place", 8).cast("int")
    covered = held.join(told, ["key", "print"]).select("doc", "text_hash", first.alias("first"), F.inline("runs")).where("low < doc").select(
        "doc", "text_hash", (F.col("first") + F.col("skip")).alias("start"), (F.col("first") + F.col("skip") + F.col("count") + s.words - 1).alias("end"))
    spans = covered.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return steps.written(spans.select("doc", "text_hash", merged("spans").alias("spans")), "repeated-words")


def merged(spans: Column) -> Column:
    """Sorted ranges, those that meet or overlap put together."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def union(lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        start, end = (flat.field(c).to_numpy() for c in ("start", "end"))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # ends that are carried on stay within their own list: lists are set far apart
        gap = (int(end.max()) + 2) if len(end) else 1
        reach = np.maximum.accumulate(end + owner * gap) - owner * gap
        fresh = np.ones(len(flat), dtype=bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])
        at = np.flatnonzero(fresh)
        last = np.append(at[1:] - 1, len(flat) - 1)[: len(at)]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(sizes)))]).astype(np.int32)
        both = pa.StructArray.from_arrays([pa.array(start[at], pa.int32()), pa.array(reach[last].astype(np.int32), pa.int32())], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets), both)

    return union(spans)


def without_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", result: str = "repeats", s: Settings = Settings()) -> DataFrame:
    """Adds ``result``, a struct of n_words, spans (ranges of removed words) and kept (the other words, joined by one space).

    A null text has no words and an empty ``kept``; texts of fewer words than a window lose none. Rows that repeat an id
    count as one document, so they don't repeat each other, but each loses what smaller documents hold, by its own text. A
    row without an id is compared with nothing. A column named like the result is replaced, no other is touched; an empty
    table gives an empty result.
    """
    found = repeated(df, text, doc_id, s)
    key, mark, spans, out = (free_name(df, x) for x in ("_doc", "_text_hash", "_spans", "_kept"))
    found = found.toDF(key, mark, spans)
    joined = df.join(found, (F.col(doc_id).cast("long") == F.col(key)) & (text_hash(F.col(text)) == F.col(mark)), "left")

    @F.arrow_udf("struct<n_words:long,kept:string>")
    def rest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        counts, kept = [], []
        for t, x in zip(texts, spans):
            words, at, parts = (t.as_py() or b"").split(), 0, []
            for y in x.as_py() or []:
                parts += words[at : y["start"]]
                at = y["end"]
            parts += words[at:]
            counts.append(len(words))
            kept.append(b" ".join(parts))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "kept"])

    joined = joined.withColumn(out, rest(F.col(text).cast("binary"), F.col(spans)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    done = joined.withColumn(out, F.struct(F.col(f"{out}.n_words").alias("n_words"), F.coalesce(spans, none).alias("spans"), F.col(f"{out}.kept").alias("kept")))
    return done.withColumn(result, F.col(out)).drop(key, mark, spans, out)
