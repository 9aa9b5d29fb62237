"""Removal of repeated byte strings across documents, by sorting suffixes.

Every string of ``length`` bytes holds an anchor: of its short grams the one with the least hash gives the place, and the bytes
around it, over half of the string, are the key. Strings that are equal have the same key at the same place, so a document's
strings with one anchor occurrence (a stretch) can be judged together with those of equal keys, in one shard, wherever they
stem from. Stretches travel as places with a hash, many in one row, dealt out by their keys. Keys that one text alone holds, in
however many copies, are left out; where all stretches of a key are equal, the least document keeps them. Of the others the
bytes of each different one go to a shard.

Within a shard all suffixes of its stretches are sorted by induction: the order of the leftmost S suffixes induces that
of all others, bucket by bucket, through queues of suffix tuples that go to disk when they outgrow their room.
Neighbours in that order with a common prefix of at least ``length`` bytes are equal strings.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import partial, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import Steps, free_name, worker_cache
from notewright.llm.ngram_join import WordHashes


@dataclass(frozen=True)
class Settings:
    length: int = 50  # bytes of a string that counts as repeated
    gram: int = 16  # twice the bytes of the short grams that give an anchor's place
    shard_bytes: int = 3 << 20  # distinct stretches sorted together, about
    queue_bytes: int = 64 << 20  # of a shard's queues in memory


# ---- sorting suffixes ------------------------------------------------------------------------------------------


class Queues:
    """First-in-first-out queues of positions, one per first letter; the longest go to a file when memory is short."""

    def __init__(self, room: int):
        self.parts: dict[int, list] = {}
        self.room, self.held, self.file = room, 0, None

    def push(self, letters: np.ndarray, positions: np.ndarray) -> None:
        """Appends each position to its letter's queue, in the given order."""
        if not len(letters):
            return
        order = np.argsort(letters, kind="stable")
        letters, positions = letters[order], positions[order]
        cuts = np.flatnonzero(np.diff(letters)) + 1
        for part, letter in zip(np.split(positions, cuts), letters[np.concatenate([[0], cuts])].tolist()):
            self.parts.setdefault(letter, []).append(part)
        self.held += positions.nbytes
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # the task's own scratch, gone with it
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for i, p in enumerate(parts):
                if isinstance(p, np.ndarray):
                    at = self.file.tell()
                    p.tofile(self.file)
                    parts[i] = (at, len(p), p.dtype)
        self.held = 0

    def pop(self, letter: int) -> np.ndarray:
        """All of a letter's queue, oldest first."""
        out = []
        for p in self.parts.pop(letter, []):
            if isinstance(p, tuple):
                self.file.seek(p[0])
                p = np.fromfile(self.file, dtype=p[2], count=p[1])
            else:
                self.held -= p.nbytes
            out.append(p)
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (type S); the last one is."""
    n = len(s)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induced(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int, room: int) -> np.ndarray:
    """All suffixes in the order that sorted leftmost S suffixes (``seeds``) induce."""
    by_letter = Queues(room)
    by_letter.push(s[seeds], seeds)
    waiting, larger = Queues(room), [np.empty(0, np.int64)] * letters
    # the last suffix is preceded by none of its kind: what stands before the text's end starts the induction too
    for c in range(letters):
        out, batch = [], waiting.pop(c)
        while len(batch):
            out.append(batch)
            before = batch[batch > 0] - 1
            before = before[~small[before]]
            own = s[before] == c
            waiting.push(s[before[~own]], before[~own])
            batch = before[own]
        larger[c] = np.concatenate(out) if out else batch
        star = by_letter.pop(c)
        before = star[star > 0] - 1
        before = before[~small[before]]
        waiting.push(s[before], before)
    waiting, parts = Queues(room), []
    for c in range(letters - 1, -1, -1):
        out, batch = [], waiting.pop(c)
        if s[-1] == c:  # the text's last suffix is the least of its letter, after all others were taken
            last = np.array([len(s) - 1])
        else:
            last = np.empty(0, np.int64)
        while len(batch) or len(last):
            if not len(batch):
                batch, last = last, np.empty(0, np.int64)
            out.append(batch)
            before = batch[batch > 0] - 1
            before = before[small[before]]
            own = s[before] == c
            waiting.push(s[before[~own]], before[~own])
            batch = before[own]
        if out:
            parts.append(np.concatenate(out))
        back = larger[c][::-1]
        before = back[back > 0] - 1
        before = before[small[before]]
        waiting.push(s[before], before)
        parts.append(back)
    return np.concatenate(parts)[::-1]


def suffix_order(s: np.ndarray, letters: int, depth: int, room: int) -> np.ndarray:
    """Places of a text's suffixes, sorted by their first ``depth`` letters at least; letters are 0 to ``letters`` - 1."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = _smaller_than_next(s)
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = _induced(s, small, star, letters, room)
    is_star = np.zeros(n, dtype=bool)
    is_star[star] = True
    ranked = order[is_star[order]]  # sorted by their stretch up to the next leftmost S suffix
    if len(ranked) > 1:
        number = np.zeros(n, dtype=np.int32)
        number[star] = np.arange(len(star))
        of = number[ranked]
        del number, order, ranked, is_star
        ends = np.append(star[1:] + 1, n)  # a stretch holds its successor's first letter
        with np.errstate(over="ignore"):
            power = np.full(n + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            letter = (np.arange(letters, dtype=np.uint64) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93) % np.uint64(2**61 - 1)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.take(letter, s, out=sums[1:])
            sums[1:] *= power[:n]
            np.cumsum(sums, out=sums)
            # brought to a common place: equal stretches give equal values wherever they stand
            value = (sums[ends] - sums[star]) * power[n - star]
        del power, sums
        size = ends - star
        fresh = np.concatenate([[True], (value[of[1:]] != value[of[:-1]]) | (size[of[1:]] != size[of[:-1]])])
        del value, size, ends
        # a stretch's rank is the place of the first one that equals it
        rank = np.zeros(len(star), dtype=np.int64)
        rank[of] = np.maximum.accumulate(np.where(fresh, np.arange(len(star)), 0))
        tied, reach = of[~(fresh & np.append(fresh[1:], True))], 1
        # names of ever longer runs of stretches, each at least two letters long, until they tell all suffixes apart to the depth
        while len(tied) and reach * 2 <= depth + 2:
            nxt = tied + reach
            inside = nxt < len(star)
            pair = rank[tied] * np.int64(len(star) + 1)  # one number, as a rank is less than the number of stretches
            pair[inside] += rank[nxt[inside]] + 1
            key = np.argsort(pair)
            tied, pair = tied[key], pair[key]
            before, places = rank[tied], np.arange(len(tied))
            fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
            group = np.concatenate([[True], before[1:] != before[:-1]])
            rank[tied] = before + np.maximum.accumulate(np.where(fresh, places, 0)) - np.maximum.accumulate(np.where(group, places, 0))
            tied, reach = tied[~(fresh & np.append(fresh[1:], True))], reach * 2
        seeds = star[np.argsort(rank, kind="stable")]
        order = _induced(s, small, seeds, letters, room)
    return order


def equal_windows(stretches: list[bytes], length: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, place, group) of every string of ``length`` bytes of the stretches; equal strings share a group."""
    if not stretches:
        return (np.empty(0, np.int64),) * 3
    sizes = np.array([len(x) for x in stretches], dtype=np.int64)
    plain = np.frombuffer(b"\0".join(stretches) + b"\0" * 9, dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    n = int(sizes.sum() + len(sizes))
    s = plain[:n].astype(np.int16) + 1
    s[starts + sizes] = 0
    order = suffix_order(s, 257, length, room)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    whole = np.arange(n) + length <= (starts + sizes)[owner]
    order = order[whole[order]]
    words = np.ndarray(shape=(len(plain) - 7,), dtype="<u8", buffer=plain.data, strides=(1,))
    same = np.arange(1, len(order))  # neighbours that are equal so far
    for at in [*range(0, length - 7, 8), length - 8]:
        same = same[words[order[same] + at] == words[order[same - 1] + at]]
    fresh = np.ones(len(order), dtype=bool)
    fresh[same] = False
    owner = owner[order]
    return owner, order - starts[owner], np.cumsum(fresh) - 1


# ---- anchors and stretches --------------------------------------------------------------------------------------


BASE = 0x9E3779B97F4A7C15
HALVES = 2  # shares of the anchors, worked on one after the other
TOGETHER = 1 << 17  # bytes of texts whose anchors are looked for at once
PART_BYTES = 8 << 20  # of texts, whose stretches of one half are compared together on average
DEALT = 1 << 18  # stretches that are dealt out to the parts at once, about


def _least(h: np.ndarray, width: int, span: int = 1) -> np.ndarray:
    """The least of every ``width`` neighbours, of values that are the least of ``span`` already."""
    while span < width:
        step = min(span, width - span)
        h, span = np.minimum(h[: len(h) - step], h[step:]), span + step
    return h


def anchors_of(data: bytes, sizes: np.ndarray, s: Settings, half: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one key, of texts that stand one after the other: (text, first string's place, number of strings, key).

    The gram of least hash, the first of equal ones, gives a string's anchor its place. The key is a hash of ``around`` bytes: those
    from the gram on where they fit into the string, else those up to its end. ``half`` leaves the other halves' anchors out.
    """
    gram = max(1, s.gram // 2)
    around = (s.length + gram + 1) // 2
    n = len(data) - s.length + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 4
    letters = np.frombuffer(data + bytes(8), dtype=np.uint8)
    words = np.ndarray(shape=(len(letters) - 7,), dtype="<u8", buffer=letters.data, strides=(1,))
    if gram == 8:
        h = words[: len(data) - 7] * np.uint64(BASE)
    else:
        h, span = letters[: len(data)].astype(np.uint64) + np.uint64(1), 1
        # hashes of ever longer grams, put together of two shorter ones
        while span < gram:
            step = min(span, gram - span)
            h = h[: len(h) - step] * np.uint64(pow(BASE, step, 1 << 64)) + h[step:]
            span += step
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h >>= np.uint64(32)
    h = h.astype(np.uint32)
    width, front = s.length - gram + 1, s.length - around + 1
    early = _least(h, front)
    least = _least(early, width, front)
    early = early[:n] == least  # the bytes from the gram on fit
    ends = np.cumsum(sizes)
    starts, lasts = ends - sizes, ends - s.length + 1  # of a text's strings; the last one is before the latter
    texts = np.flatnonzero(lasts > starts)
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[1:] |= early[1:] != early[:-1]
    fresh[1:] |= h[: n - 1] == least[1:]  # the gram was the first one before, so that an equal one follows
    fresh[starts[texts]] = True
    cuts = np.flatnonzero(fresh)
    text = texts[np.maximum(np.searchsorted(starts[texts], cuts, "right") - 1, 0)] if len(texts) else np.zeros(len(cuts), np.int64)
    # strings across the end of a text are none
    count = np.minimum(np.append(cuts[1:], n), lasts[text]) - cuts
    inside = (cuts >= starts[text]) & (count > 0)
    if half is not None:
        inside &= least[cuts] % HALVES == half
    cuts, text, count = cuts[inside], text[inside], count[inside]
    at = np.lib.stride_tricks.sliding_window_view(h, width)[cuts].argmin(axis=1)
    at += cuts + np.where(early[cuts], 0, gram - around)
    key = np.full(len(at), around, dtype=np.uint64)
    for k in [*range(0, around - 7, 8), around - 8] if around >= 8 else [0]:
        word = words[at + k] if around >= 8 else words[at] & np.uint64((1 << 8 * around) - 1)
        key = WordHashes.mixed((key ^ word) * np.uint64(BASE))
    # runs of one key are one
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cuts[1:] != cuts[:-1] + count[:-1]) | (text[1:] != text[:-1])
    if not fresh.all():
        runs = np.flatnonzero(fresh)
        cuts, text, count, key = cuts[runs], text[runs], np.add.reduceat(count, runs), key[runs]
    return text, cuts - starts[text], count, key.view(np.int64)


def anchors(data: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one text's strings with one key: (first string's place, number of strings, key)."""
    return anchors_of(data, np.array([len(data)]), s)[1:]


def _together(batches, columns: list[str]):
    """Texts of batches, joined some at a time: (bytes, sizes, the columns' values)."""
    for b in batches:
        texts, others = b["data"], [b[c].to_numpy() for c in columns]
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            room = TOGETHER + (int(ends[at - 1]) if at else 0)
            end = max(at + 1, int(np.searchsorted(ends, room, "right")))
            part = texts.slice(at, end - at).to_pylist()
            yield b"".join(part), np.array([len(x) for x in part], dtype=np.int64), [x[at:end] for x in others]
            at = end


def _batches(pieces, schema: pa.Schema, most: int):
    """Record batches of lists of columns, joined to larger ones."""
    held, n = [], 0
    for columns in pieces:
        held.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        n += held[-1].num_rows
        if n >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# ---- many values in one row -------------------------------------------------------------------------------------


STRETCH = {"key": np.int64, "name": np.int64, "doc": np.int64, "hash": np.int64, "first": np.int32, "size": np.int32}
SPAN = {"doc": np.int64, "hash": np.int64, "start": np.int32, "end": np.int32}


def _ddl(kinds: dict) -> str:
    return "part int, " + ", ".join(f"`{name}` binary" for name in kinds)


def dealt(kinds: dict, values: list[np.ndarray], part: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each part that has any values: its number, and of each column the bytes of its values, in their order."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    counts = np.bincount(part, minlength=parts)
    held = np.flatnonzero(counts)
    ends = np.concatenate([[0], np.cumsum(counts[held])])
    out = [pa.array(held.astype(np.int32))]
    for kind, x in zip(kinds.values(), values):
        x = x.astype(kind, copy=False)[order]
        out.append(pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]))
    return pa.RecordBatch.from_arrays(out, names=["part", *kinds])


def gathered(table: pa.Table | pa.RecordBatch, kinds: dict) -> list[np.ndarray]:
    """The values of all rows, column by column."""
    return [np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind) for name, kind in kinds.items()]


def _span_part(doc: np.ndarray, mark: np.ndarray, parts: int) -> np.ndarray:
    return (WordHashes.mixed(doc.view(np.uint64) * np.uint64(BASE) ^ mark.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _same_run(*columns: np.ndarray) -> np.ndarray:
    """Whether a row begins a run of equal ones."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return fresh


def compared(key, name, doc, mark, first, size) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of stretches, all that there are of their keys: (spans that are repeated, stretches to be judged by their bytes).

    Keys that texts of one hash alone hold are left out. Where a key has one stretch, all strings of it are those of the least
    document. The others come with a mark at one of equal ones, that of the least document.
    """
    order = np.argsort(key)
    fresh = _same_run(key[order])
    order = order[~(fresh & np.append(fresh[1:], True))]  # most keys come once
    key, name, doc, mark, first, size = (x[order] for x in (key, name, doc, mark, first, size))
    fresh = _same_run(key)
    at = np.flatnonzero(fresh)
    if not len(at):
        return [x[:0] for x in (doc, mark, first, first)], [x[:0] for x in (key, name, doc, mark, first, size, fresh)]
    of = np.cumsum(fresh) - 1
    shared = np.minimum.reduceat(mark, at) != np.maximum.reduceat(mark, at)
    alike = np.minimum.reduceat(name, at) == np.maximum.reduceat(name, at)
    one = np.flatnonzero((shared & alike)[of] & (doc > np.minimum.reduceat(doc, at)[of]))
    several = np.flatnonzero((shared & ~alike)[of])
    several = several[np.lexsort((first[several], mark[several], doc[several], name[several], key[several]))]
    held = [x[several] for x in (key, name, doc, mark, first, size)]
    return [doc[one], mark[one], first[one], first[one] + size[one]], [*held, _same_run(held[0], held[1])]


def judged(key, name, least, stretches: list[bytes], other_key, other_name, doc, mark, first, s: Settings) -> list[np.ndarray]:
    """(doc, hash, start, end) of strings that a smaller document holds: of different stretches, each with its least document, and all their occurrences."""
    # numbers for stretches: rows of both sides in the order of their names
    keys, names = np.concatenate([key, other_key]), np.concatenate([name, other_name])
    order = np.lexsort((names, keys))
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(_same_run(keys[order], names[order])) - 1
    number, other = number[: len(key)], number[len(key) :]
    single = np.sort(np.unique(number, return_index=True)[1])  # a row that is there twice brings its stretches twice
    number, least = number[single], least[single]
    owner, place, group = equal_windows([stretches[i] for i in single.tolist()], s.length, s.queue_bytes)
    if not len(owner):
        return [doc[:0], mark[:0], first[:0], first[:0]]
    lowest = np.minimum.reduceat(least[owner], np.flatnonzero(np.diff(group, prepend=-1)))
    # back in the order of stretches; runs of strings with the same least document
    back = np.lexsort((place, owner))
    owner, place, low = owner[back], place[back], lowest[group[back]]
    at = np.flatnonzero(_same_run(owner, low))
    count = np.diff(np.append(at, len(owner)))
    owner, skip, low = owner[at], place[at], low[at]
    # runs of each occurrence
    runs_from = np.full(len(keys), 0, dtype=np.int64)
    runs_of = np.zeros(len(keys), dtype=np.int64)
    begin = np.flatnonzero(_same_run(owner))
    runs_from[number[owner[begin]]] = begin
    runs_of[number[owner[begin]]] = np.diff(np.append(begin, len(owner)))
    n = runs_of[other]
    row = np.repeat(np.arange(len(other)), n)
    run = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + runs_from[other][row]
    gone = low[run] < doc[row]
    row, run = row[gone], run[gone]
    start = first[row] + skip[run]
    return [doc[row], mark[row], start, start + count[run] + s.length - 1]


def merged(doc, mark, start, end) -> pa.Table:
    """Spans of each text, put together where they touch."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order].astype(np.int64), end[order].astype(np.int64)
    own = _same_run(doc, mark)
    far = (np.cumsum(own) - 1) << np.int64(32)  # so that no text's span reaches the next one's
    reach = np.maximum.accumulate(end + far)
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (start + far)[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    texts = np.flatnonzero(own)
    spans = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array((reach - far)[np.append(at[1:], len(doc)) - 1].astype(np.int32))], names=["start", "end"])
    offsets = np.append(np.searchsorted(at, texts), len(at)).astype(np.int32)
    return pa.table({"doc_id": doc[texts], "text_hash": mark[texts], "spans": pa.ListArray.from_arrays(pa.array(offsets), spans)})


def repeated(df: DataFrame, text: str = "text", doc_id: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """(doc_id, text_hash, spans): for texts with any, the byte ranges [start, end) covered by strings that also start in a smaller document.

    ``spans`` is array<struct<start:int,end:int>>, disjoint, ascending, maximal.
    """
    steps = Steps(df.sparkSession, "suffix-dedup")
    docs = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).cast("binary").alias("data"))
    # of equal texts all but the least document lose all their strings
    names = docs.select("doc", "hash", F.xxhash64(F.lit(1), "data").alias("hash2"), F.octet_length("data").alias("size"))
    reps = steps.written(names.groupBy("hash", "hash2").agg(F.min("doc").alias("doc"), F.sum(F.col("size").cast("long")).alias("bytes")), "first-copies")
    copies = names.where(F.col("size") >= s.length).join(reps.drop("bytes"), ["doc", "hash", "hash2"], "left_anti").select("doc", "hash", F.lit(0).alias("start"), F.col("size").alias("end"))
    parts = 1 + (reps.agg(F.sum("bytes")).first()[0] or 0) // PART_BYTES
    span_parts = 1 + parts // 2

    def placed(batches, half):
        """Texts' stretches at anchors of one half, dealt out by their keys."""
        cache = worker_cache("suffix_dedup")
        if "byte-hashes" not in cache:
            cache["byte-hashes"] = WordHashes()
        hashes, held, n = cache["byte-hashes"], [], 0

        def packed():
            values = [np.concatenate(x) for x in zip(*held)]
            return dealt(STRETCH, values, (values[0].view(np.uint64) % np.uint64(parts)).astype(np.int64), parts)

        for data, sizes, (ids, marks) in _together(batches, ["doc", "hash"]):
            found, first, count, key = anchors_of(data, sizes, s, half)
            size, at = count + s.length - 1, first + (np.cumsum(sizes) - sizes)[found]
            held.append((key, hashes.of_spans(data, at, at + size).view(np.int64), ids[found], marks[found], first.astype(np.int32), size.astype(np.int32)))
            n += len(key)
            if n >= DEALT:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    apart = {**STRETCH, "lead": np.bool_}

    def told(table: pa.Table) -> pa.Table:
        """Spans, dealt out by their texts, and in a part -1 the stretches to be judged, with the bytes of different ones."""
        (doc, mark, start, end), several = compared(*gathered(table, STRETCH))
        spans = dealt(SPAN, [doc, mark, start, end], _span_part(doc, mark, span_parts), span_parts)
        rest = dealt(apart, several, np.zeros(len(several[0]), np.int64), 1)
        rows = spans.num_rows, rest.num_rows
        columns = {"part": pa.array([*spans["part"].to_pylist(), *[-1] * rows[1]], pa.int32()), "volume": pa.array([0] * rows[0] + [int(several[5][several[6]].sum())] * rows[1], pa.int64())}
        for name in SPAN | apart:
            columns[name] = pa.chunked_array([batch[name] if name in batch.schema.names else pa.nulls(k, pa.binary()) for batch, k in zip((spans, rest), rows)])
        return pa.table(columns)

    # half of the anchors at a time, so that only their stretches are on disk
    out = f"{_ddl(SPAN | apart)}, volume long"
    columns = ["part", "volume", *(SPAN | apart)]
    halves = []
    for half in range(HALVES):
        stretches = docs.mapInArrow(partial(placed, half=half), _ddl(STRETCH))
        halves.append(steps.written(stretches.groupBy("part").applyInArrow(told, out).select(*columns), f"compared-{half}"))
    found = reduce(DataFrame.unionByName, halves)
    apart_rows = found.where("part < 0")
    shards = max(1, -(-(apart_rows.agg(F.sum("volume")).first()[0] or 0) // s.shard_bytes))

    def unpacked(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in gathered(b, apart)], names=list(apart))

    several = apart_rows.select(*apart).mapInArrow(unpacked, "key long, name long, doc long, hash long, first int, size int, lead boolean")
    wanted = several.where("lead").groupBy("doc", "hash").agg(F.collect_list(F.struct("first", "size", "key", "name")).alias("wanted"))

    def fetched(batches):
        schema = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("least", pa.int64()), ("stretch", pa.binary())])

        def pieces():
            for b in batches:
                texts, places = b["data"].to_pylist(), b["wanted"].flatten()
                first, size = (places.field(x).to_numpy() for x in ("first", "size"))
                n = pc.list_value_length(b["wanted"]).to_numpy()
                of = np.repeat(np.arange(len(texts)), n).tolist()
                cut = [texts[i][f:e] for i, f, e in zip(of, first.tolist(), (first + size).tolist())]
                yield [places.field("key"), places.field("name"), pa.array(np.repeat(b["doc"].to_numpy(), n)), pa.array(cut, pa.binary())]

        yield from _batches(pieces(), schema, 50_000)

    # rows that repeat id and text are one document
    texts = docs.join(wanted.hint("shuffle_hash"), ["doc", "hash"]).mapInArrow(fetched, "key long, name long, least long, stretch binary")

    def sorted_out(left: pa.Table, right: pa.Table) -> pa.Table:
        key, name, least = (left[x].to_numpy() for x in ("key", "name", "least"))
        spans = judged(key, name, least, left["stretch"].to_pylist(), *(right[x].to_numpy() for x in ("key", "name", "doc", "hash", "first")), s)
        return pa.Table.from_batches([dealt(SPAN, spans, _span_part(*spans[:2], span_parts), span_parts)])

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    occurrences = several.select(shard, "key", "name", "doc", "hash", "first")
    by_bytes = texts.select(shard, "*").groupBy("shard").cogroup(occurrences.groupBy("shard")).applyInArrow(sorted_out, _ddl(SPAN))
    by_bytes = steps.written(by_bytes, "judged")

    def whole(batches):
        for b in batches:
            doc, mark, start, end = (b[x].to_numpy() for x in SPAN)
            yield dealt(SPAN, [doc, mark, start, end], _span_part(doc, mark, span_parts), span_parts)

    spans = found.where("part >= 0").select("part", *SPAN).unionByName(by_bytes).unionByName(copies.mapInArrow(whole, _ddl(SPAN)))
    spans = spans.groupBy("part").applyInArrow(lambda table: merged(*gathered(table, SPAN)), "doc_id long, text_hash long, spans array<struct<start:int,end:int>>")
    result = steps.written(spans, "repeated-spans")
    steps.drop("first-copies", *(f"compared-{half}" for half in range(HALVES)), "judged")
    return result


def without_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """Adds repeated_spans (byte ranges) and kept (the other bytes, binary) to every row.

    Null and empty texts and texts under ``length`` bytes have no spans; a null text keeps no bytes. Rows that repeat an id
    count as one document for comparison, so they don't repeat each other, but each loses bytes by its own text.
    A row without an id is compared with nothing. Columns of these names are replaced.
    """
    doc, mark, own = (free_name(df, x) for x in ("_doc", "_text_hash", "_spans"))
    found = repeated(df, text, doc_id, s).toDF(doc, mark, own)
    joined = df.join(found.hint("shuffle_hash"), (F.col(doc_id).cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(mark)), "left").drop(doc, mark)

    @F.arrow_udf("binary")
    def rest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out, flat = [], spans.flatten()
        gone = zip(flat.field("start").to_pylist(), flat.field("end").to_pylist())
        for t, n in zip(texts.to_pylist(), pc.fill_null(pc.list_value_length(spans), 0).to_pylist()):
            data, at, parts = t or b"", 0, []
            for start, end in islice(gone, n):
                parts.append(data[at:start])
                at = end
            out.append(b"".join([*parts, data[at:]]) if n else data)
        return pa.array(out, pa.binary())

    spans = F.coalesce(own, F.array().cast("array<struct<start:int,end:int>>"))
    return joined.withColumns({"repeated_spans": spans, "kept": rest(F.col(text).cast("binary"), F.col(own))}).drop(own)
