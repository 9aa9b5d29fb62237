"""Hard negatives by exact integer scores: residue-number-system products, then windowed selection.

Components are scaled to integers. A block of anchors is multiplied with blocks of rows modulo several primes below 1024,
in float32: residues lie within +-510, so sums of 64 products stay below 2 to the 24 and are exact. Chinese remaindering
in mixed radix puts the signed score together from its residues; as many primes are taken as the largest possible score
asks for, which the largest component and the longest vector give.

Rows are dealt into blocks by their ids and anchors into groups; each pair of group and block is a cell, whose task reads
the anchors first and streams the rows past them, keeping a short list per anchor. The number of blocks grows with the
square root of the rows, so that neither the lists of a cell nor the lists that meet at an anchor grow with the table.
Positives come first; the negatives' windows follow from their scores, and a second pass fills these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from notewright.llm.common import written


@dataclass(frozen=True)
class Settings:
    anchors_every: int = 50  # anchors are the rows whose id this divides
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low_percent: int = 50  # of the positive's score, which the negative's lies between
    high_percent: int = 95
    group: int = 8192  # anchors of a cell
    block_factor: int = 256  # rows of a block: the square root of this times all rows
    tile_anchors: int = 512
    tile_rows: int = 4096


CHUNK = 64  # products added up in float32
LEAST = np.iinfo(np.int64).min
PAIRS = "anchor_id long, label long, dim int, slot int, id long, score long"


def primes(bound: int) -> list[int]:
    """The largest primes below 1024, descending, as many as make a product above twice the bound."""
    out, product = [], 1
    for p in range(1023, 1, -1):
        if product > 2 * bound + 1:
            break
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
    return out


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """Of whole numbers, the residues nearest to zero, as float32."""
    r = m % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def products(left: list[np.ndarray], right: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact scores (int64) of all rows of ``left`` with all of ``right``, given as residues for each prime."""
    digits: list[np.ndarray] = []
    for k, (a, b, p) in enumerate(zip(left, right, moduli)):
        r = np.zeros((a.shape[0], b.shape[0]), dtype=np.int64)
        for at in range(0, a.shape[1], CHUNK):
            r += (a[:, at : at + CHUNK] @ b[:, at : at + CHUNK].T).astype(np.int64)
        # mixed radix: what is left of the residue after the digits so far, divided by the primes so far
        for d, q in zip(digits, moduli[:k]):
            r = (r - d) % p * pow(q, -1, p)
        digits.append(r % p)
    # the upper half of the range stands for negative scores: digits at or above those of its middle, from the highest down
    whole, middle = math.prod(moduli), []
    rest = (whole + 1) // 2
    for p in moduli:
        rest, d = divmod(rest, p)
        middle.append(d)
    negative = np.ones(digits[0].shape, dtype=bool)
    for d, m in zip(digits, middle):
        negative = (d > m) | ((d == m) & negative)
    value, radix = np.zeros(digits[0].shape, dtype=np.uint64), 1
    for d, p in zip(digits, moduli):  # modulo 2 to the 64; the score itself fits
        value += d.astype(np.uint64) * np.uint64(radix % (1 << 64))
        radix *= p
    value -= np.where(negative, np.uint64(whole % (1 << 64)), np.uint64(0))
    return value.view(np.int64)


def take_best(scores: np.ndarray, ids: np.ndarray, best: np.ndarray, best_ids: np.ndarray) -> None:
    """Brings lists of the highest scores up to date, in place. ``ids`` ascend and are above those in the lists.

    ``scores`` is used up; LEAST marks what is no candidate.
    """
    k, at = best.shape[1], np.arange(len(scores))
    found, found_ids = np.empty_like(best), np.empty_like(best_ids)
    for j in range(k):
        top = scores.argmax(axis=1)  # of equal scores the first, which has the smallest id
        found[:, j], found_ids[:, j] = scores[at, top], ids[top]
        scores[at, top] = LEAST
    both, both_ids = np.concatenate([best, found], axis=1), np.concatenate([best_ids, found_ids], axis=1)
    # ascending ids of equal scores stand in order already, and a stable sort leaves them so; -1 - x never overflows
    order = np.argsort(-1 - both, axis=1, kind="stable")[:, :k]
    best[:], best_ids[:] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


class Cell:
    """The anchors of one group, and the best of the rows seen so far for each of them.

    Without windows (low, high) the best rows of an anchor's own label are kept; with them, those of other labels whose
    score lies in the window, for every line of ``wanted`` (anchor, slot, low, high).
    """

    def __init__(self, anchors: pa.Table, dim: int, moduli: list[int], s: Settings, wanted: bool):
        order = np.argsort(anchors["id"].to_numpy(), kind="stable")
        anchors = anchors.take(pa.array(order))
        self.ids, self.labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        m = _matrix(anchors["v"], dim)
        self.left, self.moduli, self.s, self.dim = [residues(m, p) for p in moduli], moduli, s, dim
        self.slots = s.positives if wanted else 1
        k = s.negatives if wanted else s.positives
        self.windows = None
        if wanted:
            # slots without a positive have an empty window
            low = np.full((len(self.ids), self.slots), 1, np.int64)
            high = np.zeros_like(low)
            for i, (lows, highs) in enumerate(zip(anchors["low"].to_pylist(), anchors["high"].to_pylist())):
                low[i, : len(lows)], high[i, : len(highs)] = lows, highs
            self.windows = low, high
        self.best = np.full((self.slots, len(self.ids), k), LEAST, np.int64)
        self.best_ids = np.zeros((self.slots, len(self.ids), k), np.int64)

    def see(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        """Rows in ascending order of ids, none seen before."""
        right = [residues(m, p) for p in self.moduli]
        for at in range(0, len(self.ids), self.s.tile_anchors):
            tile = slice(at, at + self.s.tile_anchors)
            if self.windows is None:
                self._see_own(tile, ids, labels, right)
                continue
            scores = products([a[tile] for a in self.left], right, self.moduli)
            other = self.labels[tile][:, None] != labels[None, :]
            for j in range(self.slots):
                low, high = (w[tile, j][:, None] for w in self.windows)
                fits = other & (scores >= low) & (scores <= high)
                some = np.flatnonzero(fits.any(axis=1))
                if len(some):
                    best, best_ids = self.best[j][tile][some], self.best_ids[j][tile][some]
                    take_best(np.where(fits[some], scores[some], LEAST), ids, best, best_ids)
                    self.best[j][at + some], self.best_ids[j][at + some] = best, best_ids

    def _see_own(self, tile: slice, ids: np.ndarray, labels: np.ndarray, right: list[np.ndarray]) -> None:
        for label in np.intersect1d(self.labels[tile], labels):
            mine, rows = np.flatnonzero(self.labels[tile] == label) + tile.start, np.flatnonzero(labels == label)
            scores = products([a[mine] for a in self.left], [b[rows] for b in right], self.moduli)
            scores[self.ids[mine][:, None] == ids[rows][None, :]] = LEAST
            best, best_ids = self.best[0][mine], self.best_ids[0][mine]
            take_best(scores, ids[rows], best, best_ids)
            self.best[0][mine], self.best_ids[0][mine] = best, best_ids

    def lists(self) -> pa.RecordBatch:
        slot, anchor, rank = np.nonzero(self.best > LEAST)
        columns = [self.ids[anchor], self.labels[anchor], np.full(len(anchor), self.dim, np.int32), slot.astype(np.int32),
                   self.best_ids[slot, anchor, rank], self.best[slot, anchor, rank]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "label", "dim", "slot", "id", "score"])


def _cells(batches: Iterator[pa.RecordBatch], moduli: list[int], s: Settings, wanted: bool) -> Iterator[pa.RecordBatch]:
    """Best lists of every cell of a partition, which is sorted by cell, anchors before rows, rows by id."""
    key, held, cell = None, [], None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("dim", "group", "block")], axis=1)
        kinds = batch["kind"].to_numpy()
        cuts = np.flatnonzero(np.any(np.diff(keys, axis=0) != 0, axis=1) | (np.diff(kinds) != 0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part, own, kind = batch.slice(start, end - start), tuple(keys[start].tolist()), kinds[start]
            if own != key:
                if cell is not None:
                    yield cell.lists()
                key, held, cell = own, [], None
            if kind == 0:
                held.append(part)
                continue
            if cell is None:
                if not held:  # no anchor of this length in the group
                    continue
                cell = Cell(pa.Table.from_batches(held), own[0], moduli, s, wanted)
            for at in range(0, part.num_rows, s.tile_rows):
                rows = part.slice(at, s.tile_rows)
                cell.see(rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"], own[0]))
    if cell is not None:
        yield cell.lists()


def usable(df: DataFrame, vec_id: str, embedding: str, label: Column, s: Settings) -> DataFrame:
    """(id, label, v, dim): rows that take part, with whole components; of rows that repeat an id the first by label, then vector."""
    v = F.col(embedding).cast("array<double>")
    scaled = F.transform(v, lambda x: F.lit(float(s.scale)) * x)
    good = F.coalesce(F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(2**62))), F.lit(False))
    # components that only the scale makes too large aren't passed over, but refused
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    whole = F.when(good, F.transform(scaled, lambda x: F.floor(x).cast("long"))).otherwise(F.raise_error(F.lit("components are too large for scores of 64 bits")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, whole).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    first = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return first.select("id", F.col("r.label").alias("label"), F.col("r.v").alias("v"), F.size("r.v").alias("dim"))


def _searched(anchors: DataFrame, rows: DataFrame, moduli: list[int], groups: int, blocks: int, s: Settings, wanted: bool) -> DataFrame:
    """Best lists of all cells."""
    none = F.lit(None).cast("array<long>")
    windows = (F.col("low"), F.col("high")) if wanted else (none.alias("low"), none.alias("high"))
    mine = anchors.select("dim", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                          F.lit(0).alias("kind"), "id", "label", "v", *windows)
    seen = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
                       F.lit(1).alias("kind"), "id", "label", "v", none.alias("low"), none.alias("high"))
    cells = mine.unionByName(seen).repartition(groups * blocks, "dim", "group", "block").sortWithinPartitions("dim", "group", "block", "kind", "id")

    def run(batches):
        return _cells(batches, moduli, s, wanted)

    return cells.mapInArrow(run, PAIRS)


def mine(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label", s: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    Scores are inner products of whole components ``floor(scale * x)``; higher ones come first, then smaller ids. An
    anchor's positives are its first other rows of the same label, their negatives the first rows of other labels within
    the window. Rows with a null id, label or vector, or a null or non-finite component take no part; of rows that repeat
    an id one counts, the first by label and vector; vectors of different lengths have no score with each other, empty ones
    have 0. Tables that are empty, or without anchors, give no rows. An error is raised if a score might not fit into 64 bits.
    """
    rows = written(usable(df, vec_id, embedding, F.col(label) if isinstance(label, str) else label, s), "scaled-vectors")
    is_anchor = F.pmod(F.col("id"), F.lit(s.anchors_every)) == 0
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    n, n_anchors, dim, largest = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max("dim"), F.max(size)).first()
    schema = T.StructType([T.StructField(f"{x}_id", T.LongType()) for x in ("anchor", "positive")] + [T.StructField("rank", T.IntegerType())]
                          + [T.StructField(x, T.LongType()) for x in ("negative_id", "positive_score", "negative_score")])
    if not n_anchors:
        return df.sparkSession.createDataFrame([], schema)
    bound = max(1, dim * largest * largest)
    if bound >= 2**63 - 1:
        raise ValueError("components are too large for scores of 64 bits")
    moduli = primes(bound)
    groups, blocks = -(-n_anchors // s.group), -(-n // math.isqrt(s.block_factor * n))
    anchors = rows.where(is_anchor)

    def first(found: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    positives = written(first(_searched(anchors, rows, moduli, groups, blocks, s, False), s.positives), "positives")
    # no product is taken of a score, which might not fit: p * percent / 100 by whole parts and rests
    hundreds = F.expr("score div 100 - if(score % 100 < 0, 1, 0)")
    low = hundreds * s.low_percent + F.expr(f"(pmod(score, 100) * {s.low_percent} + 99) div 100")
    high = hundreds * s.high_percent + F.expr(f"(pmod(score, 100) * {s.high_percent}) div 100")
    lists = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    asked = anchors.join(lists, anchors["id"] == lists["anchor_id"]).select("id", "label", "v", "dim", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    negatives = first(_searched(asked, rows, moduli, groups, blocks, s, True), s.negatives)
    of = positives.select("anchor_id", F.col("rank").alias("_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("anchor_id", (F.col("slot") + 1).alias("_rank"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(of, ["anchor_id", "_rank"]).select(*schema.names)
