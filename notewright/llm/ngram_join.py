"""Similarity self-join of word-shingle sets by token-combination prefixes.

Sets x and y with Jaccard similarity of at least t share at least t times the larger one's size. In any order of
tokens that holds for all sets, the first k shared tokens of such a pair lie in the first ``n - ceil(t n) + k``
tokens of either, its extended prefix.

1. Equal sets are one class; only one of them goes on.
2. In the order of hashes, sets that share fewer than k tokens of their prefix with others (k a tenth of the size) have
   no partner.
3. Of the sets that are left, tokens are counted. Tokens that one set alone holds can't be shared, so a set with too
   few others drops out. The rest are ordered from rare to frequent.
4. Rare tokens of the extended prefix are signatures by themselves. Frequent ones are dealt into k - 1 buckets; of k
   shared frequent tokens two fall into one bucket, so pairs within buckets are signatures. k grows with the size, so
   that their number stays in proportion to the prefix.
5. Sets with a common signature form clusters. Clusters are cut into blocks of bounded size, and pairs of blocks are
   verified exactly in one task each, which puts out no pairs but a spanning forest. In clusters of many blocks, all
   blocks are compared with the first one; then only what is not in the cluster's largest component so far is
   compared with all blocks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import worker_cache, written
from notewright.llm.graph import components

LOWERED = bytes(range(256)).lower()  # A to Z alone
PIECE = 1 << 17  # bytes whose words are hashed at a time
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Settings:
    words: int = 5  # of a shingle
    percent: int = 80  # least Jaccard similarity
    first_share: float = 0.1  # of a set's size: k of the prefixes in the order of hashes
    frequent: int = 256  # tokens that more sets hold are indexed in pairs
    per_bucket: int = 32  # least overlap for each further bucket of frequent tokens
    block_tokens: int = 1_500_000  # of a block
    block_sets: int = 4000

    @property
    def least(self) -> int:
        """Size below which a set has no partner but equals."""
        return math.ceil(self.percent / (100 - self.percent)) if self.percent < 100 else 1 << 30


class WordHashes:
    """Hashes of a text's words, all at once: sums of byte values times powers of an odd number, modulo 2 to the 64."""

    base = 0x9E3779B97F4A7C15

    def __init__(self):
        with np.errstate(over="ignore"):
            self.values = self.mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
        self.powers = self.inverses = np.empty(0, np.uint64)
        self._extend(PIECE)

    def _extend(self, n: int) -> None:
        for name, factor in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
            f = np.full(n, factor, dtype=np.uint64)
            f[0] = 1
            setattr(self, name, np.multiply.accumulate(f))

    @staticmethod
    def mixed(x: np.ndarray) -> np.ndarray:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))

    def of_piece(self, data: bytes) -> np.ndarray:
        b = np.frombuffer(data, dtype=np.uint8)
        if len(b) > len(self.powers):  # a word longer than a piece
            self._extend(len(b))
        blank = BLANK[b]
        edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(self.values[b] * self.powers[: len(b)], out=sums[1:])
        return self.mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def of_spans(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [start, end) of a text."""
        b = np.frombuffer(data, dtype=np.uint8)
        if len(b) > len(self.powers):
            self._extend(len(b))
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(self.values[b] * self.powers[: len(b)], out=sums[1:])
        return self.mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def of_text(self, data: bytes) -> np.ndarray:
        if len(data) <= PIECE:
            return self.of_piece(data)
        parts, at = [], 0
        while at < len(data):
            end = _NEXT_BLANK.search(data, min(at + PIECE, len(data)))
            end = end.start() if end else len(data)
            parts.append(self.of_piece(data[at:end]))
            at = end
        return np.concatenate(parts)


def shingle_hashes(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes (64 bits) of a text's shingles; few words make one shingle, none make none."""
    h = hashes.of_text((text or "").encode("utf-8").translate(LOWERED))
    if not len(h):
        return np.empty(0, dtype=np.int64)
    n = min(words, len(h))
    mixed = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    out = hashes.mixed(mixed).view(np.int64)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def shingles(df: DataFrame, text: Column, s: Settings) -> DataFrame:
    """Adds _tokens: the sorted distinct hashes of the shingles of a text."""
    words = s.words

    @F.arrow_udf("array<long>")
    def hashes(texts: pa.Array) -> pa.Array:
        cache = worker_cache("ngram_join")
        if "word-hashes" not in cache:
            cache["word-hashes"] = WordHashes()
        parts = [shingle_hashes(t.as_py(), words, cache["word-hashes"]) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))

    return df.withColumn("_tokens", hashes(text))


def needed(n: Column, s: Settings) -> Column:
    """Least overlap of a set of n tokens with any partner."""
    return F.floor((n * s.percent + 99) / 100).cast("int")


def first_shared(n: Column, s: Settings) -> Column:
    """k of the prefixes in the order of hashes, for a set of n tokens."""
    return F.greatest(F.lit(1), F.floor(n * s.first_share)).cast("int")


def link_block(ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's sets; tokens of set i are tokens[offsets[i]:offsets[i + 1]]."""
    n = len(ids)
    _, local = np.unique(tokens, return_inverse=True)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    by_token = np.argsort(local, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(local))])
    holders = owner[by_token]  # of each token, ascending
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(n):
        mine = local[offsets[i] : offsets[i + 1]]
        lists = [holders[starts[t] : starts[t + 1]] for t in mine[starts[mine + 1] - starts[mine] > 1]]
        if not lists:
            continue
        shared = np.bincount(np.concatenate(lists), minlength=n)
        shared[: i + 1] = 0
        hits = np.flatnonzero(100 * shared >= percent * (sizes[i] + sizes - shared))
        for j in hits.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def _verified(units: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) found within each unit of (unit, id, n, tokens) rows."""

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        lists = table["tokens"].combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        edges = link_block(table["id"].to_numpy(), table["n"].to_numpy().astype(np.int64), lists.flatten().to_numpy(), offsets, percent)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return units.groupBy("unit").applyInArrow(link, "a long, b long")


def _signatures(ordered: DataFrame, s: Settings) -> DataFrame:
    """(id, signature) of sets (id, n, shared: array<struct<df, token>> from rare to frequent)."""
    base = 100 / s.percent
    rows = ordered.withColumn("_o", needed(F.col("n"), s)).withColumn("_class", F.floor(F.log(F.col("n").cast("double")) / math.log(base)).cast("int"))
    # partners' sizes differ by the factor `base` at most, so the larger one's class is this class or the next
    rows = rows.withColumn("_schema", F.explode(F.array(F.col("_class"), F.col("_class") + 1)))
    smallest = F.ceil(F.pow(F.lit(base), F.col("_schema").cast("double")) - 1e-6).cast("int")
    rows = rows.withColumn("_buckets", (F.lit(1) + F.floor(needed(smallest, s) / s.per_bucket)).cast("int"))
    first = F.size("shared") - F.col("_o") + 1
    rows = rows.withColumn("_prefix", F.slice("shared", 1, F.least(F.size("shared"), first + F.col("_buckets"))))
    rows = rows.withColumn("_often", F.exists(F.slice("_prefix", 1, first), lambda x: x["df"] > s.frequent))
    rare = F.transform(F.filter(F.when(F.col("_often"), F.col("_prefix")).otherwise(F.slice("_prefix", 1, first)), lambda x: x["df"] <= s.frequent), lambda x: x["token"])
    often = F.transform(F.filter("_prefix", lambda x: x["df"] > s.frequent), lambda x: F.struct(F.pmod(F.xxhash64(x["token"]), F.col("_buckets")).alias("k"), x["token"].alias("t")))
    rows = rows.withColumn("_frequent", F.when(F.col("_often"), F.sort_array(often)).otherwise(F.array().cast("array<struct<k:bigint,t:bigint>>")))
    # pairs of a bucket: each token with those after it, up to the bucket's end
    pairs = F.flatten(F.transform("_frequent", lambda x, i: F.transform(
        F.filter(F.slice("_frequent", i + 2, F.size("_frequent")), lambda y: y["k"] == x["k"]), lambda y: F.xxhash64(x["t"], y["t"], F.col("_schema")))))
    singles = rows.where("_schema = _class").select("id", F.explode(rare).alias("signature"))
    return singles.unionByName(rows.where(F.size("_frequent") > 1).select("id", F.explode(pairs).alias("signature"))).distinct()


def similar(df: DataFrame, text: str = "text", doc_id: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    component_id is the smallest id of the rows that links reach. A null text is empty; a set without shingles is
    linked with nothing and is its own component. Rows that repeat an id are rows of their own; a null id never gives
    its name to a component. Other columns are not read; an empty table gives an empty result.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    tokens = shingles(rows, F.col("text"), s)
    print_ = F.when(F.size("_tokens") > 0, F.struct(F.xxhash64("_tokens").alias("p"), F.xxhash64(F.lit(1), "_tokens").alias("q")))
    tokens = tokens.select("id", F.size("_tokens").alias("n"), print_.alias("set"), "_tokens")
    # texts are hashed once; prefixes are exploded from what was written, without Python workers beside it
    prefix = F.when(F.col("n") >= s.least, F.slice("_tokens", 1, F.col("n") - needed(F.col("n"), s) + first_shared(F.col("n"), s)))
    sets = written(tokens.select("id", "n", "set", prefix.alias("prefix")), "shingle-sets")
    classes = sets.where("set is not null").groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    links = components(_links(rows, sets, classes, s)).withColumnRenamed("component", "_least")
    known = classes.join(links, F.col("rep") == F.col("node"), "left").select(F.col("set").alias("_set"), F.coalesce("_least", "rep").alias("_component"))
    out = sets.join(known, F.col("set") == F.col("_set"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("_component")).alias("component_id"))


def _links(rows: DataFrame, sets: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Edges between classes' representatives whose sets are similar: enough of them to connect what links connect."""
    # 2. prefixes in the order of hashes, extended so that partners share k of their tokens
    k = first_shared(F.col("n"), s)
    prefix = sets.where(F.col("n") >= s.least).select(F.col("set.p").alias("p"), F.explode("prefix").alias("token"))
    shared = prefix.groupBy("token").agg(F.min("p").alias("_low"), F.max("p").alias("_high")).where("_low <> _high").select("token")
    alive = prefix.join(shared, "token", "left_semi").groupBy("p").agg(F.count(F.lit(1)).alias("_shared"))
    # each copy of a set brought its tokens once
    reps = classes.join(alive, F.col("set.p") == F.col("p")).where(F.col("_shared") >= k * F.col("copies"))
    reps = written(reps.select("rep", "n", "set"), "shingle-candidates")
    # 3. all tokens of the candidates
    texts = rows.join(reps.select(F.col("rep").alias("id"), "set").hint("merge"), "id")  # the same plan at any size
    # compared only after it was written: as a condition of the join it would move tokens in the place of texts
    full = written(shingles(texts, F.col("text"), s).select("id", "set", F.size("_tokens").alias("n"), "_tokens"), "shingle-tokens")
    full = full.where((F.xxhash64("_tokens") == F.col("set.p")) & (F.xxhash64(F.lit(1), "_tokens") == F.col("set.q")))
    # rows that repeat id and text count twice in df, which only prunes less; collect_set takes them together
    each = full.select("id", "n", F.explode("_tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = each.join(counts, "token").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("df", "token"))).alias("shared"))
    ordered = written(kept.where(F.size("shared") >= needed(F.col("n"), s)), "shingle-order")
    # 4. signatures, and clusters of what they connect
    signatures = written(_signatures(ordered, s), "signatures")
    first = signatures.groupBy("signature").agg(F.min("id").alias("a"), F.max("id").alias("_b")).where("a <> _b")
    stars = signatures.join(first, "signature").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    clusters = components(stars)
    members = ordered.select("id", "n", F.transform("shared", lambda x: x["token"]).alias("tokens")).join(
        clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    volume = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.sum(F.size("tokens")) / s.block_tokens), F.ceil(F.count(F.lit(1)) / s.block_sets)).cast("int").alias("blocks"))
    members = written(members.join(volume, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "cluster-members")
    # 5. every block with the cluster's first one
    unit = lambda *c: F.struct("cluster", *c).alias("unit")
    everywhere = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    near = members.withColumn("_j", F.explode(everywhere)).select(unit(F.col("_j").alias("j")), "id", "n", "tokens")
    found = written(_verified(near, s.percent), "links")
    # then what stays outside the largest component of a cluster of several blocks with all its blocks
    large = members.where("blocks > 1")
    parts = components(found)
    placed = large.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    placed = written(placed, "cluster-parts")
    main = placed.groupBy("cluster", "part").count().groupBy("cluster").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    marked = placed.join(main, "cluster").withColumn("rest", F.col("part") != F.col("main"))
    rest = marked.where("rest").groupBy("cluster").agg(F.greatest(
        F.ceil(F.sum(F.size("tokens")) / s.block_tokens), F.ceil(F.count(F.lit(1)) / s.block_sets)).cast("int").alias("_rest"))
    marked = marked.join(rest, "cluster")
    mine = marked.where("rest").withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_rest")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = marked.withColumn("_j", F.col("block")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_rest") - 1)))
    # a set that comes to a unit from both sides counts once
    far = mine.unionByName(other, allowMissingColumns=True).select(unit(F.col("_i").alias("i"), F.col("_j").alias("j")), "id", "n", "tokens").dropDuplicates(["unit", "id"])
    return found.unionByName(_verified(far, s.percent))
