"""Near-duplicate vectors by NN-descent.

Equal vectors are folded into one. Random projections deal the vectors into small buckets, whose members are compared
with each other: the first neighbour lists. Rounds of neighbours-of-neighbours joins refine them: around each vector
whose list changed, its neighbours and a bounded number of those that list it are compared. Pairs that reach the
threshold give components; every comparison puts out a spanning forest of those it saw, whether or not the lists had
room for them. A vector has one list within its component and one of vectors outside it, so that links between
components are looked for however many a component holds. Attempts with new projections follow until one joins no
more components and a bounded, random choice of vectors, compared with all, has its links within its components; if
they never do, an error is raised. Links are then counted within each component: its blocks are compared with each
other, or counted at once where their radii leave no doubt.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import written
from notewright.llm.graph import components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    neighbours: int = 8  # of a list
    tables: int = 4  # of random projections, added again in every further attempt
    bucket: int = 128  # vectors compared in one bucket
    rounds: int = 2  # of neighbours-of-neighbours joins in an attempt
    block: int = 1000  # vectors of a component's block
    audited: int = 200  # vectors compared with all
    recall: float = 0.98  # to be reached in the audit, over links and as the mean over vectors
    attempts: int = 3  # allowed at least; more where a pair at the threshold needs more tables to share a bucket


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision of equally long lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def best_pairs(ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the k closest others (of the allowed pairs) that are closer than its floor: (id, other, similarity)."""
    sims = x @ x.T
    sims[ids[:, None] == ids[None, :]] = -2
    if allowed is not None:
        sims[~allowed] = -2
    k = min(k, len(ids))
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    values = sims[rows, top.ravel()]
    keep = values > np.maximum(floor[rows], -1.5)
    return ids[rows[keep]], ids[top.ravel()[keep]], values[keep]


def forest(hits: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with this symmetric matrix."""
    left, out = hits.any(axis=1), []
    for root in np.flatnonzero(left).tolist():
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(hits[i] & left).tolist()
            left[new] = False
            out += [(i, j) for j in new]
            todo += new
    return out


PAIRS = "id long, other long, sim double, same boolean, edge boolean"


def _joined(groups: DataFrame, s: Settings) -> DataFrame:
    """Best pairs inside and outside of components, and edges, within each group of (g, id, v, component, inside, outside) rows."""

    def join(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        _, first = np.unique(ids, return_index=True)
        table, ids = table.take(pa.array(first)), ids[first]
        x, c = matrix(table["v"]), table["component"].to_numpy()
        same = c[:, None] == c[None, :]
        near = best_pairs(ids, x, table["inside"].to_numpy(), s.neighbours, same)
        far = best_pairs(ids, x, table["outside"].to_numpy(), s.neighbours, ~same)
        tree = np.array(forest((x @ x.T >= s.threshold) & ~same), dtype=np.int64).reshape(-1, 2)
        sizes = [len(near[0]), len(far[0]), len(tree)]
        return pa.table({
            "id": np.concatenate([near[0], far[0], ids[tree[:, 0]]]), "other": np.concatenate([near[1], far[1], ids[tree[:, 1]]]),
            "sim": np.concatenate([near[2], far[2], np.ones(len(tree))]),
            "same": np.repeat([True, False, False], sizes), "edge": np.repeat([False, False, True], sizes)})

    return groups.groupBy("g").applyInArrow(join, PAIRS)


def _bits(count: int, s: Settings) -> int:
    return max(1, min(30, math.ceil(math.log2(max(count, 2) / (s.bucket / 4)))))


def _attempts(count: int, s: Settings) -> int:
    """Attempts after which a pair at the threshold shared a bucket with the odds of the recall, by the tables alone."""
    shared = (1 - math.acos(s.threshold) / math.pi) ** _bits(count, s)
    return max(s.attempts, math.ceil(math.log(max(1 - s.recall, 1e-9)) / math.log(1 - shared) / s.tables))


def _buckets(vectors: DataFrame, dim: int, count: int, seed: int, s: Settings) -> DataFrame:
    """(g, id, v, component, inside, outside): every vector in one bucket of each table; large buckets are divided at random."""
    bits = _bits(count, s)

    @F.arrow_udf("array<long>")
    def signatures(v: pa.Array) -> pa.Array:
        planes = np.random.default_rng(seed).standard_normal((dim, s.tables * bits))
        signs = (matrix(v) @ planes > 0).reshape(len(v), s.tables, bits)
        return pa.array((signs @ (1 << np.arange(bits))).tolist(), pa.list_(pa.int64()))

    dealt = vectors.select("id", "v", "component", F.posexplode(signatures("v")).alias("t", "sig"))
    sizes = dealt.groupBy("t", "sig").count().where(F.col("count") > 1)
    part = F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("count") / s.bucket))
    return dealt.join(sizes, ["t", "sig"]).select(F.struct("t", "sig", part.alias("part")).alias("g"), "id", "v", "component", F.lit(-2.0).alias("inside"), F.lit(-2.0).alias("outside"))


def _merged(old: DataFrame | None, found: DataFrame, s: Settings) -> DataFrame:
    """Lists (id, inside, outside: array<struct<sim, other>> closest first, changed) of the k closest known ones in and out of the component."""
    rows = found.where("not edge").select("id", "other", "sim", "same", F.lit(True).alias("new"))
    if old is not None:
        rows = rows.unionByName(_listed(old).withColumn("new", F.lit(False)))
    once = rows.groupBy("id", "other", "same").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    # a vector that many groups compare is cut down in parts first
    some = lambda of: F.slice(F.sort_array(of, asc=False), 1, s.neighbours)
    part = once.groupBy("id", "same", F.pmod(F.xxhash64("other"), F.lit(16)).alias("_part")).agg(some(F.collect_list(F.struct("sim", "other", "new"))).alias("some"))
    kinds = [some(F.flatten(F.collect_list(F.when(F.col("same") == same, F.col("some"))))).alias(name) for same, name in ((True, "inside"), (False, "outside"))]
    best = part.groupBy("id").agg(*kinds)
    plain = lambda name: F.transform(name, lambda x: F.struct(x["sim"].alias("sim"), x["other"].alias("other"))).alias(name)
    return best.select("id", plain("inside"), plain("outside"), F.exists(F.concat("inside", "outside"), lambda x: x["new"]).alias("changed"))


def _listed(lists: DataFrame) -> DataFrame:
    """The lists' pairs: (id, other, sim, same)."""
    pairs = [lists.select("id", F.inline(name)).select("id", "other", "sim", F.lit(name == "inside").alias("same")) for name in ("inside", "outside")]
    return pairs[0].unionByName(pairs[1])


def _relabelled(lists: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """The lists divided anew by the components that the vectors have now."""
    mine, theirs = vectors.select("id", F.col("component").alias("c")), vectors.select(F.col("id").alias("other"), F.col("component").alias("d"))
    pairs = _listed(lists).join(mine, "id").join(theirs, "other")
    return _merged(None, pairs.select("id", "other", "sim", (F.col("c") == F.col("d")).alias("same"), F.lit(False).alias("edge")), s)


def _around(lists: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """(g, id, v, component, inside, outside): around each vector with changed lists, its neighbours and some that list it."""
    k = s.neighbours
    full = lambda name: (F.size(name) >= k) & (F.element_at(name, -1)["sim"] >= s.threshold)
    # a list that is full of links needs no closer ones: the component's blocks find those inside, and those outside are about to join it
    floor = lambda name: F.when(full(name), 2.0).when(F.size(name) >= k, F.element_at(name, -1)["sim"]).otherwise(-2.0).alias(name)
    floors = lists.select("id", floor("inside"), floor("outside"))
    open_ = lists.where("changed").where(~full("outside"))
    forth = open_.select(F.col("id").alias("g"), F.explode(F.transform(F.concat("inside", "outside"), lambda x: x["other"])).alias("id"))
    salted = forth.select(F.col("id").alias("g"), F.struct(F.xxhash64("g", "id").alias("h"), F.col("g").alias("id")).alias("x"))
    parts = salted.groupBy("g", F.pmod("x.h", F.lit(16)).alias("_p")).agg(F.slice(F.sort_array(F.collect_list("x")), 1, k).alias("some"))
    back = parts.groupBy("g").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k).alias("some")).select("g", F.explode(F.col("some.id")).alias("id"))
    members = forth.unionByName(back).unionByName(open_.select(F.col("id").alias("g"), "id")).distinct()
    return members.join(vectors, "id").join(floors, "id", "left").select(
        "g", "id", "v", "component", F.coalesce("inside", F.lit(-2.0)).alias("inside"), F.coalesce("outside", F.lit(-2.0)).alias("outside"))


def count_links(x: np.ndarray, y: np.ndarray, threshold: float, wx: np.ndarray | None = None, wy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many of y (with their weights) each of x reaches, and the other way round; decided by the blocks' radii where they allow it."""
    wx, wy = (np.ones(len(z), dtype=np.int64) if w is None else w for z, w in ((x, wx), (y, wy)))
    centres = [z.mean(axis=0) for z in (x, y)]
    if all(np.linalg.norm(c) > 1e-6 for c in centres):
        a, b = (c / np.linalg.norm(c) for c in centres)
        angle = lambda z: np.arccos(np.clip(z, -1, 1))
        spread = angle(x @ a).max() + angle(y @ b).max()
        between, limit = angle(a @ b), math.acos(threshold)
        if between + spread < limit - 1e-6:
            return np.full(len(x), wy.sum()), np.full(len(y), wx.sum())
        if between - spread > limit + 1e-6:
            return np.zeros(len(x), int), np.zeros(len(y), int)
    hits = x @ y.T >= threshold
    return hits @ wy, wx @ hits


def _component_links(members: DataFrame, s: Settings) -> DataFrame:
    """(id, n_links) within the components of (id, v, weight, component), a pair of blocks at a time."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.struct("component", F.least("b", "with").alias("i"), F.greatest("b", "with").alias("j")).alias("unit")

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, b, w, x = table["id"].to_numpy(), table["b"].to_numpy(), table["weight"].to_numpy(), matrix(table["v"])
        low, high = b == b.min(), b == b.max()
        if b.min() == b.max():
            n, _ = count_links(x, x, s.threshold, w, w)
            return pa.table({"id": ids, "n_links": (n - 1).astype(np.int64)})
        n, m = count_links(x[low], x[high], s.threshold, w[low], w[high])
        return pa.table({"id": np.concatenate([ids[low], ids[high]]), "n_links": np.concatenate([n, m]).astype(np.int64)})

    # a unit of one block alone: its own pairs; of two, the pairs across them
    found = dealt.select(unit, "id", "b", "v", "weight").groupBy("unit").applyInArrow(count, "id long, n_links long")
    return found.groupBy("id").agg(F.sum("n_links").cast("long").alias("n_links"))


def audit(vectors: DataFrame, s: Settings) -> float:
    """Share of the true links of a random choice of about ``audited`` vectors, compared with all, that lie within components.

    The lesser of the share over all their links and of the mean over those that have links, so that large groups can't
    speak for small ones.
    """
    chosen = vectors.orderBy(F.xxhash64(F.lit(77), "id"), "id").limit(s.audited).select("id", "v", "component").toArrow()
    if not len(chosen):
        return 1.0
    ids, c, x = chosen["id"].to_numpy(), chosen["component"].to_numpy(), matrix(chosen["v"])

    def count(batches):
        total, found = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                hits = (x @ matrix(b["v"]).T >= s.threshold) & (ids[:, None] != b["id"].to_numpy()[None, :])
                w = b["weight"].to_numpy()
                total += hits @ w
                found += (hits & (c[:, None] == b["component"].to_numpy()[None, :])) @ w
        yield pa.RecordBatch.from_pydict({"id": ids, "n": total, "found": found})

    counted = vectors.select("id", "v", "weight", "component").mapInArrow(count, "id long, n long, found long")
    each = counted.groupBy("id").agg(F.sum("n").alias("n"), F.sum("found").alias("found")).where("n > 0")
    over, mean = each.agg(F.sum("found") / F.sum("n"), F.avg(F.col("found") / F.col("n"))).first()
    return 1.0 if over is None else min(over, mean)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", s: Settings = Settings()) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of every row, and the audited recall; an error if that stays below ``recall``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null id.
    Vectors of each length are compared among themselves, one length after the other (the recall is the least of them). Rows that repeat an id are taken as one vector (the
    first in order of their components), each returned with its values. An empty table gives an empty result.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(fine & F.col("id").isNotNull())
    ids = rows.select("id")
    vectors = written(good.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    lengths = sorted(r["dim"] for r in vectors.groupBy(F.size("v").alias("dim")).count().where("count > 1").collect())
    if not lengths:
        return ids.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")), 1.0
    found = [_links_of_length(vectors.where(F.size("v") == dim), dim, s) for dim in lengths]
    links = reduce(DataFrame.unionByName, [x for x, _ in found])
    out = ids.join(links, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), min(recall for _, recall in found)


def _links_of_length(vectors: DataFrame, dim: int, s: Settings) -> tuple[DataFrame, float]:
    """(id, n_links, component) of vectors of one length, and the audited recall."""
    # equal vectors are one with a weight, under their smallest id
    distinct = written(vectors.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "distinct-vectors")
    count = distinct.count()
    now, lists, edges, recall, roots = distinct.withColumn("component", F.col("id")), None, None, 0.0, count
    limit = _attempts(count, s)
    for attempt in range(limit):
        found = written(_joined(_buckets(now, dim, count, attempt, s), s), "pairs")
        seen = [found]
        lists = written(_merged(None if lists is None else _relabelled(lists, now, s), found, s), "neighbours")
        for _ in range(s.rounds):
            found = written(_joined(_around(lists, now, s), s), "pairs")
            seen.append(found)
            lists = written(_merged(lists, found, s), "neighbours")
        for x in seen:
            new = x.where("edge").select(F.col("id").alias("a"), F.col("other").alias("b"))
            edges = new if edges is None else edges.unionByName(new)
        parts = written(components(edges), "components")
        edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
        joined = distinct.join(parts.withColumnRenamed("node", "id"), "id", "left")
        now = written(joined.select("id", "v", "weight", F.coalesce("component", "id").alias("component")), "labelled-vectors")
        before, roots = roots, now.where("id = component").count()
        recall = audit(now, s)
        if recall >= s.recall and roots == before:
            break
    if recall < s.recall:
        raise RuntimeError(f"{limit} attempts found {recall:.4f} of the audited links, fewer than {s.recall}")
    linked = now.join(parts.select(F.col("node").alias("id")), "id", "left_semi")
    counted = now.join(_component_links(linked, s), "id", "left").select("v", F.coalesce("n_links", F.col("weight") - 1).alias("n_links"), "component")
    return written(vectors.join(counted, "v").select("id", "n_links", "component"), "vector-links"), recall
