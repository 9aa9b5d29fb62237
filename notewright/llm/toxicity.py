"""Toxicity scores from a lexicon that is matched with misspellings and read in context.

The lexicon (whole words and word stems) is learned from labelled rows. Each text's words run through the
intersection of the terms' trie with their Levenshtein automata: a state is a set of (trie place, edits so far)
pairs, made when first needed and kept. A hit counts by its term's weight, less for each edit, and by its context:
in a window of words around it quotation marks and words of reporting speak for a quotation, words of address for
abuse. A logistic regression turns the sums into a score.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import free_name, worker_cache, written

_TOKEN = re.compile(r"\w+|[\"“”„«»‘’]")
QUOTES = frozenset("\"“”„«»")
# Words of reporting and of address in the languages at hand; they only weigh hits, so a missing word drops none.
REPORTING = frozenset("said says called wrote quoted quote reported word term dit écrit appelé mot sagte schrieb nannte wort dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your you're u du dich dein deine ihr tu toi vous votre tú te usted eres".split())


@dataclass(frozen=True)
class Settings:
    rows_per_class: int = 2000  # labelled rows that are learned from, at most about so many of each class
    candidates: int = 3000  # strongest features looked at for the lexicon
    terms: int = 400
    stem_letters: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    least_rows: int = 5
    window: int = 8  # words on either side of a hit
    edit_discount: float = 0.6
    quoted: float = 0.25  # what is left of a hit in quotation marks
    reported: float = 0.5
    addressed: float = 1.5


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # matches words that begin with it
    weight: float
    edits: int
    rows: int = 0  # toxic rows of the sample's first half that hold it


def allowed_edits(text: str, stem: bool) -> int:
    """Edits at which a term is still recognised: none in short ones, fewer in stems."""
    n = len(text) - 2 * stem
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """The terms' trie intersected with their Levenshtein automata, made state by state."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, t in enumerate(terms):
            node = 0
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(i)
        # most edits that any term below a place allows
        self.most = [max([-1, *(terms[i].edits for i in e)]) for e in self.ends]
        for node in range(len(self.children) - 1, -1, -1):
            self.most[node] = max([self.most[node], *(self.most[c] for c in self.children[node].values())])
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.whole: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0} if terms else {})

    def _state(self, edits: dict[int, int]) -> int:
        """The state of a map place -> fewest edits, after skipping letters of terms."""
        edits, queue = dict(edits), list(edits)
        while queue:
            node = queue.pop()
            for child in self.children[node].values():
                e = edits[node] + 1
                if e <= self.most[child] and e < edits.get(child, 99):
                    edits[child] = e
                    queue.append(child)
        key = frozenset(edits.items())
        if key not in self.states:
            hits = [(e, i) for node, e in edits.items() for i in self.ends[node] if e <= self.terms[i].edits]
            best = lambda stem: min(((e, -self.terms[i].weight, i) for e, i in hits if self.terms[i].stem == stem), default=None)
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            for out, stem in ((self.whole, False), (self.stems, True)):
                b = best(stem)
                out.append(b and (b[2], b[0]))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state]:
            options = [(node, e + 1)]  # an extra letter in the word
            options += [(child, e + (letter != c)) for letter, child in self.children[node].items()]
            for place, edits in options:
                if edits <= self.most[place] and edits < after.get(place, 99):
                    after[place] = edits
        made = self.steps[state][c] = self._state(after)
        return made

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term, stems by the word's beginning; None if none is close enough."""
        state, best, steps = self.start, None, self.steps
        for c in word:
            nxt = steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state == self.dead:
                return best
            found = self.stems[state]
            if found and (best is None or found[1] < best[1]):
                best = found
        found = self.whole[state]
        return found if found and (best is None or found[1] <= best[1]) else best


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    silenced: frozenset = frozenset()  # (term, edits) that clean rows hold too
    weights: tuple[float, float] = (0.0, 0.0)
    bias: float = -3.0
    settings: Settings = Settings()

    def scanner(self) -> Scanner:
        return Scanner(self)

    def score(self, abuse: float, quoted: float) -> float:
        z = self.bias + self.weights[0] * math.log1p(abuse) + self.weights[1] * math.log1p(quoted)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Scanner:
    """Finds a model's hits in texts; remembers what it saw of words."""

    def __init__(self, model: Model):
        self.model, self.automaton, self.known = model, Automaton(model.terms), {}

    def match(self, word: str):
        found = self.known.get(word, 0)
        if found == 0:
            found = self.automaton.match(word)
            if found in self.model.silenced:
                found = None
            if len(self.known) > 300_000:
                self.known.clear()
            if len(word) < 40:
                self.known[word] = found
        return found

    def hits(self, text: str | None):
        """(term, edits, context) of each hit; context is 1 where nothing speaks for or against a quotation."""
        if not text:
            return []
        s, tokens = self.model.settings, _TOKEN.findall(text.lower())
        found = [(i, m) for i, w in enumerate(tokens) if (m := self.match(w)) is not None]
        out = []
        for i, (term, edits) in found:
            before, after = tokens[max(0, i - s.window) : i], tokens[i + 1 : i + 1 + s.window]
            context = 1.0
            if any(t in QUOTES for t in before) and any(t in QUOTES for t in after):
                context *= s.quoted
            if not REPORTING.isdisjoint(before):
                context *= s.reported
            if not ADDRESS.isdisjoint(before) or not ADDRESS.isdisjoint(after):
                context *= s.addressed
            out.append((term, edits, context))
        return out

    def sums(self, hits) -> tuple[float, float]:
        """Weights of hits read as abuse and as quotation."""
        abuse = quoted = 0.0
        for term, edits, context in hits:
            w = self.model.terms[term].weight * self.model.settings.edit_discount**edits
            abuse += w * context
            quoted += w * (context < 1)
        return abuse, quoted


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int, s: Settings) -> list[Term]:
    """Terms from (feature, toxic rows, clean rows): whole words end with a blank, stems don't.

    The strongest features come first; of those that hold in the same rows the longest says it all, and what only
    lengthens a chosen stem adds nothing.
    """
    ranked = []
    for f, a, b in rows:
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if a >= max(s.least_rows, 0.0075 * toxic) and odds > 2 and odds * math.sqrt(a) > 8 and b <= 0.05 * a:
            ranked.append((-a, -len(f), f, odds))
    chosen: dict[str, tuple[int, float]] = {}
    for a, _, f, odds in sorted(ranked):
        a, word = -a, f.rstrip()
        wider = [c for c in chosen if c.startswith(f) and chosen[c][0] >= 0.8 * a]
        within = any(word.startswith(c) for c in chosen if not c.endswith(" "))
        if not wider and not within and f not in chosen:
            chosen[f] = (a, odds)
    best = sorted(chosen.items(), key=lambda x: (-x[1][0] * x[1][1], x[0]))[: s.terms]
    return [Term(f.rstrip(), not f.endswith(" "), odds / 3, allowed_edits(f.rstrip(), not f.endswith(" ")), a) for f, (a, odds) in best]


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[tuple[float, float], float]:
    """Weights (never negative for abuse, never positive for quotation) and bias, for rows of which ``share`` are toxic."""
    w, b = np.zeros(2), -2.0
    balance = np.where(y > 0, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    for i in range(4000):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y) * balance
        w -= 1.0 * (x.T @ g / len(y) + 0.0005 * w)
        b -= 1.0 * g.mean()
        w[0], w[1] = max(w[0], 0.0), min(w[1], 0.0)
    return (float(w[0]), float(w[1])), float(b)


def _features(text: Column, s: Settings) -> Column:
    """Distinct whole words (with a blank after them) and stems of a text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    parts = F.transform(words, lambda w: F.concat(
        F.array(F.concat(w, F.lit(" "))), F.array(*[F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in s.stem_letters])))
    return F.array_distinct(F.array_compact(F.flatten(parts)))


def sample(df: DataFrame, labels: DataFrame, text: Column, key: str, label: str, s: Settings) -> tuple[DataFrame, float]:
    """(text, label, half) of a bounded, reproducible choice of the labelled rows, and the toxic share of all of them.

    ``labels`` has one column ``key`` and one ``label`` of 0 and 1; a key with several labels takes the largest.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    counts = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(1.0, s.rows_per_class / max(counts.get(k, 0), 1)))])[F.col("_label")]
    chosen = marked.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) / float(1 << 20) < share)  # bounded by rows_per_class
    rows = df.select(F.col(key).alias("_key"), text.alias("_text")).join(F.broadcast(chosen), "_key")
    # texts of the same words count once and stay in one half
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    rows = rows.where("_text is not null").groupBy(F.xxhash64(words).alias("_hash"), F.col("_label").alias("label")).agg(F.min("_text").alias("text"))
    toxic = counts.get(1, 0) / max(sum(counts.values()), 1)
    return rows.select("text", "label", (F.pmod(F.xxhash64("_hash"), F.lit(2)) == 0).alias("half")), toxic


def fit(df: DataFrame, labels: DataFrame, text: Column, key: str, label: str, s: Settings = Settings()) -> Model:
    """Learns lexicon and score from labelled rows.

    One half of the sample proposes terms, the other confirms them: a term that is rare there, or mostly in clean rows,
    goes, and misspellings that clean rows hold are silenced. Without toxic rows nothing is toxic. The driver sees
    ``candidates`` features and one short row per sampled row.
    """
    rows, share = sample(df, labels, text, key, label, s)
    rows = written(rows, "toxicity-sample")
    sizes = {(r["half"], r["label"]): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    toxic, clean = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    if not toxic:
        return Model(settings=s)
    counted = (
        rows.where("half").select("label", F.explode(_features(F.col("text"), s)).alias("f"))
        .groupBy("f").agg(F.sum("label").cast("long").alias("a"), F.sum(1 - F.col("label")).cast("long").alias("b"))
        .where((F.col("a") >= s.least_rows) & (F.col("b") <= 0.05 * F.col("a")))
        .orderBy(F.desc("a"), F.desc(F.length("f")), "f").limit(s.candidates).collect()
    )
    model = Model(choose_terms([tuple(r) for r in counted], toxic, clean, s), settings=s)
    if not model.terms:
        return model

    def seen(batches):
        scanner = model.scanner()
        for b in batches:
            hits = [scanner.hits(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "label": b["label"], "half": b["half"],
                "hits": pa.array([sorted({(t * 4 + e) for t, e, _ in h}) for h in hits], pa.list_(pa.int32())),
                "sums": pa.array([scanner.sums(h) for h in hits], pa.list_(pa.float64()))})

    schema = "label int, half boolean, hits array<int>, sums array<double>"
    checked = rows.selectExpr("text", "cast(label as int) as label", "half").mapInArrow(seen, schema).collect()
    bad, good, silenced = {}, {}, set()
    for r in checked:
        for h in r["hits"]:
            if h % 4 or not r["half"]:
                side = good if r["label"] else bad
                side[h] = side.get(h, 0) + 1
    other = sizes.get((False, 1), 0) / toxic
    for i, t in enumerate(model.terms):
        if other and good.get(4 * i, 0) < 0.25 * other * t.rows:
            silenced |= {(i, 0), (i, 1), (i, 2)}
    for h, n in bad.items():
        exact = h % 4 == 0
        if n > (good.get(h, 0) if exact else max(good.get(h, 0) // 4, 0.001 * clean)):
            silenced.add((h // 4, h % 4))
            if exact:
                silenced |= {(h // 4, 1), (h // 4, 2)}
    model.silenced = frozenset(silenced)
    if silenced:
        checked = rows.selectExpr("text", "cast(label as int) as label", "half").mapInArrow(seen, schema).collect()
    both = [r for r in checked if not r["half"]] or checked
    if len({r["label"] for r in both}) < 2:
        both = checked
    both.sort(key=lambda r: (r["label"], r["sums"]))
    model.weights, model.bias = fit_logistic(np.log1p(np.array([r["sums"] for r in both])), np.array([r["label"] for r in both], dtype=float), share)
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds toxicity (0 to 1) and toxic_terms (distinct hits as (term, edits, context)) to every row.

    Whole texts are read. Null and empty texts have no hits and the score of a text without any; repeated rows stay;
    columns of these names are replaced; a model without terms gives every row the same low score.
    """
    shipped, token = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by the settings
    kind = "struct<score:double,terms:array<struct<term:string,edits:int,context:double>>>"
    arrow = pa.struct([("score", pa.float64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("context", pa.float64())])))])

    @F.arrow_udf(kind)
    def judge(texts: pa.Array) -> pa.Array:
        cache = worker_cache("toxicity")
        if cache.get("toxicity", ("",))[0] != token:
            cache["toxicity"] = token, shipped.value.scanner()
        scanner, out = cache["toxicity"][1], []
        for t in texts:
            hits = scanner.hits(t.as_py())
            terms = [{"term": shipped.value.terms[a].text, "edits": e, "context": c} for a, e, c in sorted(set(hits))]
            out.append({"score": shipped.value.score(*scanner.sums(hits)), "terms": terms})
        return pa.array(out, arrow)

    found = free_name(df, "_toxicity_found")
    return df.withColumn(found, judge(F.col(text))).withColumns({"toxicity": F.col(f"{found}.score"), "toxic_terms": F.col(f"{found}.terms")}).drop(found)
