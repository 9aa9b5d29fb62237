"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text's letters, lower-cased, form words with a blank on either side; their runs of two to four characters that
hold no inner blank are hashed into buckets. The mean of the buckets' embeddings goes through a linear softmax.
Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; a part of the
sample is kept back to fit a temperature and the score below which a prediction is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import free_name, trim, worker_cache

UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")
PIECE = 1 << 18  # characters hashed at a time


@dataclass(frozen=True)
class Settings:
    rows_per_language: int = 600  # labelled rows that are learned from, at most about so many of each language
    rows: int = 60_000  # and at most about so many of all; every label is learned, of a table with very many from fewer rows each
    sample_chars: int = 2000  # a sampled row gives one window of at most so many characters
    bits: int = 15
    dim: int = 12
    epochs: int = 12
    rate: float = 0.5
    kept_back: int = 4  # every so many-th sampled row calibrates
    rejected_share: float = 0.0005  # share of rightly predicted rows that the threshold may reject


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subwords(text: str, bits: int):
    """Buckets of a text's subwords, a stretch of the text at a time."""
    plain = " " + " ".join(_WORDS.findall(text.lower())) + " "
    for start in range(0, len(plain), PIECE):
        c = np.frombuffer(plain[start : start + PIECE + 3].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        inner = c == 32
        h = c * np.uint64(0x9E3779B97F4A7C15)
        clear = np.ones(len(c), dtype=bool)
        for n in (2, 3, 4):
            if len(c) < n:
                break
            if n > 2:
                clear = clear[: len(c) - n + 1] & ~inner[n - 2 : len(c) - 1]
            else:
                clear = clear[: len(c) - 1]
            h = (h[: len(c) - n + 1] ^ (c[n - 1 :] + np.uint64(n))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            take = min(PIECE, len(h))  # what starts later belongs to the next stretch
            yield (h[:take][clear[:take]] >> np.uint64(64 - bits)).astype(np.int64)


def bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    counts = np.zeros(1 << bits)
    for b in subwords(text, bits):
        counts += np.bincount(b, minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(counts.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    temperature: float
    threshold: float
    bits: int

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.embeddings.shape[1]), 0
        for b in subwords(text, self.bits):
            n += len(b)
            if len(b) > 8192:
                total += np.bincount(b, minlength=len(self.embeddings)) @ self.embeddings
            else:
                total += self.embeddings[b].sum(axis=0)
        return total / max(n, 1) @ self.weights

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether the prediction is rejected."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def limit_of(scores: np.ndarray, share: float) -> float:
    """The score that a share of right predictions stays below.

    Kept-back rows are too few to show a share this small, so the odds' logarithms of the lowest tenth are carried on in a
    straight line over the logarithm of the share (an exponential tail).
    """
    if not len(scores):
        return 0.0
    x = np.sort(scores)[: max(2, len(scores) // 10)]
    shares = (np.arange(len(x)) + 0.5) / len(scores)
    odds = np.log(x + 1e-9) - np.log1p(1e-9 - x)
    if len(x) < len(scores) // 10 or len(x) < 5 or shares[0] <= share or odds[-1] - odds[0] < 1e-6:
        return float(min(x[0], np.quantile(scores, share)))
    slope, at = np.polyfit(np.log(shares), odds, 1)
    return float(min(x[0], 1 / (1 + np.exp(-(at + slope * np.log(share))))))


def _first(row: tuple[str, np.ndarray, np.ndarray]) -> tuple[str, int]:
    return row[0], len(row[1])


def _rest(row: tuple[str, np.ndarray, np.ndarray]) -> tuple[bytes, bytes]:
    return row[1].astype(np.int64).tobytes(), row[2].astype(np.float64).tobytes()


def sampled(got: pa.Table) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, buckets, shares) rows of a table; the arrays are parts of the table's own."""
    rows = []
    for batch in got.to_batches():
        at, share = batch["at"], batch["share"]
        places = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))])
        buckets, shares = at.flatten().to_numpy(), share.flatten().to_numpy()
        rows += [(x, buckets[a:b], shares[a:b]) for x, a, b in zip(batch["label"].to_pylist(), places.tolist(), places[1:].tolist())]
    return rows


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], s: Settings = Settings()) -> Model:
    """A model from (language, buckets, shares) rows; the order of rows doesn't matter."""
    # the bytes of rows are compared only where labels and lengths are equal, not held for all at once
    rows = [r for _, same in groupby(sorted(rows, key=_first), _first) for r in sorted(same, key=_rest)]
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(0)
    number = {x: i for i, x in enumerate(languages)}
    buckets, k = 1 << s.bits, len(languages)
    E = rng.uniform(-1 / s.dim, 1 / s.dim, (buckets, s.dim))
    W, seen = np.zeros((s.dim, k)), np.zeros(buckets, dtype=bool)
    learned = [r for i, r in enumerate(rows) if i % s.kept_back] or rows
    checks = [r for i, r in enumerate(rows) if not i % s.kept_back] or rows
    for _, at, _ in learned:
        seen[at] = True
    steps, step = s.epochs * len(learned), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(learned)):
            lang, at, share = learned[i]
            share = share.astype(np.float64)
            rate = s.rate * (1 - step / steps)
            step += 1
            h = share @ E[at]
            g = softmax(h @ W)
            g[number[lang]] -= 1
            back = W @ g
            W -= rate * np.outer(h, g)
            E[at] -= rate * len(at) ** 0.5 * np.outer(share, back)
    E[~seen] = 0  # subwords never learned say nothing, so a text of them is as likely in any language
    model = Model(languages, E, W, 1.0, 0.0, s.bits)
    if k < 2:
        return model
    logits = np.array([share.astype(np.float64) @ E[at] @ W for _, at, share in checks])
    right = np.array([number[r[0]] for r in checks])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(logits / model.temperature)
    model.threshold = max(1.2 / k, limit_of(p.max(axis=1)[p.argmax(axis=1) == right], s.rejected_share))
    return model


def fit(df: DataFrame, text: Column, label: Column, key: Column, s: Settings = Settings()) -> Model:
    """Learns from the rows with a label and a letter; ``key`` chooses the sample, equal at any partitioning.

    Without such rows the model knows no language and answers ``und``. What reaches the driver is bounded by
    ``rows`` times the buckets of one window, and one count a label.
    """
    rows = df.select(text.alias("text"), label.alias("label"), F.xxhash64(key).alias("key")).where("label is not null and text is not null")
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").collect()
    if not counts:
        return train([], s)
    part = F.pmod("key", F.lit(1 << 20)) / float(1 << 20)
    each = min(s.rows_per_language, max(1, s.rows // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, each / r["count"]))])[F.col("label")]
    start = F.pmod(F.shiftright("key", 20), F.greatest(F.length("text") - s.sample_chars, F.lit(0)) + 1).cast("int")
    sample = rows.where(part < share).select("label", F.substring("text", start + 1, F.lit(s.sample_chars)).alias("text"))

    def bags(batches):
        worker_cache("langid")  # keeps nothing, but lets go of what other operators kept
        for b in batches:
            kept = [(lang, *bag(t, s.bits)) for lang, t in zip(b["label"].to_pylist(), b["text"].to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([x[0] for x in kept], pa.string()), "at": pa.array([x[1] for x in kept], pa.list_(pa.int32())),
                "share": pa.array([x[2] for x in kept], pa.list_(pa.float32()))})

    model = train(sampled(sample.mapInArrow(bags, "label string, at array<int>, share array<float>").toArrow()), s)
    trim()
    return model


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1, calibrated) and lang_rejected to every row.

    A text that is null or has no letter is ``und`` with score 0 and rejected. Repeated rows stay; columns of these
    names are replaced. A text of any length is read whole, in stretches.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the settings

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def guess(texts: pa.Array) -> pa.Array:
        worker_cache("langid")  # keeps nothing, but lets go of what other operators kept
        found = [shipped.value.predict(t.as_py()) for t in texts]
        return pa.array([dict(zip(("lang", "score", "rejected"), f)) for f in found], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    found = free_name(df, "_lang_found")
    out = df.withColumn(found, guess(F.col(text)))
    return out.withColumns({"lang_pred": F.col(f"{found}.lang"), "lang_score": F.col(f"{found}.score"), "lang_rejected": F.col(f"{found}.rejected")}).drop(found)
