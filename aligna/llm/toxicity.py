"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligna.llm.common import begin, carried, mix, numbered, raw, slices, word_hashes

BITS = 20
#: A-Z to a-z; ASCII that is neither a digit nor a letter to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words, word pairs and pairs with one word between, of each text: indexes and bounds."""
    ids, bounds, words = numbered([t.translate(TABLE) for t in texts])
    h = word_hashes(words)[ids]
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keys = [(owner, mix(h))]
    for gap, seed in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(seed))
            keys.append((owner[gap:][same], pair[same]))
    at = np.concatenate([o.astype(np.int64) << bits | (x >> np.uint64(64 - bits)).astype(np.int64) for o, x in keys])
    at = np.unique(at)
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(at >> bits, minlength=len(texts)), out=out[1:])
    return (at & ((1 << bits) - 1)).astype(np.uint32), out


class Ftrl:
    """Per-coordinate rates alpha / (beta + sqrt(sum of squared gradients)), and L1 that keeps most weights at 0."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 6.0, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, y: float, scale: float = 1.0) -> None:
        w, b = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-np.clip(b + w.sum(), -35, 35)))
        g = (p - y) * scale
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g


def fit(rows: list[tuple[bytes, float]], epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Nonzero weights' indexes and values, and the bias. rows: features as uint32 bytes, label."""
    model, order = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            blob, y = rows[i]
            model.learn(np.frombuffer(blob, "<u4"), y)
    w = model.weights()
    at = np.flatnonzero(w)
    return at.astype(np.uint32), w[at].astype(np.float32), float(model.bias())


def train(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: tuple[int, int] = (3000, 6000)):
    """Fit on at most most[1] rows labelled 0 and most[0] labelled 1 that `keep` accepts: those least by a hash of the id.

    That bound is the operator's only one; the sample is the same each time. Ids with clashing or null labels, null
    ids and repeated ids' further rows are left out. Without rows the weights are empty and every score is 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").where(keep).select(id_col, "y")
    part = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n) for y, n in ((1, most[0]), (0, most[1]))]
    chosen = part[0].unionByName(part[1])

    def run(batches):
        begin()
        for batch in batches:
            texts = raw(batch.column(2))
            for a, b in slices(texts):
                at, bounds = features(texts[a:b])
                blobs = [at[i:j].astype("<u4").tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(blobs, pa.binary())], names=["id", "y", "f"])

    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, y {chosen.schema['y'].dataType.simpleString()}, f binary"
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(id_col, "y", text_col).mapInArrow(run, kinds)
    rows = {r.id: (bytes(r.f), float(r.y)) for r in sorted(rows.toLocalIterator(), key=lambda r: (r.id, bytes(r.f)), reverse=True)}
    return fit([rows[k] for k in sorted(rows)])


def score(docs: DataFrame, model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score (0 to 1) of the whole text; that of a null or empty text is the score of no features.

    Map-only; the weights are broadcast: at most 2**20, nearly all left out by L1. All columns stay; one by the new
    name is replaced; repeated rows give a row each; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        at, w, bias = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        found, bounds = features(texts)
        total = np.concatenate([[0.0], np.cumsum(dense[found].astype(np.float64))])
        z = bias + total[bounds[1:]] - total[bounds[:-1]]
        return [1 / (1 + np.exp(-np.clip(z, -35, 35)))]

    return carried(docs, text_col, run, [(name, "double", pa.float64())])
