"""Quality rules with a verdict of gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aligna.llm.common import begin, raw, slices
from aligna.llm.stats import COUNTS, FEATURES, measure, sample
from aligna.llm.trees import boost

#: More symbols, repeats, repeated lines or shouted words never raise a score.
FALLING = ("symbol_share", "repeat_share", "dup_line_share", "upper_word_share", "top_word_share")


@dataclass
class Forest:
    """All trees' nodes in arrays, end to end; roots says where each tree starts."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """All rows through all trees at once, a level a step; a leaf points to itself."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(go, self.left[at], self.right[at])
        z = self.base + (self.value[at].sum(1) if len(self.roots) else 0.0)
        return 1 / (1 + np.exp(-z * np.ones(len(x))))


def flatten(base: float, trees: list, depth: int) -> Forest:
    roots, parts, n = [], [], 0
    for t in trees:
        own = np.arange(len(t.feature))
        leaf = t.feature < 0
        parts.append((np.where(leaf, 0, t.feature), t.threshold, np.where(leaf, own, t.left) + n, np.where(leaf, own, t.right) + n, t.value))
        roots.append(n)
        n += len(own)
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return Forest(base, np.array(roots, np.int64), *cols, depth)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2) -> Forest:
    base, grown = boost(x, y, trees, depth, rate, monotone=[-1 if f in FALLING else 0 for f in FEATURES])
    return flatten(base, grown, depth)


def train(docs: DataFrame, labels: DataFrame, keep=None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 8000) -> Forest:
    """Fit on at most `most` labelled rows; see stats.sample."""
    return fit(*sample(docs, labels, label, most, keep, id_col, text_col))


def apply_rules(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """Per row: id, the counts of stats.COUNTS, base_failed, score, kept. Map-only, over whole texts.

    base_failed: fewer than 10 words, or over 20 % of them in repeated windows of five. kept: not base_failed and the
    trees' score is at least `least`. Null and empty texts have no words and fail; repeated rows give a row each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        begin()
        for batch in batches:
            texts = raw(batch.column(1))
            for a, b in slices(texts):
                counts, x = measure(texts[a:b])
                failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
                p = sent.value.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(np.ascontiguousarray(c)) for c in counts.T], pa.array(failed), pa.array(p), pa.array(~failed & (p >= least))], names=[id_col, *COUNTS, "base_failed", "score", "kept"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")
