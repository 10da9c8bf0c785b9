"""Quality classifier: a sparse ensemble of conjunctive rules, scored as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligna.llm.stats import FEATURES, doc_stats, sample
from aligna.llm.trees import Tree, boost

#: (feature, above, threshold) conditions; above: > threshold, else <=.
Rule = tuple[tuple[int, bool, float], ...]


def paths(tree: Tree) -> list[Rule]:
    """The conjunction on the way to every node but the root; of several bounds on one side the tightest stays."""
    out: list[Rule] = []

    def walk(at: int, so_far: dict):
        if so_far:
            out.append(tuple((f, above, t) for (f, above), t in sorted(so_far.items())))
        f, t = int(tree.feature[at]), float(tree.threshold[at])
        if f >= 0:
            walk(int(tree.left[at]), so_far | {(f, False): min(t, so_far.get((f, False), t))})
            walk(int(tree.right[at]), so_far | {(f, True): max(t, so_far.get((f, True), t))})

    walk(0, {})
    return out


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Rows by rules: 1 where a rule holds."""
    out = np.ones((len(x), len(rules)), np.float64)
    for k, rule in enumerate(rules):
        for f, above, t in rule:
            out[:, k] *= x[:, f] > t if above else x[:, f] <= t
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty on columns scaled by their deviation, by accelerated proximal steps."""
    sd = np.maximum(a.std(0), 1e-3)
    s = (a - a.mean(0)) / sd
    w, v, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 0.0, 1.0
    vec = np.ones(a.shape[1]) / max(1, a.shape[1]) ** 0.5
    for _ in range(20):  # largest eigenvalue, for the step
        vec = s.T @ (s @ vec)
        norm = np.linalg.norm(vec) or 1.0
        vec /= norm
    rate = 1 / (0.25 * (norm / len(y) + 1))
    vb = b
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(s @ v + vb, -35, 35))) - y
        new = v - rate * (s.T @ g) / len(y)
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * penalty)
        new_b = vb - rate * g.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    w = w / sd
    return w, float(b - (a.mean(0) * w).sum())


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """Score between 0 and 1 over the FEATURES columns."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds_ = F.lit(True)
            for f, above, t in rule:
                c = F.col(FEATURES[f])
                holds_ = holds_ & (c > F.lit(t) if above else c <= F.lit(t))
            z = z + F.when(holds_, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.003) -> RuleModel:
    """Rules from boosted trees, weighted by the lasso; those of weight 0 go. One class or no rows: a bias alone."""
    bias, grown = boost(x, y, trees, depth, 0.3)
    rules = list(dict.fromkeys(r for t in grown for r in paths(t)))
    if not rules:
        return RuleModel([], [], bias)
    w, b = lasso(holds(rules, x), y, penalty)
    kept = np.flatnonzero(w)
    return RuleModel([rules[k] for k in kept], [float(w[k]) for k in kept], b)


def train(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 8000) -> RuleModel:
    """Fit on at most `most` labelled rows that `keep` (a column over labels) accepts; see stats.sample."""
    return fit(*sample(docs, labels, label, most, keep, id_col, text_col))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score of the whole text; null and empty texts get the score of all-zero statistics. Map-only."""
    return doc_stats(docs, id_col, text_col).select(id_col, model.column().alias("score"))
