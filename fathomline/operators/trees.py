"""A small numpy classification forest for feature importance, scoring and bagging on modest matrices."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; feature -1 marks a leaf, whose probability of class 1.. is in value."""

    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, threshold, left, right = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        while (feature[at] >= 0).any():
            go = feature[at] >= 0
            rows = np.flatnonzero(go)
            node = at[rows]
            low = x[rows, feature[node]] <= threshold[node]
            at[rows] = np.where(low, left[node], right[node])
        return np.array(self.value)[at]


def _best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray) -> tuple[float, int, float]:
    """(impurity decrease, feature, threshold): each feature is sorted once and all cuts are scored."""
    best = (1e-12, -1, 0.0)
    total, ones = w.sum(), (w[:, None] * y).sum(0)
    parent = total - (ones**2).sum() / total
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, c, n = x[order, f], np.cumsum(w[order, None] * y[order], 0), np.cumsum(w[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        l, nl = c[cut], n[cut]  # noqa: E741
        r, nr = ones - l, total - nl
        ok = (nl > 0) & (nr > 0)
        score = np.where(ok, parent - (nl - (l**2).sum(1) / np.where(ok, nl, 1)) - (nr - (r**2).sum(1) / np.where(ok, nr, 1)), -1)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (float(score[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 6, subset: int | None = None, weight: np.ndarray | None = None, least: int = 2) -> Tree:
    """y: one column per class."""
    w = np.ones(len(x)) if weight is None else weight
    subset = subset or max(1, int(np.sqrt(x.shape[1])))
    tree = Tree()

    def node(rows: np.ndarray, level: int) -> int:
        k = len(tree.feature)
        p = (w[rows, None] * y[rows]).sum(0)
        for a, v in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, k), (tree.right, k), (tree.value, p / max(p.sum(), 1e-300)), (tree.gain, 0.0)):
            a.append(v)
        if level < depth and len(rows) >= least and (p > 0).sum() > 1:
            gain, f, cut = _best_split(x[rows], y[rows], w[rows], rng.choice(x.shape[1], min(subset, x.shape[1]), replace=False))
            if f >= 0:
                low = x[rows, f] <= cut
                tree.feature[k], tree.threshold[k], tree.gain[k] = f, cut, gain
                tree.left[k], tree.right[k] = node(rows[low], level + 1), node(rows[~low], level + 1)
        return k

    node(np.arange(len(x)), 0)
    return tree


def one_hot(y: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (y[:, None] == classes).astype(float)


@dataclass
class Forest:
    trees: list
    classes: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.probabilities(x).argmax(1)]


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 6, subset: int | None = None, seed: int = 0, share: float = 0.7, weight: np.ndarray | None = None) -> Forest:
    classes = np.unique(y)
    hot = one_hot(y, classes)
    out = []
    for k in range(trees):
        rng = np.random.default_rng([seed, k])
        rows = rng.integers(0, len(x), max(2, int(len(x) * share)))
        out.append(grow(x[rows], hot[rows], rng, depth, subset, None if weight is None else weight[rows]))
    return Forest(out, classes)


def log_loss(y: np.ndarray, p: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Of each row."""
    known = np.isin(y, classes)
    at = np.searchsorted(classes, np.where(known, y, classes[0]))
    return -np.log(np.clip(np.where(known, p[np.arange(len(y)), at], 0.0), 1e-15, 1 - 1e-15))
