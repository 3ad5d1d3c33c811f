"""Gradient-boosted trees for two classes, on binned features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.values):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, share: float = 0.5, seed: int = 1, smooth: float = 1.0, rows: float = 1.0) -> Boosted:
    rng = np.random.default_rng(seed)
    n, width = x.shape
    cuts = []
    for f in range(width):
        values = np.unique(x[:, f])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins), method="nearest"))
        cuts.append((values[1:] + values[:-1]) / 2)
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(depth, float(np.log(p / (1 - p))))
    score = np.full(n, model.base)
    some = max(1, int(width * share))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        taken = np.flatnonzero(rng.random(n) < rows) if rows < 1 else np.arange(n)
        gr, hr = np.repeat(g[taken], some), np.repeat(h[taken], some)
        chosen = np.sort(rng.choice(width, some, replace=False))
        part = binned[taken][:, chosen]
        inner = 2**depth - 1
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = (((at[taken] - first)[:, None] * some + np.arange(some)) * bins + part).ravel()
            size = nodes * some * bins
            gs = np.bincount(key, gr, size).reshape(nodes, some, bins).cumsum(axis=2)
            hs = np.bincount(key, hr, size).reshape(nodes, some, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
            gain[:, :, -1] = 0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            for k in range(nodes):
                f, b = chosen[best[k] // bins], best[k] % bins
                if flat[k, best[k]] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + smooth)
        score += value[leaf]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.values.append(value)
    return model
