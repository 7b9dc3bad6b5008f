"""Gradient-boosted regression trees for a binary target (numpy, histograms, logistic loss)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class BoostedTrees:
    """Trees as flat arrays, complete to one depth: feature and cut of each inner node, value of each leaf."""

    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    values: np.ndarray  # trees x leaves
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.features.shape[1]
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, share: float = 1.0) -> BoostedTrees:
    """Newton boosting; a node without a useful split sends all its rows to the left. Each tree is fitted on a random share
    of the rows, drawn with a fixed seed."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    codes = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score, inner = np.full(len(y), base), 2**depth - 1
    found, draws = ([], [], []), np.random.default_rng(0)
    columns = np.ascontiguousarray(codes.T)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = y - prob, prob * (1 - prob)
        drawn = np.flatnonzero(draws.random(len(y)) < share) if share < 1 else np.arange(len(y))
        drawn_grad, drawn_hess = grad[drawn], hess[drawn]
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            held = local[drawn] * BINS
            best_gain = np.full(width, 1e-9)
            threshold = np.full(width, BINS, dtype=np.int64)
            for f in range(x.shape[1]):
                key = held + columns[f][drawn]
                g = np.cumsum(np.bincount(key, weights=drawn_grad, minlength=width * BINS).reshape(width, BINS), axis=1)
                h = np.cumsum(np.bincount(key, weights=drawn_hess, minlength=width * BINS).reshape(width, BINS), axis=1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + l2) + rest_g**2 / (rest_h + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
                gain[:, len(edges[f]) :] = -1
                gain[(h < 1e-3) | (rest_h < 1e-3)] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best_gain
                best_gain[better], threshold[better] = top[better], at[better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = edges[f][np.minimum(at[better], len(edges[f]) - 1)] if len(edges[f]) else np.inf
            node = 2 * node + 1 + (codes[np.arange(len(y)), feature[node]] > threshold[local])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=grad, minlength=inner + 1) / (np.bincount(leaf, weights=hess, minlength=inner + 1) + l2)
        score += value[leaf]
        for store, part in zip(found, (feature, cut, value), strict=True):
            store.append(part)
    return BoostedTrees(*(np.array(f) for f in found), base)
