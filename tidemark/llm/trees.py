"""Gradient-boosted trees for a binary label, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: (tree, node) -> feature, threshold; (tree, leaf) -> value."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    knots: np.ndarray
    levels: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (len(v) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(x), self.knots, self.levels)


def fit_trees(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, seed: int = 11) -> Trees:
    """Logistic boosting on quantile bins; a quarter of the rows is kept for the calibration."""
    held = np.random.default_rng(seed).random(len(x)) < 0.25
    if not (y[held] == 1).any() or not (y[~held] == 1).any():
        held = np.zeros(len(x), bool)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x[~held].T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x[~held].T, strict=True)], 1)
    target = y[~held].astype(float)
    mean = min(max(target.mean(), 1e-4), 1 - 1e-4)
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(target), start)
    nodes = 2**depth - 1
    feature, threshold, leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = target - p, p * (1 - p)
        f, t, at = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(len(target), np.int64)
        for d in range(depth):
            first, many = 2**d - 1, 2**d
            best = np.full(many, 1e-6)
            slot = at - first
            g0, h0 = np.bincount(slot, grad, many), np.bincount(slot, hess, many)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                cell = slot * width + binned[:, k]
                g = np.bincount(cell, grad, many * width).reshape(many, width).cumsum(1)[:, :-1]
                h = np.bincount(cell, hess, many * width).reshape(many, width).cumsum(1)[:, :-1]
                gain = g**2 / (h + l2) + (g0[:, None] - g) ** 2 / (h0[:, None] - h + l2) - (g0**2 / (h0 + l2))[:, None]
                j = gain.argmax(1)
                top = gain[np.arange(many), j]
                for s in np.flatnonzero(top > best):
                    best[s], f[first + s], t[first + s] = top[s], k, c[j[s]]
            right = x[~held][np.arange(len(at)), f[at]] > t[at]
            at = 2 * at + 1 + right
        slot = at - nodes
        v = rate * np.bincount(slot, grad, nodes + 1) / (np.bincount(slot, hess, nodes + 1) + l2)
        margin += v[slot]
        feature.append(f), threshold.append(t), leaf.append(v)
    model = Trees(np.array(feature), np.array(threshold), np.array(leaf), start, np.zeros(1), np.zeros(1))
    rows = held if held.any() else np.ones(len(x), bool)
    model.knots, model.levels = isotonic(model.margin(x[rows]), y[rows].astype(float))
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to score, by pooling adjacent violators; between knots it is linear.

    A pseudo-row of each label at either end keeps probabilities inside (0, 1).
    """
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order]
    s, v = np.concatenate([[s[0], s[0]], s, [s[-1], s[-1]]]), np.concatenate([[0, 0.5], v, [0.5, 1]])
    blocks: list[list[float]] = []
    for a, b in zip(s, v, strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = np.array([k for b in blocks for k in ((b[2], b[0] / b[1]), (b[3], b[0] / b[1]))])
    return knots[:, 0], knots[:, 1]
