"""Logistic regression on sparse counts, small enough for the driver: rows and features are bounded by the caller's sample."""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Mapping, Sequence

import numpy as np


_BUCKETS = 1 << 22      # of the first, rough count of features


def fit(rows: Collection[Mapping[bytes, int]], labels: Sequence[int], share: Sequence[float], penalty: float = 1e-4, steps: int = 250, least: int = 4, most: float = 3.0, evidence: bool = False) -> tuple[dict[bytes, float], float]:
    """Weights (only those that are not 0) and intercept under an L1 penalty, by accelerated proximal gradient.

    rows: read three times, one by one, and never held. share: weight of each row in the loss. Features of fewer than ``least`` rows are left out, counts above ``most`` count as that.
    evidence: only features that speak for label 1, beyond what chance makes of so many features (likelihood ratio), and no negative weights.
    """
    rough = np.zeros(_BUCKETS, np.uint16)               # features that are too rare for sure never get an entry of their own
    for row in rows:
        places = np.unique(np.fromiter((hash(f) % _BUCKETS for f in row), np.int64, len(row)))
        rough[places] += rough[places] < least
    seen, own = Counter(), Counter()
    for row, label in zip(rows, labels, strict=True):
        common = [f for f in row if rough[hash(f) % _BUCKETS] >= least]
        seen.update(common)
        if label:
            own.update(common)
    names = sorted(f for f, n in seen.items() if n >= least)
    if evidence:
        bound = 2 * math.log(len(names) + 1)
        names = [f for f in names if _ratio(own[f], seen[f], sum(labels), len(labels)) > bound]
    place = {f: i for i, f in enumerate(names)}
    flat = [(r, place[f], n) for r, own in enumerate(rows) for f, n in own.items() if f in place]
    row, col = (np.array([x[i] for x in flat], np.int64) for i in (0, 1))
    val = np.minimum(np.array([x[2] for x in flat], float), most)
    y, share = np.array(labels, float), np.array(share, float)
    share /= share.sum() or 1.0

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, val * w[col], len(rows))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, val * r[row], len(names))
    probe, top = np.ones(len(names)), 1.0
    for _ in range(8):                                   # largest curvature, by power iteration
        probe = back(times(probe) * share)
        top = np.linalg.norm(probe) or 1.0
        probe /= top
    rate = 1 / (0.25 * (top + 1))
    prior = float((y * share).sum())
    w = z = np.zeros(len(names))
    b = c = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    t = 1.0
    for _ in range(steps):
        error = share * (1 / (1 + np.exp(-np.clip(times(z) + c, -30, 30))) - y)
        moved = z - rate * back(error)
        nw, nb = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0), c - rate * error.sum()
        nw = np.maximum(nw, 0) if evidence else nw
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return {names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(b)


def _ratio(a: int, n: int, ones: int, rows: int) -> float:
    """Twice the log likelihood ratio of a feature in ``a`` of its ``n`` rows with label 1, where ``ones`` of all ``rows`` have it; 0 if that is fewer."""
    if a * rows <= n * ones:
        return 0.0
    cells = ((a, n * ones), (n - a, n * (rows - ones)), (ones - a, (rows - n) * ones), (rows - ones - n + a, (rows - n) * (rows - ones)))
    return 2 * sum(k * math.log(k * rows / e) for k, e in cells if k)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def calibrated(scores: Sequence[float], labels: Sequence[int], rounds: int = 30) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * score + offset) a probability (Platt's method, with his smoothed targets)."""
    x, y = np.array(scores, float), np.array(labels, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() or 1.0))
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)
