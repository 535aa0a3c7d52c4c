"""A linear-chain conditional random field with two labels, over many chains at once.

Chains are columns, positions rows, longest chain first. With two labels every message is one
number, the log odds of label 1, so forward and backward passes are one vector
operation a position. Label 0 to label 0 has transition weight 0; ``t`` holds the others: 01, 10, 11.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Chains:
    """Chains of ``lengths`` laid out one after another; ``order`` has the longest first."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(-self.lengths, kind="stable")
        ordered = self.lengths[self.order]
        self.starts = (np.cumsum(self.lengths) - self.lengths)[self.order]
        self.longest = int(ordered[0]) if len(ordered) else 0
        #: How many chains reach position i.
        self.alive = len(ordered) - np.searchsorted(ordered[::-1], np.arange(self.longest), "right")

    def at(self, i: int) -> np.ndarray:
        return self.starts[: self.alive[i]] + i


def _pass(x, across, straight, base, other):
    return np.logaddexp(x + straight, across) - np.logaddexp(x + other, base)


def forward_backward(u: np.ndarray, chains: Chains, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (with a position's own u) and backward log odds, flat like u."""
    t01, t10, t11 = t
    f, b = u.astype(float).copy(), np.zeros(len(u))
    for i in range(1, chains.longest):
        at = chains.at(i)
        f[at] += _pass(f[at - 1], t01, t11, 0.0, t10)
    for i in range(chains.longest - 1, 0, -1):
        at = chains.at(i)
        b[at - 1] = _pass(u[at] + b[at], t10, t11, 0.0, t01)
    return f, b


def marginals(u: np.ndarray, chains: Chains, t: np.ndarray) -> np.ndarray:
    f, b = forward_backward(u, chains, t)
    return sigmoid(f + b)


def fit(features, labels: np.ndarray, lengths: np.ndarray, n_features: int, *, steps: int = 250, rate: float = 0.15, ridge: float = 0.3, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam. ``features`` is a dense matrix, or a pair (position, feature) of ones. Returns weights and t.

    ``times`` says how often each chain counts, once by default.
    """
    chains, n = Chains(np.asarray(lengths)), len(labels)
    often = np.ones(n) if times is None else np.repeat(np.asarray(times, float), lengths)
    y = labels.astype(float)
    sparse = isinstance(features, tuple)
    firsts = np.ones(n, bool)
    firsts[np.cumsum(lengths) - lengths] = False
    later = np.flatnonzero(firsts)
    w, t = np.zeros(n_features), np.zeros(3)
    between = often[later]
    seen = np.array([(between * (1 - y[later - 1]) * y[later]).sum(), (between * y[later - 1] * (1 - y[later])).sum(), (between * y[later - 1] * y[later]).sum()])
    m = v = np.zeros(n_features + 3)
    for step in range(1, steps + 1):
        u = np.bincount(features[0], w[features[1]], n) if sparse else features @ w
        f, b = forward_backward(u, chains, t)
        p = sigmoid(f + b)
        left, right = f[later - 1], u[later] + b[later]
        scores = np.stack([np.zeros(len(later)), t[0] + right, t[1] + left, t[2] + left + right])
        scores = np.exp(scores - scores.max(axis=0))
        pairs = (scores / scores.sum(axis=0) * between).sum(axis=1)[1:] if len(later) else np.zeros(3)
        miss = often * (y - p)
        gw = np.bincount(features[1], miss[features[0]], n_features) if sparse else features.T @ miss
        g = (np.concatenate([gw, seen - pairs]) - ridge * np.concatenate([w, t])) / max(1.0, often.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[:n_features], t + move[n_features:]
    return w, t


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of the columns of x and, last, an intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w
