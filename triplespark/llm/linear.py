"""Logistic regression with numpy alone, over any matrix that can be multiplied from either side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def fit_logistic(
    times: Callable[[np.ndarray], np.ndarray], back: Callable[[np.ndarray], np.ndarray], columns: int, y: np.ndarray, penalty: float, steps: int, memory: int = 10
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression whose classes weigh alike, by limited-memory BFGS.

    ``times`` multiplies the matrix by weights, ``back`` multiplies a value for each row by the matrix.
    """
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = times(w[:-1]) + w[-1]
        value = (share * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * (w[:-1] ** 2).sum()
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        return value, np.append(back(g) + penalty * w[:-1], g.sum())

    w = np.zeros(columns + 1)
    value, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, used = -g, []
        for s, t, r in reversed(pairs):
            used.append(r * (s @ d))
            d = d - used[-1] * t
        if pairs:
            s, t, r = pairs[-1]
            d = d / (r * (t @ t))
        for (s, t, r), u in zip(pairs, reversed(used), strict=True):
            d = d + (u - r * (t @ d)) * s
        size = 1.0 if pairs else 1 / max(1e-9, np.abs(g).sum())
        for _ in range(30):
            after, h = loss(w + size * d)
            if after <= value + 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            break
        s, t = size * d, h - g
        if s @ t > 1e-12:
            pairs = [*pairs[1 - memory :], (s, t, 1 / (s @ t))]
        done = value - after < 1e-9
        w, value, g = w + s, after, h
        if done:
            break
    return w[:-1], float(w[-1])
