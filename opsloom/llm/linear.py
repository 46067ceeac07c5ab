"""Sparse logistic regression by follow-the-regularised-leader steps."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]   # feature numbers and their values


def squash(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit_ftrl(rows: list[Row], targets: np.ndarray, size: int, alpha: float = 0.5, beta: float = 1.0,
             l1: float = 0.002, l2: float = 0.1, passes: int = 3, free: int = 0) -> np.ndarray:
    """``size`` weights and, last, the intercept by FTRL-Proximal.

    Only the coordinates of a row are read and changed in its step. Rows of the rarer class weigh more, so
    0.5 is the balanced cut. The intercept and the last ``free`` coordinates are not pressed to 0. Without rows
    all weights are 0.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    good = float(targets.sum())
    share = {1.0: 0.5 * len(rows) / max(good, 1), 0.0: 0.5 * len(rows) / max(len(rows) - good, 1)}
    press = np.full(size + 1, l1)
    press[size - free:] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= press[i], 0.0,
                        -(zi - np.sign(zi) * press[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for (i, x), y in zip(rows, targets):
            i, x = np.append(i, size), np.append(x, 1.0)
            w = weights(i)
            g = (squash(w @ x) - y) * share[float(y)] * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size + 1))
