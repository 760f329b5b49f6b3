"""Logistic regression on sparse rows, for the bounded samples that models are learned from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows as runs of (index, value)."""

    index: np.ndarray
    value: np.ndarray
    begins: np.ndarray

    def times(self, weights: np.ndarray) -> np.ndarray:
        owner = self.owner()
        return np.bincount(owner, self.value * weights[self.index], len(self.begins))

    def owner(self) -> np.ndarray:
        ends = np.append(self.begins[1:], len(self.index))
        return np.repeat(np.arange(len(self.begins)), ends - self.begins)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: Sparse, labels: np.ndarray, size: int, *, rounds: int = 120, rate: float = 0.5,
        ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias; both labels count the same in sum. Adam on all rows each round."""
    labels = labels.astype(float)
    share = np.clip(labels.mean(), 1e-9, 1 - 1e-9)
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    owner, weights, bias = rows.owner(), np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(1, rounds + 1):
        guess = sigmoid(np.bincount(owner, rows.value * weights[rows.index], len(labels)) + bias)
        error = (guess - labels) * importance
        slope = np.bincount(rows.index, rows.value * error[owner], size) + ridge * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
        step = rate / (1 + 3 * k / rounds)
        weights -= step * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-9)
        bias -= 0.1 * step * (mb / (1 - 0.9 ** k)) / (np.sqrt(vb / (1 - 0.99 ** k)) + 1e-9)
    return weights, bias


def calibrate(raw: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * raw + b) by Newton steps, with smoothed labels as in Platt's method."""
    if not len(raw):
        return 1.0, 0.0
    up, down = importance[labels == 1].sum(), importance[labels == 0].sum()
    goal = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 0.0, float(np.log((up + 1) / (down + 1)))
    x = np.stack([raw, np.ones(len(raw))])
    for _ in range(50):
        p = sigmoid(a * raw + b)
        slope = x @ (importance * (p - goal)) + 1e-6 * np.array([a, b])
        bend = (x * (importance * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def weighed(evidence: np.ndarray, labels: np.ndarray, importance: np.ndarray, *,
            ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, b) of sigmoid(evidence @ weights + b) as in ``calibrate``, for several columns; what would weigh less
    than 0 weighs 0. The ridge shares the weight among columns that each part the rows."""
    up, down = importance[labels == 1].sum(), importance[labels == 0].sum()
    goal = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    kept = list(range(evidence.shape[1]))
    while True:
        x = np.column_stack([evidence[:, kept], np.ones(len(labels))])
        w = np.zeros(len(kept) + 1)
        light = np.append(np.full(len(kept), ridge), 1e-6)
        w[-1] = np.log((up + 1) / (down + 1))
        for _ in range(50):
            p = sigmoid(x @ w)
            slope = x.T @ (importance * (p - goal)) + light * w
            step = np.linalg.solve((x.T * (importance * p * (1 - p))) @ x + np.diag(light), slope)
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        if not kept or w[:-1].min() >= 0:
            weights = np.zeros(evidence.shape[1])
            weights[kept] = w[:-1]
            return weights, float(w[-1])
        del kept[int(w[:-1].argmin())]
