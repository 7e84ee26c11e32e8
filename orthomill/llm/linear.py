"""Small logistic models fitted with numpy on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton's method; the last coefficient is the intercept, which is hardly shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(shrink), x.T @ (weight * (y - p)) - shrink * beta)
        beta += step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def apply_dense(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


def fit_sparse(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float = 0.3, steps: int = 300, rate: float = 0.05, weight_of_ones: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights of 0/1 features scaled by ``scale``, by full-batch Adam; (scaled weights, intercept)."""
    size = np.array([len(r) for r in rows])
    column = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    prior = (y.sum() + 1) / (len(y) + 2)
    w, b = np.zeros(len(scale)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    weight = np.where(y == 1, weight_of_ones, 1.0)
    for t in range(1, steps + 1):
        score = np.bincount(owner, (w * scale)[column], len(rows)) + b
        error = weight * (sigmoid(score) - y)
        grad = np.append(np.bincount(column, error[owner], len(scale)) * scale + ridge * w, error.sum()) / max(1, len(rows))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * scale, float(b)
