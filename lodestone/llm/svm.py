"""Linear support vector machines on a bounded sample that fits the driver."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge SVM with balanced classes; y is 1 or
    -1. Accelerated gradient steps of the length that the largest curvature allows."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(12):  # power iteration
        v = x.T @ (share * (x @ v))
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = 1 / (1 + 2.2 * c * float(v @ (x.T @ (share * (x @ v)))))
    w = z = np.zeros(x.shape[1], x.dtype)
    y = y.astype(x.dtype)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        grad = z - 2 * c * (x.T @ (share * y * slack))
        grad[-1] -= z[-1]  # the bias is free
        after = z - step * grad
        z = after + i / (i + 3) * (after - w)
        w = after
    return w[:-1], float(w[-1])


def fit_small(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1e3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge SVM over few features, by Newton
    steps on the rows within the margin; weight is each row's, balanced here between the classes."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    share = weight * np.where(y > 0, 0.5 / max(1e-9, weight[y > 0].sum()), 0.5 / max(1e-9, weight[y < 0].sum()))
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6

    def cost(w: np.ndarray) -> float:
        return float(w @ ridge @ w / 2 + c * (share * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    now = cost(w)
    for _ in range(rounds):
        active = y * (x @ w) < 1
        part, s = x[active], share[active]
        target = np.linalg.solve(ridge + 2 * c * part.T @ (s[:, None] * part), 2 * c * part.T @ (s * y[active]))
        step = 1.0
        while step > 1e-4 and (after := cost(w + step * (target - w))) > now:
            step /= 2
        w = w + step * (target - w)
        if now - after < 1e-7 * now:
            break
        now = after
    return w[:-1], float(w[-1])


def calibrate(z: np.ndarray, y: np.ndarray, share: float = 0.5) -> tuple[float, float]:
    """a, b such that 1 / (1 + exp(-(a z + b))) fits labels 0 and 1, where `share` of all rows have label 1."""
    a, b = 1.0, 0.0
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        m = np.array([[np.sum(h * z * z) + 1, np.sum(h * z)], [np.sum(h * z), np.sum(h) + 1e-3]])
        da, db = np.linalg.solve(m, [np.sum(g * z) + a, np.sum(g)])
        scale = min(1.0, 2.0 / max(1e-9, abs(da), abs(db)))
        a, b = a - scale * da, b - scale * db
        if abs(da) + abs(db) < 1e-7:
            break
    return float(a), float(b)
