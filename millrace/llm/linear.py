"""Small linear models for bounded samples: numpy only, deterministic."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 120, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halving steps, for smooth convex losses."""
    x = start.astype(np.float64)
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0) < 1e-5 * max(1.0, np.abs(x).max(initial=0)):
            break
        way, shares = grad.copy(), []
        for s, y, rho in reversed(past):
            shares.append(rho * (s @ way))
            way -= shares[-1] * y
        if past:
            s, y, _ = past[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.abs(grad).sum())
        for (s, y, rho), share in zip(past, reversed(shares)):
            way += s * (share - rho * (y @ way))
        slope, length = grad @ way, 1.0
        while True:
            new = x - length * way
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * length * slope or length < 1e-8:
                break
            length /= 2
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        if new_value >= value:
            break
        x, value, grad = new, new_value, new_grad
    return x


def _times(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The product in the matrix's own precision, so that no copy of it is made."""
    return (x @ v.astype(x.dtype)).astype(np.float64)


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, dtype=np.float64)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, moves: np.ndarray | None = None, move_penalty: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with a squared penalty.

    ``moves`` holds differences between the features of a row and of its altered copy; the
    square of the score change along each is charged at ``move_penalty``.
    """
    sign = np.where(y > 0, 1.0, -1.0)

    def loss(v):
        w, b = v[:-1], v[-1]
        z = sign * (_times(x, w) + b)
        pull = -sign * sigmoid(-z)
        total = np.logaddexp(0, -z).sum() + 0.5 * penalty * (w @ w)
        grad = _times(x.T, pull) + penalty * w
        if moves is not None and len(moves):
            change = moves @ w
            total += move_penalty * (change @ change)
            grad = grad + 2 * move_penalty * (moves.T @ change)
        return total, np.append(grad, pull.sum())

    v = minimise(loss, np.zeros(x.shape[1] + 1))
    return v[:-1], float(v[-1])


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss. Each
    class weighs the same, however many rows it has; ``weight`` parts that among its rows."""
    sign = np.where(y > 0, 1.0, -1.0)
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    one, other = weight[y > 0].sum(), weight[y <= 0].sum()
    share = weight * np.where(y > 0, n / (2 * one or 1), n / (2 * other or 1))

    def loss(v):
        w, b = v[:-1], v[-1]
        gap = np.maximum(0, 1 - sign * (_times(x, w) + b))
        pull = -2 * share * sign * gap
        return (share * gap * gap).sum() + 0.5 * penalty * (w @ w), np.append(_times(x.T, pull) + penalty * w, pull.sum())

    v = minimise(loss, np.zeros(x.shape[1] + 1))
    return v[:-1], float(v[-1])


def fit_platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities, with softened targets. ``weight``
    is what each row counts for."""
    weight = np.ones(len(y)) if weight is None else weight
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(v):
        z = v[0] * score + v[1]
        pull = weight * (sigmoid(z) - target)
        return (weight * (np.logaddexp(0, z) - target * z)).sum(), np.array([(pull * score).sum(), pull.sum()])

    if not pos or not neg:
        return 1.0, 0.0
    slope, shift = minimise(loss, np.array([1.0, 0.0]))
    return float(slope), float(shift)
