"""Small classifiers fitted inside one group: many independent models in one Spark job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def scaled(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Columns centred and scaled by the train rows' mean and population deviation (0 -> 1)."""
    mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
    return (x - mean) / np.where(sd == 0, 1.0, sd)


def logistic_weights(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton steps for a small L2 logistic fit; the last weight is the (free) intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], 1.0 / c)
    penalty[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x.T * np.maximum(p * (1 - p), 1e-9)) @ x + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, seed: int = 0, c: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """L2 logistic regression -> a function from rows to probabilities."""
    w = logistic_weights(x, y, c)
    return lambda rows: 1.0 / (1.0 + np.exp(-np.clip(rows @ w[:-1] + w[-1], -30, 30)))


def perceptron(
    x: np.ndarray,
    y: np.ndarray,
    seed: int = 0,
    hidden: Sequence[int] = (50, 20),
    alpha: float = 1e-4,
    rate: float = 1e-3,
    epochs: int = 1000,
    patience: int = 10,
    held_out: float = 0.1,
) -> Callable[[np.ndarray], np.ndarray]:
    """Rectified layers with an L2 term, fitted by Adam in batches of 200 and stopped early.

    A tenth of the rows is held out; the weights of its best accuracy are kept, and ``patience`` epochs that do not beat it by 1e-4
    end the fit. With under ten rows nothing is held out and all epochs run.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(x))
    cut = int(len(x) * held_out)
    check, fit = order[:cut], order[cut:]
    sizes = [x.shape[1], *hidden, 1]
    weights = [rng.uniform(-1, 1, (a, b)) * np.sqrt(6.0 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    weights += [np.zeros(b) for b in sizes[1:]]
    depth = len(sizes) - 1
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]

    def layers(rows: np.ndarray, w: list[np.ndarray]) -> list[np.ndarray]:
        out = [rows]
        for i in range(depth):
            z = out[-1] @ w[i] + w[depth + i]
            out.append(np.maximum(z, 0) if i < depth - 1 else 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))
        return out

    best, kept, waited, step = -1.0, [w.copy() for w in weights], 0, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // 200))):
            out = layers(x[rows], weights)
            slope = (out[-1] - y[rows, None]) / max(len(rows), 1)
            gradients: list[np.ndarray] = [np.zeros(0)] * (2 * depth)
            for i in reversed(range(depth)):
                gradients[i] = out[i].T @ slope + alpha / max(len(rows), 1) * weights[i]
                gradients[depth + i] = slope.sum(axis=0)
                slope = slope @ weights[i].T * (out[i] > 0)
            step += 1
            for w, g, (m, v) in zip(weights, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if not cut:
            continue
        right = float(((layers(x[check], weights)[-1][:, 0] > 0.5) == (y[check] == 1)).mean())
        waited = 0 if right > best + 1e-4 else waited + 1
        if right > best:
            best, kept = right, [w.copy() for w in weights]
        if waited >= patience:
            break
    final = kept if cut else weights
    return lambda rows: layers(rows, final)[-1][:, 0]


FITS = {"logreg": logistic, "mlp": perceptron}
