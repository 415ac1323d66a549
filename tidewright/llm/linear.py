"""Small fits on the driver: ordered logistic regression on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """Cumulative-link model: P(grade >= k) = sigmoid(w.x - threshold_k), with one w and ordered thresholds.

    Rows are sparse: (row, column, value) triples. Fitted by full-batch Adam on the penalised likelihood,
    from zero weights, so equal inputs give equal models."""

    def __init__(self, dims: int, grades: int, l2: float = 1e-3, steps: int = 400, rate: float = 0.05):
        self.dims, self.grades, self.l2, self.steps, self.rate = dims, grades, l2, steps, rate
        self.weights, self.thresholds = np.zeros(dims), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1)

    def latent(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=self.weights[col] * value, minlength=n)

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """n x (grades - 1): P(grade >= k) for k from 1."""
        return sigmoid(latent[:, None] - self.thresholds[None, :])

    def fit(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> Ordinal:
        n, k = len(grade), self.grades - 1
        if not n:
            return self
        weight = weight / weight.sum()
        # Thresholds are the first one and positive steps up from it, kept positive by exp.
        share = np.array([np.average(grade >= g, weights=weight) for g in range(1, self.grades)]).clip(1e-3, 1 - 1e-3)
        start = -np.log(share / (1 - share))
        gaps = np.log(np.maximum(np.diff(start), 1e-2))
        params = np.concatenate([self.weights, start[:1], gaps])
        m, v = np.zeros_like(params), np.zeros_like(params)
        index = np.arange(n)
        for t in range(1, self.steps + 1):
            w, steps = params[: self.dims], np.exp(params[self.dims + 1 :])
            theta = params[self.dims] + np.concatenate([[0.0], np.cumsum(steps)])
            latent = np.bincount(row, weights=w[col] * value, minlength=n)
            upper = np.concatenate([np.ones((n, 1)), sigmoid(latent[:, None] - theta), np.zeros((n, 1))], axis=1)
            p = np.maximum(upper[index, grade] - upper[index, grade + 1], 1e-12)
            slope = upper * (1 - upper)
            d_latent = -weight * (slope[index, grade] - slope[index, grade + 1]) / p
            d_theta = np.zeros(k)
            for j in range(k):  # threshold j bounds grade j from above and j + 1 from below
                s = slope[:, j + 1]
                d_theta[j] = (weight * ((grade == j + 1) * s - (grade == j) * s) / p).sum()
            d_steps = np.cumsum(d_theta[::-1])[::-1][1:] * steps
            g = np.concatenate([np.bincount(col, weights=d_latent[row] * value, minlength=self.dims) + self.l2 * w, [d_theta.sum()], d_steps])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params = params - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.weights = params[: self.dims]
        self.thresholds = params[self.dims] + np.concatenate([[0.0], np.cumsum(np.exp(params[self.dims + 1 :]))])
        return self
