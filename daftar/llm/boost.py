"""Small models trained on the driver from bounded samples: gradient-boosted stumps and a logistic regression."""

from __future__ import annotations

import numpy as np


class BoostedStumps:
    """Gradient boosting of depth-one trees for the log loss."""

    def __init__(self, base: float, stumps: list[tuple[int, float, float, float]]):
        self.base, self.stumps = base, stumps

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, bins: int = 16) -> BoostedStumps:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        score, stumps = np.full(len(y), base), []
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            grad, curve = y - p, p * (1 - p)
            best = None
            for f, cuts in enumerate(edges):
                for cut in cuts:
                    right = x[:, f] > cut
                    gr, hr = grad[right].sum(), curve[right].sum()
                    gl, hl = grad.sum() - gr, curve.sum() - hr
                    gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
                    if best is None or gain > best[0]:
                        best = (gain, f, float(cut), rate * gl / (hl + 1), rate * gr / (hr + 1))
            if best is None or best[0] < 1e-6:
                break
            _, f, cut, low, high = best
            stumps.append((f, cut, low, high))
            score += np.where(x[:, f] > cut, high, low)
        return cls(base, stumps)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for f, cut, low, high in self.stumps:
            score += np.where(x[:, f] > cut, high, low)
        return 1 / (1 + np.exp(-score))


class Logistic:
    """Logistic regression by Newton steps with a small ridge."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 0.1) -> Logistic:
        x = np.hstack([x, np.ones((len(x), 1))])
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
            w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        return cls(w)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ self.weights, -30, 30)))
