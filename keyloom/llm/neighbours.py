"""Votes of nearest labelled examples and their calibration, for bounded samples."""

from __future__ import annotations

import numpy as np


def votes(similar: np.ndarray, label: np.ndarray, prior: float) -> np.ndarray:
    """Share of label 1 among neighbours weighted by squared similarity; an anchor of the prior stands in for a weak one."""
    weight = np.maximum(similar, 0) ** 2
    return ((weight * label).sum(axis=1) + ANCHOR * prior) / (weight.sum(axis=1) + ANCHOR)


#: Weight of the prior beside the neighbours' weights, each at most 1.
ANCHOR = 0.05


class Calibration:
    """Logistic map from votes to probabilities, fitted on leave-one-out votes weighted to the true class shares."""

    def __init__(self, vote: np.ndarray, label: np.ndarray, share: tuple[float, float]):
        self.a, self.b = 1.0, 0.0
        if len(np.unique(label)) < 2:
            self.constant = share[1]
            return
        self.constant = None
        weight = np.where(label == 1, share[1] / (label == 1).mean(), share[0] / (label == 0).mean())
        # a little smoothing of the targets, as for any logistic fit of votes
        ones, zeros = (label == 1).sum(), (label == 0).sum()
        target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        x = np.stack([_logit(vote), np.ones(len(vote))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - target)) + 1e-3 * (w - [1.0, 0.0])
            h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.a, self.b = float(max(w[0], 1e-3)), float(w[1])

    def __call__(self, vote: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(vote), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.a * _logit(vote) + self.b, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))
