"""Logistic regression on few features of a bounded number of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_of(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows if they are at most ``bound``, else about so many, by a hash of the key."""
    share = bound / max(rows.count(), bound)
    if share == 1:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(1_000_000 * share))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50
) -> np.ndarray:
    """Intercept and weights by Newton's method; the intercept is not shrunk.

    Without rows, or with labels of one kind, the intercept is the smoothed log odds.
    """
    x = np.hstack([np.ones((len(x), 1)), x])
    odds = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    beta = np.zeros(x.shape[1])
    beta[0] = odds
    if not 0 < y.sum() < len(y):
        return beta
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-6)
        slope = x.T @ (y - p) - shrink * beta
        curve = (x * weight[:, None]).T @ x + np.diag(shrink)
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    return beta
