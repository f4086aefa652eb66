"""Samples of labelled rows, and small solvers, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

FOLDS = 5


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo 5; rows of fold 0 are held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y (0/1) of labels that may be learnt from: known, without contradiction, not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return known.where(fold() != 0).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")


def sample_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids, those of the least hashes: the bound of a training sample."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Primal L2 support vector machine by Newton steps; the last coordinate of ``x`` is the bias."""
    d = x.shape[1]
    w = np.zeros(d)
    keep = np.full(d, ridge)
    keep[-1] = 1e-6
    loss = None
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        on = margin > 0
        xo, wo = x[on], weight[on]
        gradient = keep * w - xo.T @ (wo * y[on] * margin[on])
        step = np.linalg.solve(np.diag(keep) + (xo * wo[:, None]).T @ xo, gradient)
        size = 1.0
        for _ in range(12):
            new = w - size * step
            m = np.maximum(0, 1 - y * (x @ new))
            value = 0.5 * (keep * new * new).sum() + 0.5 * (weight * m * m).sum()
            if loss is None or value <= loss + 1e-12:
                break
            size /= 2
        if loss is not None and loss - value < 1e-7 * max(1.0, abs(loss)):
            w = new
            break
        w, loss = new, value
    return w


def platt(f: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of P(y = 1) = sigmoid(a f + b), with Platt's smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([f, np.ones_like(f)], 1)
    w = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])
