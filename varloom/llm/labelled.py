"""Label handling and small fits shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def training_labels(labels: DataFrame, id_col: str, label_col: str, folds: int, held: int) -> DataFrame:
    """(key, y) of labelled rows outside the held-out fold; the larger label wins a tie."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).filter(fold(id_col, folds) != held)
    return rows.groupBy(F.col(id_col).alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("y"))


def bounded(labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled rows, in the order of a hash of their key."""
    return labels.orderBy(F.xxhash64("key"), "key").limit(rows)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression, by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (p - y) + penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        d = np.linalg.solve(h, g)
        w = w - d
        if np.abs(d).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
