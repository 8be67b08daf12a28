"""Bounded samples of labelled rows and a small logistic regression, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import remainder


def sample(labels: DataFrame, id_col: str, label_col: str, divisor: int, held: int, most: int, by_class: bool) -> list[tuple[int, int]]:
    """(id, label) of at most `most` labelled rows (of each class, if by_class) that aren't held out, in hash order.

    Null identifiers and labels don't count; of an identifier's several labels the largest does.
    """
    rows = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .where(remainder(F.col("id"), divisor) != held)
    )
    turn = F.xxhash64("id")
    parts = [rows.where("y = 1"), rows.where("y = 0")] if by_class else [rows]
    return [(r["id"], r["y"]) for p in parts for r in p.orderBy(turn, "id").limit(most).collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the constant first) by Newton's method, with a quadratic penalty on all but the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.diag([1e-3] + [penalty] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = chance(x[:, 1:], w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -500, 500)))
