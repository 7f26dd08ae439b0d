"""Logistic classifiers of many small kinds at once, each trained on all folds but one, by sums over partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Newton steps, and how strongly weights are held towards nought.
STEPS, RIDGE = 8, 1e-2


def probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of class 1, by weights of which the last is the bias."""
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def _sums(held: dict, folds: int, n: int):
    """Gradient and curvature of each (kind, fold left out), summed within a task."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            kind, fold, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "fold", "y"))
            x = np.concatenate([batch.column("x").values.to_numpy().reshape(-1, n)[batch.column("x").offset :][: len(y)], np.ones((len(y), 1))], 1)
            for k in np.unique(kind):
                for f in range(folds):
                    rows = (kind == k) & (fold != f)
                    if not rows.any():
                        continue
                    p = probability(held.get((int(k), f), np.zeros(n + 1)), x[rows, :-1])
                    slope = x[rows].T @ (y[rows] - p)
                    bend = (x[rows] * (p * (1 - p))[:, None]).T @ x[rows]
                    total[int(k), f] = total.get((int(k), f), 0.0) + np.concatenate([slope, bend.ravel()])
        out = [(k, f, i, float(v)) for (k, f), sums in total.items() for i, v in enumerate(sums)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["kind", "fold", "i", "v"])

    return run


def train(rows: DataFrame, n: int, folds: int, steps: int = STEPS) -> dict[tuple[int, int], np.ndarray]:
    """Weights by (kind, fold left out) from rows (kind int, fold int, y double, x array<double> of n features).

    Each Newton step is one pass: tasks send sums of n + 1 slopes and their square of curvatures for each classifier, and
    the driver gets their totals alone. Features should be of the order of one. A kind without rows has no weights.
    """
    held: dict[tuple[int, int], np.ndarray] = {}
    for _ in range(steps):
        sums = rows.select("kind", "fold", "y", "x").mapInArrow(_sums(held, folds, n), "kind int, fold int, i int, v double").groupBy("kind", "fold", "i").agg(F.sum("v"))
        total: dict[tuple[int, int], np.ndarray] = {}
        for k, f, i, v in sums.collect():
            total.setdefault((k, f), np.zeros((n + 1) * (n + 2)))[i] = v
        for key, s in total.items():
            w = held.get(key, np.zeros(n + 1))
            slope, bend = s[: n + 1] - RIDGE * w, s[n + 1 :].reshape(n + 1, n + 1) + RIDGE * np.eye(n + 1)
            held[key] = w + np.linalg.solve(bend, slope)
    return held
