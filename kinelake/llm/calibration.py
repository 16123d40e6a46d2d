"""Scores as probabilities, from logits of labelled rows that a model was not fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(z: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Platt's scale and shift for logits, with his smoothed targets.

    Logits are brought to unit spread first, and a Newton step that does not
    lower the loss is halved, so that a separable sample cannot turn the scale
    over; the scale is positive always.
    """
    centre, spread = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - centre) / spread, np.ones_like(z)])
    target = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))

    def loss(w: np.ndarray) -> float:
        v = w @ x
        return float((np.logaddexp(0, v) - target * v).sum() + 5e-3 * w @ w)

    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * p * (1 - p)) @ x.T + 1e-2 * np.eye(2), x @ (p - target) + 1e-2 * w)
        while np.abs(step).max() > 1e-9 and not (loss(w - step) < loss(w) and w[0] - step[0] > 0):
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w - step
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def calibrate_rows(rows: DataFrame) -> tuple[float, float]:
    """Platt's scale and shift as ``calibrate`` has them, from a table (y, weight, z) of any size: only sums reach the driver.

    They are rounded to six digits, as sums of doubles depend on their order.
    """
    y, weight = F.col("y"), F.col("weight")
    z = F.col("z").cast("double")
    some = rows.agg(F.sum(weight), F.sum(weight * y), F.sum(weight * z), F.sum(weight * z * z)).first()
    n, positive, centre = some[0], some[1], some[2] / some[0]
    spread = max(some[3] / n - centre * centre, 0.0) ** 0.5 or 1.0
    target = F.when(y == 1, (positive + 1) / (positive + 2)).otherwise(1 / (n - positive + 2))

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian."""
        x = (z - centre) / spread
        v = x * float(w[0]) + float(w[1])
        p = 1 / (1 + F.exp(-F.least(F.greatest(v, F.lit(-30.0)), F.lit(30.0))))
        loss = F.log1p(F.exp(-F.abs(v))) + F.greatest(v, F.lit(0.0)) - target * v
        terms = (loss, (p - target) * x, p - target, p * (1 - p) * x * x, p * (1 - p) * x, p * (1 - p))
        s = rows.agg(*(F.sum(weight * term) for term in terms)).first()
        return s[0] + 5e-3 * float(w @ w), np.array(s[1:3]) + 1e-2 * w, np.array([[s[3], s[4]], [s[4], s[5]]]) + 1e-2 * np.eye(2)

    w = np.array([1.0, 0.0])
    loss, slope, bend = at(w)
    for _ in range(50):
        step = np.linalg.solve(bend, slope)
        while np.abs(step).max() > 1e-6:
            if w[0] - step[0] > 0:
                new = at(w - step)
                if new[0] < loss:
                    break
            step = step / 2
        if np.abs(step).max() <= 1e-6:
            break
        w, (loss, slope, bend) = w - step, new
    return float(f"{w[0] / spread:.6g}"), float(f"{w[1] - w[0] * centre / spread:.6g}")
