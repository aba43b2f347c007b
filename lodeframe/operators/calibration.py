"""A calibration head: linear quantiles of an outcome given confidence, retrieval strength and spread, fitted by aggregates of a fixed size.

The pinball loss is majorised by squares at the present residuals, so each step is a weighted least squares whose normal equations are sums over the
rows: (features + 1) squared numbers for each quantile, whatever the input. All quantiles share a pass. The losses of steps never rise but for smoothing,
which shrinks with the step. Offsets from a part of the rows that the fit didn't see (split conformal) bring the coverage of an interval to its level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, RIDGE = 30, 1e-6  # where the fit meets a row exactly, its distance shrinks by a tenth with each step


@dataclass(frozen=True)
class Head:
    """Linear quantiles in standardised features, and what each bound is moved by."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: dict[float, tuple[float, ...]]
    offset: float = 0.0

    def standard(self) -> list[Column]:
        return [F.lit(1.0)] + [(F.col(f).cast("double") - m) / s for f, m, s in zip(self.features, self.mean, self.scale, strict=True)]

    def quantile(self, tau: float) -> Column:
        return sum((F.lit(w) * x for w, x in zip(self.weights[tau], self.standard(), strict=True)), F.lit(0.0))

    def interval(self) -> tuple[Column, Column]:
        """The bounds of the interval, in order also where the quantiles cross."""
        low, high = self.quantile(min(self.weights)) - self.offset, self.quantile(max(self.weights)) + self.offset
        return F.least(low, high), F.greatest(low, high)


def _usable(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all numbers; nulls, NaN and infinities teach nothing."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf"))
    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        numbers = numbers.filter(finite(c))
    return numbers


def fit(rows: DataFrame, features: list[str], outcome: str, taus: tuple[float, ...] = (0.05, 0.95), steps: int = STEPS) -> Head:
    """The quantiles taus of outcome as linear functions of the features. A feature that never varies gets no weight; without rows all weights are 0."""
    rows = _usable(rows, [*features, outcome]).persist()
    try:
        first = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("y"), F.stddev_pop(outcome).alias("s"), *[F.avg(f).alias(f"m_{k}") for k, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s_{k}") for k, f in enumerate(features)]).first()
        k = len(features) + 1
        if not first["n"]:
            return Head(tuple(features), (0.0,) * (k - 1), (1.0,) * (k - 1), {t: (0.0,) * k for t in taus})
        mean, spread = [first[f"m_{i}"] for i in range(k - 1)], [first[f"s_{i}"] or 1.0 for i in range(k - 1)]
        head = Head(tuple(features), tuple(mean), tuple(spread), {t: (first["y"], *[0.0] * (k - 1)) for t in taus})
        unit = first["s"] or 1.0
        for step in range(steps):
            least = unit * max(1e-4, 0.5 ** (step / 2))
            x, y = head.standard(), F.col(outcome)
            sums = []
            for t in taus:
                off = y - head.quantile(t)
                # |r| / 2 + (t - 1/2) r is met from above by a square of r at the present one
                weight = 0.5 / F.greatest(F.abs(off), F.lit(least))
                sums += [F.sum(weight * x[i] * x[j]) for i in range(k) for j in range(i, k)] + [F.sum((weight * y + (t - 0.5)) * x[i]) for i in range(k)]
            found = np.array(rows.agg(*[s.alias(f"a{i}") for i, s in enumerate(sums)]).first(), float).reshape(len(taus), -1)
            weights = {}
            for t, row in zip(taus, found, strict=True):
                a = np.zeros((k, k))
                a[np.triu_indices(k)] = row[: k * (k + 1) // 2]
                a = a + np.triu(a, 1).T
                weights[t] = tuple(np.linalg.solve(a + RIDGE * np.trace(a) / k * np.eye(k), row[k * (k + 1) // 2 :]).tolist())
            head = Head(head.features, head.mean, head.scale, weights)
        return head
    finally:
        rows.unpersist()


def conformal(head: Head, rows: DataFrame, outcome: str, level: float = 0.9) -> Head:
    """The head with bounds moved alike, so that level of these rows, which the fit didn't see, lie within; no row leaves it as it is."""
    low, high = head.interval()
    beyond = F.greatest(low - F.col(outcome), F.col(outcome) - high)
    seen = _usable(rows, [*head.features, outcome])
    offset = seen.agg(F.percentile_approx(beyond, level, 10_000)).first()[0]
    return Head(head.features, head.mean, head.scale, head.weights, float(offset or 0.0))


def pinball(outcome: Column, quantile: Column, tau: float) -> Column:
    off = outcome - quantile
    return F.greatest(tau * off, (tau - 1) * off)
