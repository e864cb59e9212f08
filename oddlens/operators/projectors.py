"""Transformers of feature rows (id, features): standard scaling and projection on principal components, as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.functions.vectors import constants, dot
from oddlens.operators.linear import moments


class StandardScaler:
    """Mean 0 and population deviation 1 by feature; constant features are only moved."""

    def __init__(self, with_mean: bool = True, with_std: bool = True):
        self.with_mean, self.with_std = with_mean, with_std

    def fit(self, rows: DataFrame) -> StandardScaler:
        _, mean, cov = moments(rows)
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        self.mean = mean if self.with_mean else np.zeros_like(mean)
        self.scale = np.where(sd > 1e-12 * np.maximum(np.abs(mean), 1), sd, 1.0) if self.with_std else np.ones_like(sd)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        moved = F.zip_with("features", constants(self.mean), lambda x, m: x - m)
        return rows.withColumn("features", F.zip_with(moved, constants(self.scale), lambda x, s: x / s))


class PCAProjector:
    """Principal components of all rows: the first ``n_components`` (or those that hold a part of the variance), whitened on request.

    Of each axis the largest loading is positive (of equal ones the first), so signs don't depend on the solver.
    """

    def __init__(self, n_components: int | float | None = None, whiten: bool = False):
        self.n_components, self.whiten = n_components, whiten

    def fit(self, rows: DataFrame) -> PCAProjector:
        n, self.mean, cov = moments(rows)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1].T
        k = self.n_components
        if k is None:
            k = min(n, len(values))
        elif 0 < k < 1:
            k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), k) + 1)
        self.values, self.explained = values[: int(k)], (values / max(values.sum(), 1e-300))[: int(k)]
        lead = np.abs(vectors).round(12).argmax(1)
        self.axes = (vectors * np.sign(vectors[np.arange(len(vectors)), lead])[:, None])[: int(k)]
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        scale = np.sqrt(np.where(self.values > 0, self.values, 1)) if self.whiten else np.ones(len(self.values))
        moved = F.zip_with("features", constants(self.mean), lambda x, m: x - m)
        placed = rows.withColumn("__moved", moved)
        return placed.withColumn("features", F.array(*(dot(F.col("__moved"), constants(a / s)) for a, s in zip(self.axes, scale, strict=True)))).drop("__moved")
