"""The detector contract: fit on (id, features), score as (id, score), higher is more anomalous; thresholds, labels, probabilities.

A detector's ``fit`` keeps what it learned as tables and small arrays and its training scores as a settled table. The
threshold is found when it is first asked for: the ``1 - contamination`` quantile of the training scores, or by
``threshold_method="pot"`` a generalised Pareto tail's. Labels are strict: score > threshold.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from oddlens.functions.ranks import quantile
from oddlens.sources.scratch import settle


def _erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf)


def erf(x: Column) -> Column:
    """The error function, which Spark lacks."""
    return F.pandas_udf(_erf, "double")(x)


class Detector:
    """Subclasses give ``_fit(train)`` and ``_score(rows)``; those whose training rows score in another way also ``_train_scores``."""

    def __init__(self, contamination: float = 0.1, threshold_method: str = "quantile", **params):
        if not 0 < contamination <= 0.5:
            raise ValueError("contamination must be in (0, 0.5]")
        if threshold_method not in ("quantile", "pot"):
            raise ValueError("threshold_method must be quantile or pot")
        self.threshold_method = threshold_method
        self.contamination, self.params = contamination, {**self.defaults(), **params}
        unknown = params.keys() - self.defaults().keys()
        if unknown:
            raise TypeError(f"unknown parameters: {sorted(unknown)}")
        for name, value in self.params.items():
            setattr(self, name, value)

    @classmethod
    def defaults(cls) -> dict:
        return {}

    def _fit(self, train: DataFrame) -> None:
        raise NotImplementedError

    def _score(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _train_scores(self, train: DataFrame) -> DataFrame:
        return self._score(train)

    def fit(self, train: DataFrame) -> Detector:
        """As ``learn``, with training scores."""
        self.learn(train)
        _ = self.train_scores
        return self

    def learn(self, train: DataFrame) -> Detector:
        """``train``: id, features. Training scores wait until they are asked for. Empty tables are refused; ids must be unique. Members of an ensemble share its table and ``searches``."""
        self.train = train if hasattr(train, "searches") else settle(train.select("id", F.col("features").cast("array<double>").alias("features")))
        first = self.train.first()
        if first is None:
            raise ValueError("no training rows")
        self.n_features = len(first.features)
        for name in ("train_scores", "threshold", "_facts"):
            self.__dict__.pop(name, None)
        self._fit(self.train)
        return self

    @cached_property
    def train_scores(self) -> DataFrame:
        """(id, score), settled; worked out when first asked for."""
        return settle(self._train_scores(self.train).select("id", F.col("score").cast("double").alias("score")))

    @cached_property
    def threshold(self) -> float:
        if self.threshold_method == "pot":
            from oddlens.operators.calibration import pot_threshold

            return pot_threshold(self.train_scores, self.contamination)[0]
        return quantile(self.train_scores, "score", 1 - self.contamination)

    @cached_property
    def _facts(self) -> Row:
        return self.train_scores.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).first()

    low, high, mean, sd = (property(lambda self, name=name: self._facts[name]) for name in ("low", "high", "mean", "sd"))

    def decision_function(self, rows: DataFrame) -> DataFrame:
        return self._score(rows.select("id", F.col("features").cast("array<double>").alias("features"))).select("id", F.col("score").cast("double").alias("score"))

    score_samples = decision_function

    def predict(self, rows: DataFrame) -> DataFrame:
        return label(self.decision_function(rows), self.threshold)

    def fit_predict(self, train: DataFrame) -> DataFrame:
        self.fit(train)
        return label(self.train_scores, self.threshold)

    def predict_proba(self, rows: DataFrame, method: str = "linear") -> DataFrame:
        """``linear``: clipped min-max by the training range, 0.5 if that is empty; ``unify``: by the error function."""
        return probability(self.decision_function(rows), method, self.low, self.high, self.mean, self.sd)

    def predict_confidence(self, rows: DataFrame) -> DataFrame:
        return confidence(label(self.decision_function(rows), self.threshold), self.threshold, self.low, self.high)

    def predict_with_rejection(self, rows: DataFrame, least: float, rejected: int = -2) -> DataFrame:
        """Labels of less confidence than ``least`` become ``rejected``."""
        sure = self.predict_confidence(rows)
        return sure.withColumn("label", F.when(F.col("confidence") < least, rejected).otherwise(F.col("label")))


def label(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.withColumn("label", (F.col("score") > threshold).cast("int"))


def probability(scores: DataFrame, method: str, low: float, high: float, mean: float, sd: float) -> DataFrame:
    s = F.col("score")
    if method == "linear":
        p = F.lit(0.5) if high <= low else F.least(F.greatest((s - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    elif method == "unify":
        p = F.lit(0.0) if not sd else F.greatest(erf((s - mean) / (sd * math.sqrt(2))), F.lit(0.0))
    else:
        raise ValueError(method)
    return scores.withColumn("probability", p)


def confidence(labels: DataFrame, threshold: float, low: float, high: float) -> DataFrame:
    """How far a score lies from the threshold, as a part of the training range on its side."""
    s = F.col("score")
    above = (s - threshold) / max(high - threshold, 1e-12)
    below = (threshold - s) / max(threshold - low, 1e-12)
    return labels.withColumn("confidence", F.least(F.greatest(F.when(s > threshold, above).otherwise(below), F.lit(0.0)), F.lit(1.0)))


def matrix(df: DataFrame, bound: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(ids, features) of a table of at most ``bound`` rows; larger ones are refused, not cut."""
    rows = df.limit(bound + 1).toPandas().sort_values("id", kind="stable")
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows for the driver")
    return rows["id"].to_numpy(), np.array(rows["features"].tolist(), float)
