"""Detectors made of detectors: ensembles, bagging, SUOD, LSCP, standardised scores."""

from __future__ import annotations

from collections import Counter
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.operators.base import Detector
from oddlens.operators.calibration import ScoreStandardizer, combine, significant
from oddlens.operators.neighbours import nearest, searched, voted
from oddlens.operators.registry import create_model, register_model
from oddlens.sources.scratch import settle


class _Members(Detector):
    def _specs(self) -> list:
        raise NotImplementedError

    def _fit(self, train):
        self.members = [create_model(s, contamination=self.contamination).fit(train) for s in self._specs()]

    def _all(self, rows: DataFrame | None) -> list[DataFrame]:
        return [m.train_scores if rows is None else m.decision_function(rows) for m in self.members]

    def _joined(self, scores: list[DataFrame]) -> DataFrame:
        raise NotImplementedError

    def _train_scores(self, train):
        return self._joined(self._all(None))

    def _score(self, rows):
        rows = settle(rows)
        return self._joined(self._all(rows))


@register_model("core_score_ensemble", "classical", "core", "ensemble")
class ScoreEnsemble(_Members):
    """Ranks or scores of several detectors, combined over the scored batch; labels are score >= threshold.

    Scores are taken to 12 digits: ranks of equal scores go by id, not by the order in which tasks added them up.
    """

    @classmethod
    def defaults(cls):
        return {"detectors": ("core_ecod", "core_hbos", "core_mad"), "combine": "mean_rank", "weights": None, "trim_fraction": 0.1}

    def _specs(self):
        return list(self.detectors)

    def _joined(self, scores):
        scores = [x.select("id", significant(F.col("score")).alias("score")) for x in scores]
        return combine(scores, self.combine, self.weights, self.trim_fraction)

    def predict(self, rows):
        return self.decision_function(rows).withColumn("label", (F.col("score") >= self.threshold).cast("int"))


@register_model("core_suod", "classical", "core", "ensemble")
@register_model("core_suod_spec", "classical", "core", "ensemble")
class SUOD(_Members):
    """z-scores of the members' scores by their training scores, averaged or their maximum."""

    @classmethod
    def defaults(cls):
        return {"base_estimators": ("core_lof", "core_hbos", "core_ecod"), "base_estimator_specs": None, "combination": "average", "standardize": "zscore", "random_state": 0}

    def _specs(self):
        return list(self.base_estimator_specs or self.base_estimators)

    def _joined(self, scores):
        z = [s.select("id", ((F.col("score") - m.mean) / ((m.sd or 0.0) + 1e-12)).alias("score")) for s, m in zip(scores, self.members, strict=True)]
        return combine(z, "max" if self.combination in ("max", "maximization") else "mean")


@register_model("core_feature_bagging", "classical", "core", "ensemble")
@register_model("core_feature_bagging_spec", "classical", "core", "ensemble")
class FeatureBagging(Detector):
    """A detector on seeded random subsets of the features."""

    @classmethod
    def defaults(cls):
        return {"n_estimators": 10, "max_features": 1.0, "bootstrap_features": False, "random_state": 0, "combination": "average", "base_estimator_spec": "core_lof"}

    def _part(self, rows, columns):
        return rows.select("id", F.array(*(F.get("features", F.lit(int(c))) for c in columns)).alias("features"))

    def _fit(self, train):
        draw, d = np.random.default_rng(self.random_state or 0), self.n_features
        most = max(1, int(self.max_features * d) if self.max_features <= 1 else int(self.max_features))
        self.columns, self.members = [], []
        for _ in range(self.n_estimators):
            size = int(draw.integers(min(most, max(1, d // 2)), most + 1))
            columns = np.sort(draw.choice(d, size, replace=self.bootstrap_features))
            self.columns.append(columns)
            self.members.append(create_model(self.base_estimator_spec, contamination=self.contamination).fit(self._part(train, columns)))

    def _joined(self, scores):
        return combine(scores, "max" if self.combination == "max" else "mean")

    def _train_scores(self, train):
        return self._joined([m.train_scores for m in self.members])

    def _score(self, rows):
        rows = settle(rows)
        return self._joined([m.decision_function(self._part(rows, c)) for m, c in zip(self.members, self.columns, strict=True)])


def drawn_parts(d: int, times: int, least: float, most: float, seed: int) -> dict[tuple[int, ...], int]:
    """Seeded subsets of d features, of between ``least`` and ``most`` of them, and how often each was drawn."""
    draw, low = np.random.default_rng(seed), max(1, int(d * least))
    high = min(max(low, int(np.ceil(d * most))), d)
    drawn = [draw.choice(d, int(draw.integers(low, high + 1)), replace=False) for _ in range(times)]
    return dict(Counter(tuple(sorted(c.tolist())) for c in drawn))


def competent(r: np.ndarray, n_bins: int) -> np.ndarray:
    """Which members are averaged: those in the fullest bin of their correlations, the lowest of equally full ones; where all are alike, the first."""
    if np.allclose(r, r[0], rtol=1e-12, atol=1e-12):
        return np.array([int(r.argmax())])
    held, borders = np.histogram(r, bins=max(1, min(n_bins, len(r))))
    full = int(held.argmax())
    return np.flatnonzero((r >= borders[full]) & (r <= borders[full + 1]))


def _selected(batches, n_bins: int):
    for pdf in batches:
        scores = [np.asarray(z)[competent(np.asarray(r), n_bins)].mean() for r, z in zip(pdf["r"], pdf["z"], strict=True)]
        yield pd.DataFrame({"id": pdf["id"], "score": np.array(scores, float)})


@register_model("core_lscp", "classical", "core", "ensemble")
@register_model("core_lscp_spec", "classical", "core", "ensemble")
class LSCP(_Members):
    """In each row's local region, members are chosen by how they go with the pseudo-truth (the largest z-score) and averaged.

    The region is voted for: training rows that are among the row's nearest by more than half of
    ``local_region_iterations`` random subsets of the features; with fewer than two of these, those with the next most votes
    are taken, down to two. Training rows don't vote for themselves. Members in the fullest bin of the correlations are averaged.
    """

    @classmethod
    def defaults(cls):
        found = {"detector_specs": ("core_lof", "core_knn", "core_hbos"), "local_region_size": 30, "n_bins": 10, "random_state": 0}
        return found | {"local_max_features": 1.0, "local_region_iterations": 20, "local_min_features": 0.5}

    def _specs(self):
        return list(self.detector_specs)

    def _fit(self, train):
        train.searches = {}
        self.k = min(self.local_region_size, max(2, train.count() - 1))
        self.parts = drawn_parts(self.n_features, self.local_region_iterations, self.local_min_features, self.local_max_features, self.random_state or 0)
        searched(train, self.k, self.n_features)  # members with fewer neighbours take them from this one, as do drawn subsets of all features
        super()._fit(train)
        self.bank_scores = settle(self._z(self._all(None)).withColumn("truth", F.array_max("z")))
        self.everywhere = self.bank_scores.agg(self._fits()).first()[0]

    def _z(self, scores):
        """(id, z): the members' z-scores."""
        parts = [s.select("id", F.lit(k).alias("k"), ((F.col("score") - m.mean) / ((m.sd or 0.0) + 1e-12)).alias("z")) for k, (s, m) in enumerate(zip(scores, self.members, strict=True))]
        each = reduce(DataFrame.union, parts).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "z"))).alias("of"))
        return each.select("id", F.transform("of", lambda v: v["z"]).alias("z"))

    def _fits(self):
        """The members' correlations with the truth; 0 where one of the two is constant."""
        z = [F.get("z", F.lit(k)) for k in range(len(self.members))]
        return F.array(*(F.when(F.stddev_pop(v) * F.stddev_pop("truth") > 0, F.covar_pop(v, "truth") / F.nullif(F.stddev_pop(v) * F.stddev_pop("truth"), F.lit(0.0))).otherwise(0.0) for v in z))

    def _votes(self, rows, alone):
        whole = tuple(range(self.n_features))
        some = {c: times for c, times in self.parts.items() if c != whole}
        found = [voted(self.train if alone else rows, self.train, self.k, self.n_features, some, alone)] if some else []
        if whole in self.parts:
            edges = searched(self.train, self.k, self.n_features) if alone else nearest(rows, self.train, self.k, self.n_features, False)
            found.append(edges.select("id", "other", F.lit(self.parts[whole]).cast("long").alias("votes")))
        return found[0] if len(found) == 1 else settle(reduce(DataFrame.union, found).groupBy("id", "other").agg(F.sum("votes").alias("votes")))

    def _regions(self, rows, alone):
        """(id, other)"""
        each = self._votes(rows, alone).groupBy("id").agg(F.collect_list(F.struct("votes", "other")).alias("v"))
        second = F.get(F.sort_array(F.transform("v", lambda v: v["votes"]), False), F.lit(1))
        least = F.least(F.lit(self.local_region_iterations // 2 + 1), second)
        region = F.filter("v", lambda v: v["votes"] >= least)
        return each.where(second.isNotNull()).select("id", F.explode(F.transform(region, lambda v: v["other"])).alias("other"))

    def _local(self, rows, scores, alone):
        fit = self._regions(rows, alone).join(self.bank_scores.withColumnRenamed("id", "other"), "other").groupBy("id").agg(self._fits().alias("r"))
        both = scores.join(fit, "id", "left").select("id", "z", F.coalesce("r", F.array(*(F.lit(v) for v in self.everywhere))).alias("r"))
        return both.mapInPandas(partial(_selected, n_bins=self.n_bins), f"id {rows.schema['id'].dataType.simpleString()}, score double")

    def _train_scores(self, train):
        return self._local(train, self.bank_scores.select("id", "z"), True)

    def _score(self, rows):
        rows = settle(rows)
        return self._local(rows, self._z(self._all(rows)), False)


@register_model("core_score_standardizer", "classical", "core", "ensemble")
class StandardizedScores(Detector):
    """Any detector's scores, standardised by its training scores."""

    @classmethod
    def defaults(cls):
        return {"base_detector": "core_knn", "base_kwargs": None, "method": "rank", "eps": 1e-12}

    def _base(self):
        return create_model({"name": self.base_detector, "kwargs": self.base_kwargs or {}} if isinstance(self.base_detector, str) else self.base_detector)

    def _fit(self, train):
        self.base = self._base().fit(train)
        self.scale = ScoreStandardizer(self.method, self.eps).fit(self.base.train_scores)

    def _train_scores(self, train):
        return self.scale.transform(self.base.train_scores)

    def _score(self, rows):
        return self.scale.transform(self.base.decision_function(rows))


@register_model("core_knn_cosine_calibrated", "classical", "core", "neighbors")
class KNNCosineCalibrated(StandardizedScores):
    """core_knn_cosine with standardised scores."""

    @classmethod
    def defaults(cls):
        return {"n_neighbors": 5, "knn_method": "largest", "normalize": True, "method": "rank", "eps": 1e-12}

    def _base(self):
        return create_model("core_knn_cosine", n_neighbors=self.n_neighbors, method=self.knn_method, normalize=self.normalize)
