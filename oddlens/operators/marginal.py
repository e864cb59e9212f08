"""Detectors that look at each feature by itself: empirical tails, histograms, robust z-scores, distance to the mean.

Tails and medians come from running counts of distinct values. These are range-partitioned by (feature, value): every
partition counts its own part and gets the total before it from a table of one row for each partition and feature, so
no feature passes through a single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddlens.functions.ranks import quantiles_by, running_counts
from oddlens.functions.vectors import constants, melt, row_distance, total
from oddlens.operators.base import Detector
from oddlens.operators.registry import register_model
from oddlens.sources.scratch import settle


def skewness_sign(moments: Column) -> Column:
    """Sign of the population skewness, 0 for a constant feature or one that is symmetric but for rounding."""
    return F.when(moments.isNull() | F.isnan(moments) | (F.abs(moments) < 1e-12), 0).otherwise(F.signum(moments))


FEW = 2000  # distinct values of a feature up to which its tails are broadcast (training values; asked ones are joined by them)


class _Tails(Detector):
    @classmethod
    def defaults(cls):
        return {"eps": 1e-12}

    def _fit(self, train):
        long = melt(train)
        self.counts = settle(long.groupBy("j", "v").agg(F.count("*").alias("n")))
        self.facts = long.groupBy("j").agg(F.count("*").alias("total"), skewness_sign(F.skewness("v")).alias("sign"))

    def _combine(self, left: Column, right: Column, sign: Column) -> Column:
        raise NotImplementedError

    def _train_scores(self, train):
        return self._by_tails(melt(train), self.counts)

    def _score(self, rows):
        long = melt(rows)
        asked = long.select("j", "v", F.lit(0).cast("long").alias("n")).distinct()
        return self._by_tails(long, self.counts.union(asked).groupBy("j", "v").agg(F.sum("n").alias("n")))

    def _by_tails(self, long, counts):
        upto = running_counts(counts)
        floor = lambda p: F.greatest(p, F.lit(self.eps))
        left = -F.log(floor(F.col("upto") / F.col("total")))
        right = -F.log(floor((F.col("total") - F.col("upto") + F.col("n")) / F.col("total")))
        by_value = upto.join(F.broadcast(self.facts), "j").select("j", "v", self._combine(left, right, F.col("sign")).alias("part"))
        # Values of features that have few of them are hot keys, so these are joined by broadcast.
        sizes = {r.j: r.n for r in self.counts.groupBy("j").agg(F.count("*").alias("n")).collect()}
        few = [j for j, n in sizes.items() if n <= FEW]
        if few:
            by_value = settle(by_value)
            hot = long.where(F.col("j").isin(few)).join(F.broadcast(by_value.where(F.col("j").isin(few))), ["j", "v"], "left")
            rest = long.where(~F.col("j").isin(few)).join(by_value.where(~F.col("j").isin(few)), ["j", "v"])
            return hot.select("id", F.col("part")).union(rest.select("id", "part")).groupBy("id").agg(F.sum("part").alias("score"))
        return long.join(by_value, ["j", "v"]).groupBy("id").agg(F.sum("part").alias("score"))


@register_model("core_ecod", "classical", "core")
class ECOD(_Tails):
    """Sum over features of the largest of the tail on the skewed side, the left and the right tail."""

    def _combine(self, left, right, sign):
        skewed = F.when(sign > 0, right).when(sign < 0, left).otherwise(left + right)
        return F.greatest(skewed, left, right)


@register_model("core_copod", "classical", "core")
class COPOD(_Tails):
    """Sum over features of the larger of the skewed tail and the mean of both tails."""

    def _combine(self, left, right, sign):
        skewed = F.when(sign > 0, right).when(sign < 0, left).otherwise(left + right)
        return F.greatest(skewed, (left + right) / 2)


@register_model("core_hbos", "classical", "core")
class HBOS(Detector):
    """Histograms of equal width; values outside fall in the first or last bin. Scoring needs no shuffle."""

    @classmethod
    def defaults(cls):
        return {"n_bins": 10, "alpha": 0.1, "eps": 1e-12}

    def _bin(self, v: Column, lo: Column, hi: Column) -> Column:
        at = F.floor((v - lo) / (hi - lo) * self.n_bins)
        return F.when(hi <= lo, 0).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(self.n_bins - 1))).cast("int")

    def _fit(self, train):
        ranges = melt(train).groupBy("j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
        self.ranges = sorted(ranges.collect())
        lo, hi = constants(r.lo for r in self.ranges), constants(r.hi for r in self.ranges)
        bins = melt(train).select("j", self._bin(F.col("v"), F.get(lo, F.col("j")), F.get(hi, F.col("j"))).alias("bin"))
        counts = {(r.j, r.bin): r.n for r in bins.groupBy("j", "bin").agg(F.count("*").alias("n")).collect()}
        self.costs = []
        for r in self.ranges:
            own = self.n_bins if r.hi > r.lo else 1
            p = [(counts.get((r.j, b), 0) + self.alpha) / (r.total + self.alpha * own) for b in range(own)]
            self.costs.append([-math.log(max(x, self.eps)) for x in p])

    def _score(self, rows):
        facts = F.array(*(F.struct(F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi"), constants(c).alias("costs")) for r, c in zip(self.ranges, self.costs, strict=True)))
        parts = F.zip_with("features", facts, lambda v, f: F.get(f["costs"], self._bin(v, f["lo"], f["hi"])))
        return rows.select("id", total(parts).alias("score"))


class _RobustZ(Detector):
    @classmethod
    def defaults(cls):
        return {"aggregation": "max", "eps": 1e-12, "consistency_correction": True}

    def _fit(self, train):
        long = melt(train)
        self.medians = [v[0] for _, v in sorted(quantiles_by(long, [0.5]).items())]
        off = F.abs(F.col("v") - F.get(constants(self.medians), F.col("j")))
        self.spreads = [max(v[0], self.eps) for _, v in sorted(quantiles_by(long.select("j", off.alias("v")), [0.5]).items())]

    def _score(self, rows):
        k = 0.6745 if self.consistency_correction else 1.0
        z = F.zip_with(F.zip_with("features", constants(self.medians), lambda v, m: F.abs(v - m) * k), constants(self.spreads), lambda x, s: x / s)
        how = {"max": F.array_max(z), "mean": total(z) / self.n_features, "l2": F.sqrt(total(F.transform(z, lambda x: x * x)))}[self.aggregation]
        return rows.select("id", how.alias("score"))


@register_model("core_mad", "classical", "core")
class MAD(_RobustZ):
    """Robust z-scores by median and median absolute deviation; the largest counts."""


@register_model("core_rzscore", "classical", "core")
class RZScore(_RobustZ):
    """As MAD, averaged over features."""

    @classmethod
    def defaults(cls):
        return {**super().defaults(), "aggregation": "mean"}


@register_model("core_dtc", "classical", "core")
class DTC(Detector):
    """Euclidean distance to the training mean."""

    def _fit(self, train):
        self.means = [r.mu for r in sorted(melt(train).groupBy("j").agg(F.avg("v").alias("mu")).collect())]

    def _score(self, rows):
        return rows.select("id", row_distance(F.col("features"), constants(self.means)).alias("score"))
