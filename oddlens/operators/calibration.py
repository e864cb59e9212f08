"""Thresholds, score normalisation and calibration, score ensembles. Inputs hold ``id`` and ``score``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddlens.functions import ranks
from oddlens.functions.ranks import quantile, running_counts
from oddlens.operators.metrics import best_threshold
from oddlens.sources.scratch import settle


def quantile_threshold(scores: DataFrame, contamination: float) -> float:
    """The ``1 - contamination`` quantile, interpolated."""
    if not 0 < contamination < 0.5:
        raise ValueError("contamination must be in (0, 0.5)")
    return quantile(scores, "score", 1 - contamination)


def score_threshold(scores: DataFrame, quantile: float = 0.995) -> float:
    return ranks.quantile(scores, "score", quantile)


def fewshot_threshold(normal: DataFrame, anomalous: DataFrame, objective: str = "f1") -> float:
    both = normal.select("score", F.lit(0).alias("label")).union(anomalous.select("score", F.lit(1).alias("label")))
    return best_threshold(both, objective).first().threshold


def split_fewshot(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores labelled 0 and those labelled 1."""
    return scores.where("label = 0"), scores.where("label = 1")


def apply_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.withColumn("label", (F.col("score") >= threshold).cast("int"))


def normal_pixel_threshold(pixels: DataFrame, q: float = 0.999) -> float:
    """Quantile of the scores of background pixels (all pixels if there is no ``label``); NaN counts as lowest."""
    normal = pixels.where("label = 0") if "label" in pixels.columns else pixels
    clean = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    return quantile(normal, clean, q)


def segf1_threshold(pixels: DataFrame) -> float:
    """The threshold (``score >= t``) with the best F1 among the distinct scores; of equal ones the highest."""
    counts = pixels.groupBy(F.lit(0).alias("j"), F.col("score").alias("v")).agg(F.count("*").alias("n"))
    positive = pixels.groupBy(F.col("score").alias("v")).agg(F.sum("label").alias("pos"))
    facts = pixels.agg(F.count("*").alias("total"), F.sum("label").alias("positives")).first()
    if not facts.total:
        return float("nan")
    tp = running_counts(counts.join(positive, "v").select("j", "v", F.col("pos").alias("n"))).select("v", (facts.positives - F.col("upto") + F.col("n")).alias("tp"))
    at = running_counts(counts).select("v", (facts.total - F.col("upto") + F.col("n")).alias("found")).join(tp, "v")
    f1 = 2 * F.col("tp") / (F.col("found") + facts.positives)
    return at.agg(F.max_by("v", F.struct(f1, "v"))).first()[0]


def pot_threshold(scores: DataFrame, alpha: float, tail: float = 0.1, least: int = 20, eps: float = 1e-12) -> tuple[float, str]:
    """Peaks over threshold: a generalised Pareto tail above the ``1 - tail`` quantile, by the method of moments.

    Falls back to the plain quantile with fewer than ``least`` exceedances. Only moments reach the driver.
    """
    start = quantile(scores, "score", 1 - tail)
    over = scores.where(F.col("score") > start).select((F.col("score") - start).alias("x")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var")).first()
    if over.n < least or not over.var or over.var <= eps or alpha >= tail:
        return quantile(scores, "score", 1 - alpha), "quantile_fallback"
    shape = 0.5 * (1 - over.mean**2 / over.var)
    scale = 0.5 * over.mean * (over.mean**2 / over.var + 1)
    ratio = tail / alpha
    reach = scale * math.log(ratio) if abs(shape) < 1e-9 else scale / shape * (ratio**shape - 1)
    return start + max(reach, 0.0), "pot"


def zscore(scores: DataFrame, eps: float = 1e-12) -> DataFrame:
    facts = scores.agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"))
    return scores.crossJoin(F.broadcast(facts)).withColumn("score", (F.col("score") - F.col("mu")) / (F.col("sd") + eps)).drop("mu", "sd")


def minmax(scores: DataFrame, eps: float = 1e-12) -> DataFrame:
    facts = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return scores.crossJoin(F.broadcast(facts)).withColumn("score", (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + eps)).drop("lo", "hi")


def _ranks(scores: DataFrame) -> DataFrame:
    """score, n (rows with it), upto (rows up to it), total."""
    counts = scores.groupBy(F.lit(0).alias("j"), F.col("score").alias("v")).agg(F.count("*").alias("n"))
    total = scores.agg(F.count("*").alias("total"))
    return running_counts(counts).crossJoin(F.broadcast(total)).select(F.col("v").alias("score"), "n", "upto", "total")


def rank01(scores: DataFrame) -> DataFrame:
    """Average rank from 0 to 1; 0 for a single row."""
    at = _ranks(scores).select("score", F.when(F.col("total") > 1, (F.col("upto") - (F.col("n") - 1) / 2.0 - 1) / (F.col("total") - 1)).otherwise(0.0).alias("r"))
    return scores.join(at, "score").drop("score").withColumnRenamed("r", "score")


NORMALISE = {"zscore": zscore, "minmax": minmax, "rank": rank01, "quantile": rank01}


def normalize(scores: DataFrame, method: str) -> DataFrame:
    return NORMALISE[method](scores)


class RankCalibrator:
    """Empirical distribution of training scores: the part of them that is at most a new score."""

    def fit(self, scores: DataFrame) -> RankCalibrator:
        self.counts = settle(scores.groupBy(F.lit(0).alias("j"), F.col("score").cast("double").alias("v")).agg(F.count("*").alias("n")))
        self.total = scores.count()
        return self

    def transform(self, scores: DataFrame) -> DataFrame:
        asked = scores.select(F.lit(0).alias("j"), F.col("score").cast("double").alias("v"), F.lit(0).cast("long").alias("n")).distinct()
        upto = running_counts(self.counts.union(asked).groupBy("j", "v").agg(F.sum("n").alias("n"))).select(F.col("v").alias("score"), (F.col("upto") / self.total).alias("p"))
        return scores.withColumn("score", F.col("score").cast("double")).join(upto, "score").drop("score").withColumnRenamed("p", "score")


class ScoreStandardizer:
    """rank, zscore, robust (median and MAD) or minmax (clipped to 0..1), by training scores."""

    def __init__(self, method: str = "rank", eps: float = 1e-12):
        self.method, self.eps = method, eps

    def fit(self, scores: DataFrame) -> ScoreStandardizer:
        if self.method == "rank":
            self.ranks = RankCalibrator().fit(scores)
        elif self.method == "zscore":
            self.shift, self.scale = scores.agg(F.avg("score"), F.stddev_pop("score")).first()
        elif self.method == "robust":
            self.shift = quantile(scores, "score", 0.5)
            self.scale = quantile(scores, F.abs(F.col("score") - self.shift), 0.5)
        elif self.method == "minmax":
            self.shift, high = scores.agg(F.min("score"), F.max("score")).first()
            self.scale = high - self.shift
        else:
            raise ValueError(self.method)
        return self

    def transform(self, scores: DataFrame) -> DataFrame:
        if self.method == "rank":
            return self.ranks.transform(scores)
        out = (F.col("score") - self.shift) / max(self.scale, self.eps)
        return scores.withColumn("score", F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)) if self.method == "minmax" else out)


def significant(score: Column, digits: int = 12) -> Column:
    """Scores to some significant digits, so that sums taken in another order don't tell equal scores apart."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(score))))
    return F.when((score == 0) | F.isnan(score) | (F.abs(score) == float("inf")), score).otherwise(F.rint(score * scale) / scale)


def stable_ranks(scores: DataFrame) -> DataFrame:
    """(id, score): rank from 0 to 1 by (score, id), each row its own rank."""
    parts = settle(scores.repartitionByRange("score", "id").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", before.alias("start"), F.sum("held").over(Window.partitionBy()).alias("total"))
    row = F.row_number().over(Window.partitionBy("part").orderBy("score", "id"))
    rank = F.when(F.col("total") > 1, (F.col("start") + F.col("row") - 1) / (F.col("total") - 1)).otherwise(0.0)
    return parts.withColumn("row", row).join(F.broadcast(starts), "part").select("id", rank.alias("score"))


def combine(members: list[DataFrame], how: str = "mean_rank", weights: list[float] | None = None, trim: float = 0.1) -> DataFrame:
    """(id, score) of several score tables: mean, max or trimmed_mean, of scores or (``_rank``) of their ranks."""
    weights = weights or [1.0] * len(members)
    if how.endswith("_rank"):
        members, how = [stable_ranks(m) for m in members], how.removesuffix("_rank")
    tall = None
    for k, (m, w) in enumerate(zip(members, weights, strict=True)):
        part = m.select("id", "score", F.lit(float(w)).alias("w"), F.lit(k).alias("k"))
        tall = part if tall is None else tall.union(part)
    if how == "mean":
        return tall.groupBy("id").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("score"))
    if how == "max":
        return tall.groupBy("id").agg(F.max("score").alias("score"))
    if how != "trimmed_mean":
        raise ValueError(how)
    cut = int(trim * len(members))
    kept = F.slice(F.sort_array("all"), cut + 1, len(members) - 2 * cut)
    return tall.groupBy("id").agg(F.collect_list("score").alias("all")).select("id", (F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)).alias("score"))


def seeded_split(rows: DataFrame, fraction: float = 0.2, seed: int = 0, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(train, calibration): about ``fraction`` of the keys, by their seeded hash, for calibration. Reruns agree."""
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return rows.where(~part), rows.where(part)
