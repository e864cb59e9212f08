"""Each row's part of the distance covariance of pairs of random projections, over all rows in n log n.

For projections u and w with row means of distances A_i, B_i and grand means A, B, the doubly centred product of row i is

    mean_j |u_i - u_j| |w_i - w_j|  -  A_i B_i  -  mean_j |u_i - u_j| (B_j - B)  -  mean_j (A_j - A) |w_i - w_j|  +  mean_j (A_j - A)(B_j - B)

A mean of weighted distances on a line follows from running sums of the weights in the order of the line. In the first
term, rows before i in the order of u are some dyadic blocks of ranks, one for each bit of i's rank; within a block the
distances by w are running sums in the order of w. So all is sums over sorted values, made by range partitions with the
sums of the partitions before; new rows take part without weight.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlens.functions.ranks import running_sums
from oddlens.operators.base import Detector
from oddlens.operators.registry import register_model
from oddlens.sources.scratch import settle


def _projected(batches, axes: np.ndarray):
    half = axes.shape[1] // 2
    for pdf in batches:
        x = np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1) @ axes
        yield pd.concat([pd.DataFrame({"id": pdf["id"], "fitted": pdf["fitted"], "k": k, "u": x[:, k], "w": x[:, half + k]}) for k in range(half)]) if len(pdf) else pd.DataFrame({"id": pdf["id"], "fitted": pdf["fitted"], "k": [], "u": [], "w": []}).astype({"k": int})


def _away(v: str, weight: str, moment: str) -> Column:
    """Sum of weight_j |v - v_j| from sums up to v and over all, of the weights and of weights times v."""
    return F.col(v) * (2 * F.col(weight) - F.col(f"all_{weight}")) - 2 * F.col(moment) + F.col(f"all_{moment}")


def _on_line(rows: DataFrame, v: str, weight: str, name: str) -> DataFrame:
    """``rows`` (k, fitted and more) with ``name``: the sum over the fitted rows of weight_j |v - v_j|."""
    given = rows.withColumns({"__m": F.when(F.col("fitted"), F.col(weight)).otherwise(0.0), "__mv": F.when(F.col("fitted"), F.col(weight) * F.col(v)).otherwise(0.0)})
    return running_sums(given, ["k"], v, ["__m", "__mv"]).withColumn(name, _away(v, "__m", "__mv")).drop("__m", "__mv", "all___m", "all___mv")


def contributions(points: DataFrame) -> DataFrame:
    """(id, fitted, score): the mean over k of the absolute parts, from (id, fitted, k, u, w); means are over the fitted rows."""
    points = points.withColumns({"one": F.when(F.col("fitted"), 1.0).otherwise(0.0)})
    rows = _on_line(points, "u", "one", "a")
    rows = _on_line(rows, "w", "one", "b")
    means = settle(rows.where("fitted").groupBy("k").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), (F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")).alias("ab")))
    rows = rows.join(F.broadcast(means), "k")  # a row for each projection
    rows = rows.withColumns({"a": F.col("a") / F.col("n"), "b": F.col("b") / F.col("n")})
    rows = rows.withColumns({"alpha": F.col("a") - F.col("mean_a") / F.col("n"), "beta": F.col("b") - F.col("mean_b") / F.col("n"), "ab": F.col("ab") / F.col("n") / F.col("n")})
    rows = _on_line(rows, "u", "beta", "ub")
    rows = _on_line(rows, "w", "alpha", "wa")
    rows = running_sums(rows, ["k"], "u", ["one"]).withColumn("rank", (F.col("one") - F.when(F.col("fitted"), 1).otherwise(0)).cast("long")).drop("all_one")
    rows = settle(rows.withColumn("one", F.when(F.col("fitted"), 1.0).otherwise(0.0)))
    # All of u_i - u_j, and twice those before i: |u_i - u_j| is the second less the first.
    everything = rows.select("id", "fitted", "k", "u", "w", "rank", F.lit(-1).cast("long").alias("level"), F.lit(0).cast("long").alias("node"), F.lit(-1.0).alias("sign"), F.col("fitted").alias("holds"))
    bits = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") + 1)).cast("int"))))
    shift = F.expr("shiftright(rank, level)")
    asks = bits.where((shift % 2) == 1).select("id", "fitted", "k", "u", "w", "rank", F.col("level").cast("long").alias("level"), (shift - 1).alias("node"), F.lit(2.0).alias("sign"), F.lit(False).alias("holds"))
    held = bits.where(F.col("fitted") & ((shift % 2) == 0)).select("id", "fitted", "k", "u", "w", "rank", F.col("level").cast("long").alias("level"), shift.alias("node"), F.lit(0.0).alias("sign"), F.lit(True).alias("holds"))
    every = everything.union(asks).union(held)
    h = lambda c: F.when(F.col("holds"), c).otherwise(0.0)
    every = every.withColumns({"c": h(F.lit(1.0)), "cu": h(F.col("u")), "cw": h(F.col("w")), "cuw": h(F.col("u") * F.col("w"))})
    summed = running_sums(every, ["k", "level", "node"], "w", ["c", "cu", "cw", "cuw"]).where("sign <> 0")
    part = F.col("u") * _away("w", "c", "cw") - _away("w", "cu", "cuw")
    cross = summed.groupBy("id", "fitted", "k").agg(F.sum(F.col("sign") * part).alias("cross"))
    parts = rows.join(cross, ["id", "fitted", "k"])
    value = F.col("cross") / F.col("n") - F.col("a") * F.col("b") - F.col("ub") / F.col("n") - F.col("wa") / F.col("n") + F.col("ab")
    return parts.groupBy("id", "fitted").agg(F.avg(F.abs(value)).alias("score"))


@register_model("core_dcorr", "classical", "core")
class DCorr(Detector):
    """Mean contribution to the distance covariance of pairs of random projections, against all training rows."""

    @classmethod
    def defaults(cls):
        return {"n_projections": 8, "random_state": 0}

    def _fit(self, train):
        axes = np.random.default_rng(self.random_state or 0).normal(size=(self.n_features, 2 * self.n_projections))
        self.axes = axes / np.maximum(np.linalg.norm(axes, axis=0), 1e-12)

    def _points(self, rows, fitted: bool) -> DataFrame:
        kind = rows.schema["id"].dataType.simpleString()
        return rows.select("id", "features", F.lit(fitted).alias("fitted")).mapInPandas(partial(_projected, axes=self.axes), f"id {kind}, fitted boolean, k int, u double, w double")

    def _train_scores(self, train):
        return contributions(self._points(train, True)).select("id", "score")

    def _score(self, rows):
        return contributions(self._points(self.train, True).union(self._points(rows, False))).where("NOT fitted").select("id", "score")
