"""Evaluation of scores against labels. Inputs are DataFrames with ``label`` (0/1) and ``score``; results are one row.

All curves start from counts by distinct score, whose running sums are taken over range-partitioned parts, so a
metric over all pixels of all images is a distributed job and no sort passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddlens.functions.ranks import quantiles
from oddlens.sources.scratch import settle


def curve(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each distinct score: tp and fp (rows at or above it), pos, neg of the score itself, and totals P and N.

    Scores that are null or NaN, and null labels, are left out. ``by``: a curve for each group.
    """
    keys = list(by)
    good = df.where("label IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").select(*keys, F.col("score").cast("double").alias("score"), F.col("label").cast("int").alias("label"))
    counts = good.groupBy(*keys, "score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    parts = settle(counts.repartitionByRange(*keys, F.desc("score")).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy(*keys, "part").agg(F.sum("pos").alias("hp"), F.sum("neg").alias("hn"))
    lower = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = sums.select(*keys, "part", F.coalesce(F.sum("hp").over(lower), F.lit(0)).alias("sp"), F.coalesce(F.sum("hn").over(lower), F.lit(0)).alias("sn"), F.sum("hp").over(whole).alias("P"), F.sum("hn").over(whole).alias("N"))
    inside = Window.partitionBy(*keys, "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("ip", F.sum("pos").over(inside)).withColumn("in_", F.sum("neg").over(inside)).join(starts, [*keys, "part"])
    return out.select(*keys, "score", "pos", "neg", (F.col("sp") + F.col("ip")).alias("tp"), (F.col("sn") + F.col("in_")).alias("fp"), "P", "N")


def auroc(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """auroc: the chance that a positive scores above a negative, ties by half; NaN with one class."""
    c = curve(df, by)
    area = F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2.0))
    product = F.max("P").cast("double") * F.max("N")
    return c.groupBy(*by).agg(F.when(product > 0, area / product).otherwise(F.lit(float("nan"))).alias("auroc"))


def average_precision(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """average_precision: sum of recall steps times precision over distinct scores; NaN with one class."""
    c = curve(df, by)
    ap = F.sum(F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy(*by).agg(F.when((F.max("P") > 0) & (F.max("N") > 0), ap).otherwise(F.lit(float("nan"))).alias("average_precision"))


def best_threshold(df: DataFrame, metric: str = "f1", by: tuple[str, ...] = ()) -> DataFrame:
    """threshold and value that are best by ``f1`` (of equal ones the lowest threshold) or ``youden`` (the highest).

    Only negatives: a threshold above every score and value 0; only positives: the lowest score.
    """
    c = curve(df, by)
    if metric == "f1":
        value, tie = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P")), -F.col("score")
    elif metric == "youden":
        value, tie = F.col("tp") / F.greatest(F.col("P"), F.lit(1)) - F.col("fp") / F.greatest(F.col("N"), F.lit(1)), F.col("score")
    else:
        raise ValueError(metric)
    best = c.groupBy(*by).agg(F.max(F.struct(value.alias("value"), tie.alias("tie"), F.col("score"))).alias("b"), F.max("P").alias("P"), F.max("N").alias("N"), F.max("score").alias("hi"), F.min("score").alias("lo"))
    above = F.col("hi") + F.greatest(F.abs(F.col("hi")), F.lit(1e-300)) * 2.0**-52
    return best.select(*by, F.when(F.col("P") == 0, above).when(F.col("N") == 0, F.col("lo")).otherwise(F.col("b.score")).alias("threshold"), F.when(F.col("P") == 0, 0.0).otherwise(F.col("b.value")).alias("value"))


def confusion(df: DataFrame, predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, tn, fn and accuracy, precision, recall, f1, specificity (0 where a denominator is 0)."""
    p, y = F.col(predicted) == 1, F.col("label") == 1
    n = df.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return n.select(*by, "tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tn, tn + fp).alias("specificity"))


def evaluate(df: DataFrame, threshold: float | None = None) -> dict[str, float]:
    """AUROC, average precision, and the confusion figures of ``score >= threshold`` (the best F1's if none is given)."""
    if threshold is None:
        threshold = best_threshold(df).first().threshold
    row = confusion(df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))).first().asDict()
    return {"auroc": auroc(df).first()[0], "average_precision": average_precision(df).first()[0], "threshold": threshold, **row}


def pixel_segf1(pixels: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """segf1 of ``score > threshold`` over pixels (label, score)."""
    return confusion(pixels.withColumn("predicted", (F.col("score") > threshold).cast("int")), by=by).select(*by, F.col("f1").alias("segf1"))


def background_fpr(pixels: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """bg_fpr: part of the background pixels with ``score > threshold``."""
    normal = pixels.where("label = 0")
    return normal.groupBy(*by).agg((F.count_if(F.col("score") > threshold) / F.count("*")).alias("bg_fpr"))


def pro(pixels: DataFrame, limit: float = 0.3, steps: int = 200) -> DataFrame:
    """aupro: mean recall of labelled regions against background false-positive rate, integrated up to ``limit`` and divided by it.

    ``pixels``: image_id, region (0 for background, else the region's number), score. Thresholds are quantiles of
    background scores at ``steps`` evenly spaced rates; a region's recall counts its pixels at or above one.
    """
    normal = pixels.where("region = 0")
    rates = [limit * i / (steps - 1) for i in range(steps)]
    cuts = quantiles(normal, "score", [1 - r for r in rates])
    grid = F.array(*(F.lit(None).cast("double") if t is None else F.lit(float(t)) for t in cuts))
    sizes = pixels.where("region > 0").groupBy("image_id", "region").agg(F.count("*").alias("size"))
    hit = pixels.where("region > 0").select("image_id", "region", F.explode(F.filter(F.transform(grid, lambda t, i: F.when(F.col("score") >= t, i)), lambda x: x.isNotNull())).alias("step"))
    recall = hit.groupBy("image_id", "region", "step").agg(F.count("*").alias("n")).join(sizes, ["image_id", "region"])
    n_regions = sizes.count()
    if not n_regions:
        return pixels.sparkSession.createDataFrame([(float("nan"),)], "aupro double")
    line = recall.groupBy("step").agg((F.sum(F.col("n") / F.col("size")) / n_regions).alias("recall"))
    false = normal.select(F.explode(F.transform(grid, lambda t, i: F.struct(i.alias("step"), (F.col("score") >= t).cast("int").alias("hit")))).alias("x")).groupBy("x.step").agg(F.avg("x.hit").alias("fpr"))
    points = false.join(line, "step", "left").select(F.least("fpr", F.lit(limit)).alias("fpr"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
    order = Window.orderBy("fpr", "recall")  # at most ``steps`` rows
    area = (F.col("fpr") - F.lag("fpr", 1, 0.0).over(order)) * (F.col("recall") + F.coalesce(F.lag("recall").over(order), F.col("recall"))) / 2
    return points.select(area.alias("a")).agg((F.sum("a") / limit).alias("aupro"))
