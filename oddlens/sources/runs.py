"""Run reports as rows (run, category, metrics): index, summary, comparison with a baseline, leaderboard."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """report.json files under ``path``, a row each, with run_dir from the file's place; newest first by timestamp_utc."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "report.json").json(path)
    named = rows.withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/report\.json$", 1))
    return named.orderBy(F.desc("timestamp_utc")) if "timestamp_utc" in named.columns else named


def select(rows: DataFrame, like: str | None = None, **equal) -> DataFrame:
    """Runs whose columns equal the given values, and whose run name contains ``like`` in any case."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows if like is None else rows.where(F.contains(F.lower("run"), F.lit(like.lower())))


#: Metrics for which less is better; of others more is.
LOWER_IS_BETTER = frozenset("bg_fpr fpr false_positive_rate latency_ms latency_mean latency_p95 auroc_drop average_precision_drop segf1_drop".split())


def metric_direction(name: str) -> str:
    return "lower_is_better" if name in LOWER_IS_BETTER else "higher_is_better"


def latest(rows: DataFrame, by: str = "timestamp_utc", like: str | None = None, **equal) -> DataFrame:
    """The newest of the runs that ``select`` finds: one row, or none; of equally new ones the last by name."""
    return select(rows, like, **equal).orderBy(F.desc_nulls_last(by), F.desc("run")).limit(1)


def split_fingerprint(rows: DataFrame) -> str:
    """SHA-256 of a split, whatever the order and partitions of its records (image_path, assigned_split).

    Records are hashed on their own; what is hashed on is their number, the exclusive or and the sum of their hashes.
    """
    one = F.xxhash64("image_path", "assigned_split")
    r = rows.agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(F.shiftrightunsigned(one, 24)).alias("s")).first()
    return hashlib.sha256(f"{r.n}:{r.x}:{r.s}".encode()).hexdigest()


def summarise(rows: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over a run's categories."""
    parts = [f(n).alias(f"{n}_{s}") for n in names for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.groupBy("run").agg(F.count("*").alias("n"), *parts)


def compare(rows: DataFrame, baseline: str, names: list[str], tolerance: float = 0.0, lower_is_better: tuple[str, ...] | None = None) -> DataFrame:
    """Each run's metrics beside the baseline run's by category: value, baseline, delta, verdict; directions by ``metric_direction`` if not given."""
    if lower_is_better is None:
        lower_is_better = tuple(n for n in names if metric_direction(n) == "lower_is_better")
    long = rows.select("run", "category", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("x")).select("run", "category", "x.*")
    base = long.where(F.col("run") == baseline).select("category", "metric", F.col("value").alias("baseline"))
    delta = F.col("value") - F.col("baseline")
    gain = F.when(F.col("metric").isin(list(lower_is_better)), -delta).otherwise(delta) if lower_is_better else delta
    verdict = F.when(delta.isNull(), "missing").when(gain < -tolerance, "regressed").when(gain > tolerance, "improved").otherwise("unchanged")
    return long.where(F.col("run") != baseline).join(base, ["category", "metric"], "left").select("run", "category", "metric", "value", "baseline", delta.alias("delta"), verdict.alias("verdict"))


def leaderboard(rows: DataFrame, metric: str) -> DataFrame:
    """Runs by their mean metric to nine places, the best first, ties by name. A row a run: the window is small."""
    means = rows.groupBy("run").agg(F.round(F.avg(metric), 9).alias(metric))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), "run")).cast("long"))
