"""Registered metric, calibration, manifest and run queries, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlens.functions.ranks import quantiles_by
from oddlens.operators import calibration, metrics
from oddlens.sources import manifest, runs
from oddlens.sources.scratch import read


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"), "event_type")


_E = "e AS (SELECT event_id AS id, value AS score, (event_type = 'error')::INT AS label, event_type FROM events)"
_C = _E + """, c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM e GROUP BY score), k AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c WINDOW w AS (ORDER BY score DESC))"""


def auroc_events(spark, sf_dir):
    return metrics.auroc(_events(spark, sf_dir)).select(F.round("auroc", 9).alias("auroc"))


def ap_events(spark, sf_dir):
    return metrics.average_precision(_events(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


def best_f1_events(spark, sf_dir):
    return metrics.best_threshold(_events(spark, sf_dir)).select(F.round("threshold", 9).alias("threshold"), F.round("value", 9).alias("value"))


def youden_events(spark, sf_dir):
    return metrics.best_threshold(_events(spark, sf_dir), "youden").select(F.round("threshold", 9).alias("threshold"), F.round("value", 9).alias("value"))


def confusion_by_type(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("predicted", (F.col("score") >= 50).cast("int"))
    out = metrics.confusion(rows)
    return out.select("tp", "fp", "tn", "fn", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1", "specificity")))


def quantile_thresholds(spark, sf_dir):
    by_priority = quantiles_by(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("j"), F.col("o_totalprice").cast("double").alias("v")), [0.9])
    return spark.createDataFrame([(j, round(v[0], 6)) for j, v in by_priority.items()], "o_orderpriority string, threshold double")


def _scores(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))


def _normal(method):
    return lambda spark, sf_dir: calibration.normalize(_scores(spark, sf_dir), method).select("id", F.round("score", 9).alias("score"))


def rank_calibrator(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return calibration.RankCalibrator().fit(scores.where("id % 2 = 0")).transform(scores).select("id", F.round("score", 9).alias("score"))


def robust_standardizer(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return calibration.ScoreStandardizer("robust").fit(scores).transform(scores).select("id", F.round("score", 9).alias("score"))


def _ensemble(how):
    def query(spark, sf_dir):
        part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
        members = [part.select("id", F.col("p_size").cast("double").alias("score")), part.select("id", F.col("p_retailprice").alias("score")), part.select("id", (F.col("p_size") * F.col("p_retailprice")).alias("score"))]
        return calibration.combine(members, how).select("id", F.round("score", 9).alias("score"))

    return query


def _ensemble_sql(rank: bool, how: str) -> str:
    s = "(row_number() OVER (PARTITION BY k ORDER BY s, id) - 1) / (count(*) OVER (PARTITION BY k) - 1)" if rank else "s"
    return f"WITH m AS (SELECT p_partkey AS id, 0 AS k, p_size::DOUBLE AS s FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part UNION ALL SELECT p_partkey, 2, p_size * p_retailprice FROM part), r AS (SELECT id, {s} AS s FROM m) SELECT id, round({how}(s), 9) AS score FROM r GROUP BY id"


def _manifest(spark, sf_dir):
    """Documents as manifest records: category from lang, group from source, split and label by the labels table."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    split = F.when(F.col("toxic").isNull(), None).when((F.col("toxic") == 1) | (F.col("doc_id") % 3 == 0), "test").otherwise("train")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc/"), "doc_id").alias("image_path"), F.col("lang").alias("category"), split.alias("split"), F.col("toxic").cast("int").alias("label"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("mask/"), "doc_id")).alias("mask_path"), F.col("source").alias("group_id"))


_M = "m AS (SELECT 'doc/' || doc_id AS image_path, lang AS category, CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 OR doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, toxic AS label, CASE WHEN toxic = 1 THEN 'mask/' || doc_id END AS mask_path, source AS group_id FROM documents LEFT JOIN labels USING (doc_id))"


def manifest_stats(spark, sf_dir):
    return manifest.stats(_manifest(spark, sf_dir))


def manifest_filter(spark, sf_dir):
    return manifest.select(_manifest(spark, sf_dir), categories=["en", "de"], splits=["test"], labels=[1], has_mask=True)


def manifest_group_split(spark, sf_dir):
    return manifest.follow_groups(_manifest(spark, sf_dir)).groupBy("category", "assigned_split").agg(F.count("*").alias("n"))


def manifest_benchmark_split(spark, sf_dir):
    """The rules of the split without its draw: records keep the split they name; groups of the others, which have no labels, go to train."""
    rows = _manifest(spark, sf_dir).withColumn("group_id", F.when(F.col("split").isNull(), F.col("group_id")))
    return manifest.benchmark_split(rows, test_fraction=0.0).groupBy("category", "assigned_split").agg(F.count("*").alias("n"))


def run_latest(spark, sf_dir):
    """The last run of each of two filters."""
    rows = _runs(spark, sf_dir).withColumn("timestamp_utc", F.col("run"))
    both = runs.latest(rows, category="7").union(runs.latest(rows, like="199", category="3"))
    return both.select("run", "category", F.round("auroc", 9).alias("auroc"))


def manifest_profile(spark, sf_dir):
    return manifest.profile(_manifest(spark, sf_dir))


def _runs(spark, sf_dir):
    """Metric rows as run summaries: a run for each supplier nation and year of lineitem."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    run = F.concat(F.lit("run-"), F.year("l_shipdate").cast("string"))
    return lines.groupBy(run.alias("run"), F.col("s_nationkey").cast("string").alias("category")).agg(F.avg("l_discount").alias("auroc"), F.avg("l_tax").alias("average_precision"))


_R = "r AS (SELECT 'run-' || year(l_shipdate) AS run, s_nationkey::VARCHAR AS category, avg(l_discount) AS auroc, avg(l_tax) AS average_precision FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def run_summary(spark, sf_dir):
    return runs.summarise(_runs(spark, sf_dir), ["auroc", "average_precision"]).select("run", "n", *(F.round(c, 9).alias(c) for c in ("auroc_mean", "auroc_std", "average_precision_mean", "average_precision_std")))


def run_compare(spark, sf_dir):
    return runs.compare(_runs(spark, sf_dir), "run-1996", ["auroc"]).select("run", "category", "metric", F.round("value", 9).alias("value"), F.round("baseline", 9).alias("baseline"), F.round("delta", 9).alias("delta"), "verdict")


def leaderboard(spark, sf_dir):
    return runs.leaderboard(_runs(spark, sf_dir), "auroc").select("run", F.round("auroc", 9).alias("auroc"), "rank")


def queries():
    return {
        "metric_auroc": auroc_events, "metric_average_precision": ap_events, "metric_best_f1": best_f1_events, "metric_youden": youden_events, "metric_confusion": confusion_by_type,
        "threshold_quantile": quantile_thresholds, "norm_zscore": _normal("zscore"), "norm_minmax": _normal("minmax"), "norm_rank01": _normal("rank"), "rank_calibrator": rank_calibrator, "score_standardizer_robust": robust_standardizer,
        "ensemble_mean_rank": _ensemble("mean_rank"), "ensemble_max_rank": _ensemble("max_rank"), "ensemble_mean": _ensemble("mean"), "ensemble_max": _ensemble("max"),
        "manifest_stats": manifest_stats, "manifest_filter": manifest_filter, "manifest_group_split": manifest_group_split, "manifest_profile": manifest_profile, "manifest_benchmark_split": manifest_benchmark_split, "run_latest": run_latest,
        "run_summary": run_summary, "run_compare": run_compare, "leaderboard": leaderboard,
    }


def oracle_sql():
    s = "s AS (SELECT c_custkey AS id, c_acctbal AS score FROM customer)"
    return {
        "metric_auroc": f"WITH {_C} SELECT round(sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)), 9) AS auroc FROM k",
        "metric_average_precision": f"WITH {_C} SELECT round(sum(pos / p * tp / (tp + fp)), 9) AS average_precision FROM k",
        "metric_best_f1": f"WITH {_C} SELECT round(score, 9) AS threshold, round(2 * tp / (tp + fp + p), 9) AS value FROM k ORDER BY 2 * tp / (tp + fp + p) DESC, score LIMIT 1",
        "metric_youden": f"WITH {_C} SELECT round(score, 9) AS threshold, round(tp / p - fp / n, 9) AS value FROM k ORDER BY tp / p - fp / n DESC, score DESC LIMIT 1",
        "metric_confusion": f"WITH {_E}, q AS (SELECT count(*) FILTER (score >= 50 AND label = 1) AS tp, count(*) FILTER (score >= 50 AND label = 0) AS fp, count(*) FILTER (score < 50 AND label = 0) AS tn, count(*) FILTER (score < 50 AND label = 1) AS fn FROM e) SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 9) AS specificity FROM q",
        "threshold_quantile": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 6) AS threshold FROM orders GROUP BY 1",
        "norm_zscore": f"WITH {s} SELECT id, round((score - (SELECT avg(score) FROM s)) / ((SELECT stddev_pop(score) FROM s) + 1e-12), 9) AS score FROM s",
        "norm_minmax": f"WITH {s} SELECT id, round((score - (SELECT min(score) FROM s)) / ((SELECT max(score) - min(score) FROM s) + 1e-12), 9) AS score FROM s",
        "norm_rank01": f"WITH {s} SELECT id, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 - 1) / (count(*) OVER () - 1), 9) AS score FROM s",
        "rank_calibrator": f"WITH {s} SELECT id, round(coalesce(sum((id % 2 = 0)::INT) OVER (ORDER BY score), 0) / (SELECT count(*) FROM s WHERE id % 2 = 0), 9) AS score FROM s",
        "score_standardizer_robust": f"WITH {s}, a AS (SELECT median(score) AS med FROM s), b AS (SELECT median(abs(score - med)) AS mad FROM s, a) SELECT id, round((score - med) / mad, 9) AS score FROM s, a, b",
        "ensemble_mean_rank": _ensemble_sql(True, "avg"), "ensemble_max_rank": _ensemble_sql(True, "max"), "ensemble_mean": _ensemble_sql(False, "avg"), "ensemble_max": _ensemble_sql(False, "max"),
        "manifest_stats": f"WITH {_M} SELECT 'category' AS field, coalesce(category, 'missing') AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'split', coalesce(split, 'missing'), count(*) FROM m GROUP BY 2 UNION ALL SELECT 'label', coalesce(label::VARCHAR, 'missing'), count(*) FROM m GROUP BY 2 UNION ALL SELECT 'mask', CASE WHEN mask_path IS NULL THEN 'missing' ELSE 'present' END, count(*) FROM m GROUP BY 2",
        "manifest_filter": f"WITH {_M} SELECT * FROM m WHERE category IN ('en', 'de') AND split = 'test' AND label = 1 AND mask_path IS NOT NULL",
        "manifest_group_split": f"WITH {_M}, g AS (SELECT category, group_id, min(split) AS lead FROM m WHERE split IS NOT NULL GROUP BY 1, 2) SELECT m.category, coalesce(m.split, g.lead, 'train') AS assigned_split, count(*) AS n FROM m LEFT JOIN g ON g.category = m.category AND g.group_id = m.group_id GROUP BY 1, 2",
        "manifest_profile": f"WITH {_M} SELECT category, count(*) AS n, count(*) FILTER (label = 1) AS n_anomalous, count(*) FILTER (label = 0) AS n_normal, count(mask_path) AS n_masks, count(DISTINCT group_id) AS n_groups FROM m GROUP BY category",
        "manifest_benchmark_split": f"WITH {_M} SELECT category, coalesce(split, 'train') AS assigned_split, count(*) AS n FROM m GROUP BY 1, 2",
        "run_latest": f"WITH {_R} SELECT run, category, round(auroc, 9) AS auroc FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY run DESC) AS k FROM r WHERE category = '7' OR (category = '3' AND contains(run, '199'))) WHERE k = 1",
        "run_summary": f"WITH {_R} SELECT run, count(*) AS n, round(avg(auroc), 9) AS auroc_mean, round(stddev_pop(auroc), 9) AS auroc_std, round(avg(average_precision), 9) AS average_precision_mean, round(stddev_pop(average_precision), 9) AS average_precision_std FROM r GROUP BY run",
        "run_compare": f"WITH {_R}, b AS (SELECT category, auroc FROM r WHERE run = 'run-1996') SELECT run, category, 'auroc' AS metric, round(r.auroc, 9) AS value, round(b.auroc, 9) AS baseline, round(r.auroc - b.auroc, 9) AS delta, CASE WHEN b.auroc IS NULL THEN 'missing' WHEN r.auroc - b.auroc < 0 THEN 'regressed' WHEN r.auroc - b.auroc > 0 THEN 'improved' ELSE 'unchanged' END AS verdict FROM r LEFT JOIN b USING (category) WHERE run <> 'run-1996'",
        "leaderboard": f"WITH {_R}, a AS (SELECT run, round(avg(auroc), 9) AS auroc FROM r GROUP BY run) SELECT run, auroc, row_number() OVER (ORDER BY auroc DESC, run) AS rank FROM a",
    }
