"""Robustness by group against single runs, projectors against numpy, run index rules."""

import numpy as np
from pyspark.sql import functions as F

from oddlens.functions import images
from oddlens.operators import metrics, neighbours, pixel_maps, projectors, robustness  # noqa: F401
from oddlens.operators.registry import create_model
from oddlens.sources import runs


def pictures(spark, seed, n, odd=()):
    draw, rows = np.random.default_rng(seed), []
    for i in range(n):
        p = draw.integers(90, 120, (10, 12, 1))
        if i in odd:
            p[3:6, 4:8] = 240
        rows.append((i, 10, 12, 1, [int(v) for v in p.ravel()], int(i in odd)))
    return spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data array<int>, label int").repartition(2)


def test_each_variant_is_its_corruption(spark):
    rows = pictures(spark, 1, 3)
    got = {(r.image_id, r.corruption, r.severity): r.data for r in robustness.variants(rows, ("blur", "glare"), (2, 4), 7).collect()}
    clean = {r.image_id: r.data for r in rows.collect()}
    assert len(got) == 15 and all(got[i, "clean", 0] == clean[i] for i in clean)
    for name in ("blur", "glare"):
        for severity in (2, 4):
            want = {r.image_id: r.data for r in images.corrupt(rows, name, severity, 7).collect()}
            assert all(got[i, name, severity] == want[i] for i in want)


def test_scores_by_group_equal_single_runs(spark):
    rows = pictures(spark, 2, 24, odd=range(0, 24, 4))
    model = create_model("core_knn").fit(images.extract(pictures(spark, 3, 20), "structural"))
    got = {(r.corruption, r.severity): r for r in robustness.score_robustness(model, rows, "structural", ("blur", "lighting"), (1, 5)).collect()}
    assert set(got) == {("clean", 0), ("blur", 1), ("blur", 5), ("lighting", 1), ("lighting", 5)}
    assert got["clean", 0].auroc_drop == 0
    changed = images.corrupt(rows, "blur", 5).join(rows.select("image_id", "label"), "image_id")
    scored = model.decision_function(images.extract(changed, "structural")).join(changed.select(F.col("image_id").alias("id"), "label"), "id")
    assert np.isclose(got["blur", 5].auroc, metrics.auroc(scored).first()[0])
    assert np.isclose(got["blur", 5].auroc_drop, got["clean", 0].auroc - got["blur", 5].auroc)


def test_maps_are_judged_at_one_threshold(spark):
    rows, normal = pictures(spark, 4, 6, odd=(1, 3)), pictures(spark, 5, 6)
    masks = spark.createDataFrame([(i, y, x, 1) for i in (1, 3) for y in range(3, 6) for x in range(4, 8)], "image_id long, y int, x int, label int")
    model = pixel_maps.TemplateMap(kind="ssim_template_map").fit(normal)
    got = {(r.corruption, r.severity): r for r in robustness.map_robustness(model, rows, masks, normal, ("blur",), (5,), normal_quantile=0.95).collect()}
    assert got["clean", 0].segf1_drop == 0 and 0 < got["clean", 0].segf1 <= 1 and ("blur", 5) in got


def test_projectors_equal_numpy(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(80, 4)) @ draw.normal(size=(4, 4)) + 5
    x[:, 3] = 2.5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)
    told = lambda d: np.array([r.features for r in d.orderBy("id").collect()])
    scaled = told(projectors.StandardScaler().fit(df).transform(df))
    sd = x.std(0)
    assert np.allclose(scaled, (x - x.mean(0)) / np.where(sd > 1e-9, sd, 1))
    model = projectors.PCAProjector(2, whiten=True).fit(df)
    got = told(model.transform(df))
    _, s, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (x - x.mean(0)) @ axes[:2].T / (s[:2] / np.sqrt(80))
    assert np.allclose(np.abs(got), np.abs(want)) and all(a[np.abs(a).argmax()] > 0 for a in model.axes)
    assert len(projectors.PCAProjector(0.999).fit(df).axes) <= 3 and np.isclose(projectors.PCAProjector().fit(df).explained.sum(), 1)


def test_run_index_rules(spark):
    rows = spark.createDataFrame([("a", "c1", "2024-01-01", 0.5, 9.0), ("b", "c1", "2024-03-01", 0.6, 8.0), ("c", "c2", None, 0.7, 7.0), ("d", "c1", "2024-03-01", 0.4, 6.0)], "run string, category string, timestamp_utc string, auroc double, latency_ms double")
    assert runs.latest(rows).first().run == "d" and runs.latest(rows, category="c2").first().run == "c"
    assert runs.latest(rows, like="B").first().run == "b" and runs.latest(rows, category="none").count() == 0
    verdicts = {(r.run, r.metric): r.verdict for r in runs.compare(rows.where("category = 'c1'"), "a", ["auroc", "latency_ms"]).collect()}
    assert verdicts == {("b", "auroc"): "improved", ("b", "latency_ms"): "improved", ("d", "auroc"): "regressed", ("d", "latency_ms"): "improved"}
    split = spark.createDataFrame([(f"p{i}", "test" if i % 3 else "train") for i in range(50)], "image_path string, assigned_split string")
    same = runs.split_fingerprint(split)
    assert same == runs.split_fingerprint(split.repartition(7).orderBy(F.desc("image_path")))
    assert same != runs.split_fingerprint(split.where("image_path <> 'p3'")) and same != runs.split_fingerprint(split.withColumn("assigned_split", F.lit("test")))
