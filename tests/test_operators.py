"""Known answers and properties of detectors, metrics, calibration, maps and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlens.functions import maps
from oddlens.operators import calibration, distance_covariance, ensembles, graph_scores, kernels, linear, marginal, metrics, neighbours, randomised  # noqa: F401
from oddlens.operators.registry import create_model, model_names
from oddlens.sources import manifest
from oddlens.streaming import watch


@pytest.fixture(scope="module")
def cloud(spark):
    """60 rows about the origin and two far out, ids 60 and 61."""
    x = np.concatenate([np.random.default_rng(0).normal(size=(60, 4)), [[9.0] * 4, [-8.0, 9.0, -9.0, 8.0]]])
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").persist()


#: Scores that don't rank these two first by design: local angle, in-degree or path ideas on so few rows.
LOOSE = {"core_imdd", "core_lmdd", "core_qmcd", "core_kpca", "core_kde_ratio", "core_loci", "core_dcorr", "core_lid", "core_ldof", "core_sod", "core_dbscan", "core_inne", "core_odin", "core_rgraph", "core_neighborhood_entropy", "core_abod", "core_extra_trees_density", "core_pca", "core_gmm", "core_ocsvm", "core_mst_outlier", "core_studentized_residual", "core_cook_distance"}
QUICK = sorted(n for n in model_names() if not n.startswith(("core_feature_bagging", "core_lscp")) and n not in LOOSE)


@pytest.mark.parametrize("name", QUICK)
def test_detector_ranks_outliers_first(cloud, name):
    how = {"core_pca_md": {"n_components": 4}, "core_kmeans": {"n_clusters": 1}, "core_cblof": {"n_clusters": 1}, "core_crossmad": {"num_prototypes": 1, "normalize": False}}.get(name, {})
    if "cosine" in name:
        pytest.skip("direction only")
    model = create_model(name, **how).fit(cloud)
    scores = model.train_scores.toPandas().set_index("id").score
    assert len(scores) == 62 and np.isfinite(scores).all()
    assert scores[[60, 61]].mean() > scores[:60].mean()
    assert model.decision_function(cloud.limit(3)).count() == 3


@pytest.mark.parametrize("name", ["core_lof", "core_kpca", "core_gmm", "core_ocsvm", "core_abod"])
def test_detector_scores_are_finite(cloud, name):
    assert np.isfinite(create_model(name).fit(cloud).train_scores.toPandas().score).all()


def test_contract(cloud):
    model = create_model({"name": "core_ecod", "kwargs": {"contamination": 0.1}}).fit(cloud)
    labels = model.fit_predict(cloud)
    assert labels.agg(F.sum("label")).first()[0] <= 7
    proba = model.predict_proba(cloud).agg(F.min("probability"), F.max("probability")).first()
    assert proba[0] == 0 and proba[1] == 1
    assert model.predict_with_rejection(cloud, 2.0).where("label <> -2").count() == 0
    with pytest.raises(ValueError):
        create_model("core_ecod", contamination=0.9)
    with pytest.raises(KeyError):
        create_model("nothing")


def frame(spark, labels, scores):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, scores)], "label int, score double")


def test_auroc_and_thresholds(spark):
    assert metrics.auroc(frame(spark, [0, 0, 1, 1], [1, 2, 3, 4])).first()[0] == 1
    assert metrics.auroc(frame(spark, [0, 0, 1, 1], [4, 3, 2, 1])).first()[0] == 0
    assert math.isnan(metrics.auroc(frame(spark, [0, 0], [1, 2])).first()[0])
    row = metrics.best_threshold(frame(spark, [0, 0], [1, 2])).first()
    assert row.threshold > 2 and row.value == 0
    pixels = frame(spark, [0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8])
    assert metrics.pixel_segf1(pixels, 0.5).first()[0] == 1 and metrics.background_fpr(pixels, 0.5).first()[0] == 0
    assert calibration.segf1_threshold(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])) == 0.8


def test_aupro_of_a_perfect_map(spark):
    rows = [(0, 1 if i < 4 else 0, float(10 if i < 4 else i / 100)) for i in range(40)]
    assert metrics.pro(spark.createDataFrame(rows, "image_id long, region int, score double")).first()[0] == pytest.approx(1.0)


def table(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, score double")


def told(df):
    return [r.score for r in df.orderBy("id").collect()]


def test_rank_calibration_counts_what_is_not_above(spark):
    draw = np.random.default_rng(11)
    known, asked = np.round(draw.exponential(size=57), 1), np.round(draw.exponential(size=23) * 2 - 0.5, 1)
    got = told(calibration.RankCalibrator().fit(table(spark, known)).transform(table(spark, asked)))
    assert got == pytest.approx([sum(k <= a for k in known) / 57 for a in asked])


def test_pareto_tail_and_its_fallback(spark):
    draw = np.random.default_rng(12)
    few = draw.normal(size=41)
    value, how = calibration.pot_threshold(table(spark, few), 0.05)
    assert how == "quantile_fallback" and value == pytest.approx(np.quantile(few, 0.95))
    many = draw.exponential(3.0, size=4000)
    value, how = calibration.pot_threshold(table(spark, many), 0.01)
    start = np.quantile(many, 0.9)
    over = many[many > start] - start
    ratio = over.mean() ** 2 / over.var(ddof=1)
    shape, scale = (1 - ratio) / 2, over.mean() * (1 + ratio) / 2
    assert how == "pot" and value == pytest.approx(start + scale / shape * (10**shape - 1), rel=1e-6)
    assert abs(value - 3 * math.log(100)) < 1.5  # the true quantile of that distribution
    model = create_model("core_mad", threshold_method="pot", contamination=0.02).fit(spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(many)], "id long, features array<double>"))
    assert model.threshold == pytest.approx(calibration.pot_threshold(model.train_scores, 0.02)[0])


def test_ranks_and_their_means(spark):
    draw = np.random.default_rng(13)
    one, two = draw.permutation(9) * 1.5, np.exp(draw.permutation(9))
    want = (np.argsort(np.argsort(one)) + np.argsort(np.argsort(two))) / 16
    assert told(calibration.combine([table(spark, one), table(spark, two)], "mean_rank")) == pytest.approx(want.tolist())
    assert told(calibration.combine([table(spark, one), table(spark, two)], "mean")) == pytest.approx(((one + two) / 2).tolist())
    tied = told(calibration.rank01(table(spark, [7, 2, 7, 9, 2, 4])))
    assert tied[0] == tied[2] and tied[1] == tied[4] and tied[3] == max(tied) == 1 and tied[1] < tied[5] < tied[0]


def test_regions_and_tiles(spark):
    assert maps.tile_starts(6, 4, 3) == [0, 2]
    rows = [(1, y, x, 1.0 if 2 <= y < 5 and 3 <= x < 7 else 0.0) for y in range(10) for x in range(10)]
    r = maps.defects(spark.createDataFrame(rows, "image_id long, y int, x int, v double"), 0.5).first()
    assert (r.x0, r.y0, r.x1, r.y1, r.area, r.fill_ratio) == (3, 2, 6, 4, 12, 1.0) and r.aspect_ratio == pytest.approx(4 / 3)
    mask = np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0]], bool)
    assert maps.label_components(mask).max() == 1
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert maps.fill_holes(ring).all()
    assert maps.hysteresis(np.array([[1.0, 0.6, 0, 0.6]]), 0.5, 0.9).tolist() == [[True, True, False, False]]
    assert maps.morph(mask.astype(np.uint8), "open", 3).sum() <= mask.sum()


def test_manifest_rules(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('# comment\n\n{"image_path":"a","category":"A","split":"train"}\n{"image_path":"b","category":"A","split":"test","label":1}\n')
    assert manifest.read_manifest(spark, str(path)).count() == 2
    path.write_text('{"image_path":"a","category":"A","split":"test"}\n')
    with pytest.raises(Exception, match="needs a label"):
        manifest.read_manifest(spark, str(path)).collect()


def test_stream_scores_equal_batch_scores(spark, cloud, tmp_path):
    model = create_model("core_hbos").fit(cloud)
    cloud.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long, features array<double>").parquet(str(tmp_path / "in"))
    watch.score_stream(rows, model, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "score").orderBy("id").toPandas()
    want = model.decision_function(cloud).orderBy("id").toPandas()
    assert np.allclose(got.score, want.score)


def test_lscp_searches_once(spark, monkeypatch):
    from oddlens.operators import ensembles, neighbours

    x = np.random.default_rng(4).normal(size=(60, 3))
    train = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    asked, nearest = [], neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda rows, bank, k, *how: asked.append(k) or nearest(rows, bank, k, *how))
    monkeypatch.setattr(ensembles, "nearest", neighbours.nearest)
    model = create_model("core_lscp").fit(train)
    assert asked == [30]
    alone = create_model("core_knn").fit(train).train_scores.collect()
    assert sorted(model.members[1].train_scores.collect()) == sorted(alone)
