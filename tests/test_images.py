"""Extractors, corruptions and pixel maps on small images with known answers, and on awkward rows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddlens.functions import images, maps
from oddlens.operators import pixel_maps
from oddlens.sources import manifest

SCHEMA = "image_id long, height int, width int, channels int, data array<int>, note string"


def row(key, image):
    image = np.asarray(image)
    image = image[..., None] if image.ndim == 2 else image
    return (key, *image.shape, image.astype(int).ravel().tolist(), "x")


@pytest.fixture(scope="module")
def frames(spark):
    """Twelve noisy images of one texture; the last three hold a bright square."""
    draw = np.random.default_rng(4)
    base = images.blurred(draw.uniform(0, 255, (32, 32)), 1.0)
    rows = []
    for k in range(12):
        image = np.clip(base + draw.normal(0, 3, (32, 32)), 0, 255)
        if k >= 9:
            image[8:16, 4 * (k - 8) : 4 * (k - 8) + 8] = 240
        rows.append(row(k, image))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("name", "n"), [("structural", 15), ("color_hist", 48), ("edge_stats", 6), ("hog", 8100), ("lbp", 10), ("fft_lowfreq", 3), ("gabor_bank", 24), ("patch_stats", 64), ("multi", 54)])
def test_extractors(spark, name, n):
    draw = np.random.default_rng(1)
    colour = draw.integers(0, 256, (20, 30, 3))
    rows = [row(1, colour), row(2, colour), (3, 20, 30, 3, None, "x"), (4, 20, 30, 3, [1, 2], "x"), row(None, np.full((20, 30, 3), 7))]
    got = {r.id: r.features for r in images.extract(spark.createDataFrame(rows, SCHEMA), name).collect()}
    assert len(got[1]) == n and got[1] == got[2] and got[3] is None and got[4] is None and np.isfinite(got[None]).all()
    assert images.extract(spark.createDataFrame([], SCHEMA), name).count() == 0


def test_extractors_on_known_images():
    square = np.zeros((40, 40, 1))
    square[10:30, 10:30] = 200
    found = images.edges(square[..., 0], 50, 150)
    assert 60 <= found.sum() <= 90 and not found[15:25, 15:25].any() and not found[:8].any()
    assert images.lbp(np.full((6, 6, 1), 9))[8] >= 0.4  # all neighbours equal, but for the borders
    assert images.fft_lowfreq(np.full((64, 64, 1), 50.0)) == pytest.approx([1, 1, 1])
    assert images.structural(square)[12:14] == pytest.approx([1, 1])
    assert images.to_hsv(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], float))[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 9]]
    assert images.to_lab(np.array([[[255, 255, 255], [0, 0, 0]]], float))[0].tolist() == [[255, 128, 128], [0, 128, 128]]
    assert images.resize(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    waves = np.tile(np.cos(2 * np.pi * 0.2 * np.arange(128)) * 100 + 120, (128, 1))[..., None]
    bank = np.array(images.gabor_bank(waves))[::2].reshape(3, 4)
    assert bank.argmax() == 4  # frequency 0.2, along x


@pytest.mark.parametrize("kind", ["mean", "gaussian", "mad", *pixel_maps.MAPS])
def test_pixel_maps_find_the_square(frames, kind):
    if kind in pixel_maps.MAPS:
        rows, model = frames, pixel_maps.TemplateMap(kind=kind)
    else:
        flat = frames.select("image_id", "width", F.posexplode("data").alias("k", "v"))
        rows = flat.select("image_id", (F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).alias("x"), "v")
        model = {"mean": pixel_maps.MeanAbsDiffMap, "gaussian": pixel_maps.GaussianMap, "mad": pixel_maps.MADMap}[kind]()
    model.fit(rows.where("image_id < 6"))
    score = {r.image_id: r.score for r in model.score(rows).collect()}
    flat, odd = [score[k] for k in range(1, 9)], [score[k] for k in (9, 10, 11)]
    assert len(score) == 12 and (np.mean(odd) > np.mean(flat) if kind == "ssim_struct_map" else min(odd) > max(flat))
    spot = {r.image_id: r.v for r in model.maps(rows).where("y = 12 AND x = 10").collect()}
    assert np.isfinite(list(spot.values())).all()


def test_alignment_finds_the_shift():
    draw = np.random.default_rng(3)
    big = images.blurred(draw.uniform(0, 255, (60, 60)), 2)
    moved = pixel_maps.aligned_map(big[10:50, 12:52], big[13:53, 10:50])
    assert moved[8:-8, 8:-8].max() < 1e-6


@pytest.mark.parametrize("name", list(images.CORRUPTIONS))
def test_corruptions(frames, name):
    a, b = (images.corrupt(frames, name, 5, 1).orderBy("image_id").toPandas() for _ in range(2))
    assert [list(x) for x in a.data] == [list(x) for x in b.data]
    before = frames.orderBy("image_id").toPandas()
    assert any(list(x) != list(y) for x, y in zip(a.data, before.data, strict=True)) and all(0 <= v <= 255 for x in a.data for v in x)
    with pytest.raises(ValueError):
        images.corrupt(frames, name, 6)


def test_defects_in_full(spark):
    values = np.zeros((20, 20))
    values[2:5, 2:6], values[2:5, 7:9], values[12:18, 12] = 0.9, 0.8, 0.7
    rows = [(1, y, x, float(values[y, x])) for y in range(20) for x in range(20)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, v double")

    def found(**how):
        return [(r.x0, r.y0, r.x1, r.y1, r.area) for r in maps.defects(pixels, 0.5, **how).orderBy("region").collect()]

    left, right, line = (2, 2, 5, 4, 12), (7, 2, 8, 4, 6), (12, 12, 12, 17, 6)
    assert found() == [left, right, line]
    assert found(merge_gap=1) == [(2, 2, 8, 4, 18), line]
    assert found(max_aspect=3) == [left, right] and found(min_score_max=0.75) == [left, right] and found(min_area=7) == [left]
    assert found(roi=(0, 0, 0.3, 1)) == [left] and found(score_quantile=0.5) == [left, right] and found(sort_by="area", max_regions=1) == [left]
    assert [r.solidity for r in maps.defects(pixels, 0.5).collect()] == [1, 1, 1]
    assert maps.hull_area(np.array([0, 1, 2, 0]), np.array([0, 0, 0, 1])) == 5
    steady = maps.cleaned(pixels, "minmax", component_threshold=0.5, min_area=7).where("v > 0").count()
    assert steady == 12 and maps.cleaned(pixels, "percentile", sigma=1.0, open_size=3, close_size=3).count() == 400
    assert maps.scale_box((2, 2, 5, 4), (20, 20), (40, 10)) == (1, 4, 2, 9)
    assert maps.pixel_threshold(value=0.4) == 0.4 and maps.pixel_threshold(pixels.withColumnRenamed("v", "score"), strategy="normal_pixel_quantile", quantile=1.0) == 0.9


def test_hann_weights_stitch_what_was_cut(spark):
    rows = [(1, y, x, float(3 * y + x)) for y in range(9) for x in range(11)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, v double")
    cut = maps.cut_tiles(pixels, maps.tiles(spark.createDataFrame([(1, 9, 11)], "image_id long, height int, width int"), 4, 3))
    marked = cut.withColumn("v", F.col("v") + (F.col("y0") + F.col("x0")) * 0)
    got = maps.stitch(maps.hann_weights(marked, 4, 4), "hann")
    assert {(r.y, r.x): pytest.approx(r.v) for r in got.collect()} == {(y, x): v for _, y, x, v in rows}
    # Two tiles that differ: at x = 3 of a row of 7, both weigh the floor, so the value is their mean.
    two = spark.createDataFrame([(1, 0, 0, 0, k, 1.0) for k in range(4)] + [(1, 0, 3, 0, k, 3.0) for k in range(4)], "image_id long, y0 int, x0 int, y int, x int, v double")
    assert {r.x: r.v for r in maps.stitch(maps.hann_weights(two, 1, 4), "hann").collect()}[3] == pytest.approx(2.0)


def test_benchmark_split_keeps_groups_together(spark):
    rows = [(f"p{i}", "c", None, 1 if i == 7 else 0, None, f"g{i // 4}", None) for i in range(400)]
    rows += [("q", "c", "train", 0, None, "h", None), ("r", "c", None, 0, None, "h", None), ("s", "c", None, 1, None, None, None)]
    table = spark.createDataFrame(rows, manifest.SCHEMA)
    got = manifest.benchmark_split(table, 0.25, 3)
    assert got.count() == 403 and got.groupBy("group_id").agg(F.count_distinct("assigned_split").alias("n")).where("n > 1").count() == 0
    by = {r.image_path: r.assigned_split for r in got.collect()}
    assert by["p7"] == "test" and by["r"] == "train" and by["s"] == "test" and 60 <= sum(v == "test" for v in by.values()) <= 140
    again = {r.image_path: r.assigned_split for r in manifest.benchmark_split(table.repartition(5), 0.25, 3).collect()}
    assert again == by


def test_gabor_bank_transforms_an_image_once(monkeypatch):
    plane = np.random.default_rng(3).integers(0, 255, (16, 16, 1)).astype(float)
    first = images.gabor_bank(plane)
    calls, fft2 = [], np.fft.fft2
    monkeypatch.setattr(images.np.fft, "fft2", lambda *how: calls.append(1) or fft2(*how))
    assert images.gabor_bank(plane) == first
    assert len(calls) == 1


def test_images_of_many_pixels_with_gaps(spark):
    """Looking every place up among all pixels would be some billions of steps here."""
    side, draw = 300, np.random.default_rng(8)
    want = draw.integers(1, 256, side * side)
    gone = draw.random(side * side) < 0.3
    gone[[0, 1, -1]] = True
    want[gone] = 0
    at = spark.createDataFrame(pd.DataFrame({"p": np.flatnonzero(~gone), "v": want[~gone]}))
    pixels = at.select(F.lit(7).alias("image_id"), F.expr(f"p div {side}").cast("int").alias("y"), F.expr(f"p % {side}").cast("int").alias("x"), "v")
    beyond = spark.createDataFrame([(7, side, 0, 9), (7, 0, side, 9), (7, -1, 5, 9)], "image_id int, y int, x int, v long")
    began = time.perf_counter()
    row = images.images_of(pixels.union(beyond), side, side).first()
    assert time.perf_counter() - began < 30
    assert row.data == want.tolist()
    empty = spark.createDataFrame([(1, 0, 1, None), (1, 1, 0, 4)], "image_id int, y int, x int, v int")
    assert images.images_of(empty, 2, 2).first().data == [0, 0, 4, 0]
    with pytest.raises(Exception, match="given twice"):
        images.images_of(empty.union(empty), 2, 2).collect()


def test_images_of_tables_are_dealt_to_all_cores(spark, tmp_path):
    """Their rows are small, so Spark would leave them in one or two parts, however long the work on a row takes."""
    from oddlens.plans import pixels

    spark.range(4000).selectExpr("id % 500 AS l_suppkey", "id AS l_partkey", "cast(id % 50 AS double) AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = pixels._images(spark, str(tmp_path))
    assert found.count() == 500 and found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
