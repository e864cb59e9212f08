"""JPEG blocks, light, made defects and patch maps against their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlens.functions import images, synthesis
from oddlens.operators import neighbours, patch_maps  # noqa: F401


def rows(spark, pictures):
    return spark.createDataFrame([(i, p.shape[0], p.shape[1], p.shape[2], [int(v) for v in p.ravel()]) for i, p in enumerate(pictures)], "image_id long, height int, width int, channels int, data array<int>").repartition(2)


def test_blocks_round_coefficients_by_the_table():
    draw = np.random.default_rng(0)
    block, table = draw.integers(0, 256, (8, 8)).astype(float), images.steps(images.LUMA_STEPS, 50)
    assert table[0].tolist() == [16, 11, 10, 16, 24, 40, 51, 61]
    assert images.steps(images.LUMA_STEPS, 100).max() == 1 and images.steps(images.CHROMA_STEPS, 10)[0, 0] == 85
    wave = lambda n, k: math.cos((2 * n + 1) * k * math.pi / 16) * (math.sqrt(1 / 8) if k == 0 else 0.5)
    kept = [[math.floor(sum((block[y, x] - 128) * wave(y, v) * wave(x, u) for y in range(8) for x in range(8)) / table[v, u] + 0.5) * table[v, u] for u in range(8)] for v in range(8)]
    want = [[min(255, max(0, math.floor(sum(kept[v][u] * wave(y, v) * wave(x, u) for v in range(8) for u in range(8)) + 128.5))) for x in range(8)] for y in range(8)]
    assert images.through_blocks(block, table).tolist() == want


@pytest.mark.parametrize("channels", [1, 3])
def test_jpeg_errs_more_at_lower_quality(channels):
    y, x = np.mgrid[0:21, 0:30]
    picture = np.stack([127 + 80 * np.sin(x / 5 + c) * np.cos(y / 4) for c in range(channels)], -1).round()
    errors = [np.abs(images.jpeg_at(picture, q) - picture).mean() for q in (100, 90, 50, 10)]
    assert images.jpeg_at(picture, 50).shape == picture.shape and errors == sorted(errors) and errors[0] < (1 if channels == 1 else 4) < errors[3]  # halved colour planes lose some at any quality
    flat = np.full((5, 7, channels), 200.0)
    assert np.abs(images.jpeg_at(flat, 75) - flat).max() <= 2


@pytest.mark.parametrize("name", list(images.CORRUPTIONS))
def test_corruptions_depend_on_seed_and_id_alone(spark, name):
    table = rows(spark, [np.random.default_rng(i).integers(60, 180, (12, 14, 3)) for i in range(4)])
    got = [{r.image_id: r.data for r in images.corrupt(t, name, 4, 3).collect()} for t in (table, table.repartition(1))]
    assert got[0] == got[1] and all(0 <= v <= 255 for d in got[0].values() for v in d)
    assert any(got[0][i] != r.data for i, r in enumerate(table.orderBy("image_id").collect()))


def test_glare_only_brightens_and_lighting_grows():
    picture = np.full((20, 30, 3), 100.0)
    moved = [np.abs(images.lighting(picture, s, np.random.default_rng(4)) - 100).max() for s in (1, 3, 5)]
    assert moved == sorted(moved)
    lit = images.glare(picture, 3, np.random.default_rng(1))
    assert (lit >= 100).all() and lit.max() > 130 and lit.max() <= 255


def test_poisson_takes_gradients_inside_and_nothing_outside():
    draw = np.random.default_rng(2)
    target, source, mask = draw.random((17, 19)) * 50, draw.random((17, 19)) * 50, np.zeros((17, 19), bool)
    mask[3:15, 4:16] = True
    out = synthesis.poisson_blend(target, source, mask)
    assert (out[~mask] == target[~mask]).all()
    pull = lambda p: p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    deep = np.zeros_like(mask)
    deep[4:14, 5:15] = True
    assert np.abs(pull(out) - pull(source))[deep[1:-1, 1:-1]].max() < 1e-9
    whole = np.ones((6, 5), bool)
    assert np.isfinite(synthesis.poisson_blend(target[:6, :5], source[:6, :5], whole)).all()
    assert np.allclose(synthesis.poisson_blend(target, target + 7, mask), target)  # the same gradients


@pytest.mark.parametrize("preset", list(synthesis.PRESETS))
def test_made_defects_stay_in_their_mask(spark, preset):
    pictures = [np.random.default_rng(i).integers(40, 200, (24, 18 + i, 1 + 2 * (i % 2))) for i in range(3)]
    table = rows(spark, pictures)
    got = {r.image_id: r for r in synthesis.synthesise(table, preset, 1).collect()}
    again = {r.image_id: r.data for r in synthesis.synthesise(table.repartition(1), preset, 1).collect()}
    for i, p in enumerate(pictures):
        mask, data = np.array(got[i].mask).reshape(p.shape[:2]) == 1, np.array(got[i].data).reshape(p.shape)
        assert (data[~mask] == p[~mask]).all() and 0 < mask.mean() < 0.6 and (data[mask] != p[mask]).any()
        assert got[i].label == 1 and again[i] == got[i].data
    odd = spark.createDataFrame([(1, 2, 2, 1, None), (2, 3, 3, 1, [1])], table.schema)
    assert all(r.data is None and r.mask is None and r.label is None for r in synthesis.synthesise(odd, preset).collect())


def test_noise_is_smooth_and_seeded():
    a, b = (synthesis.fractal_noise(40, 33, 3, 1, np.random.default_rng(5)) for _ in range(2))
    assert (a == b).all() and a.min() == 0 and a.max() == 1
    assert np.abs(np.diff(a, axis=0)).max() < 0.25 and np.abs(np.diff(a, axis=1)).max() < 0.25


def test_patch_map_finds_the_square(spark):
    draw = np.random.default_rng(0)
    normal = [draw.integers(90, 110, (24, 30, 1)) for _ in range(12)]
    odd = draw.integers(90, 110, (24, 30, 1))
    odd[8:14, 16:24] = 220
    model = patch_maps.PatchEmbeddingMap(detector="core_knn", size=4, stride=2).fit(rows(spark, normal))
    found = model.maps(rows(spark, [odd]))
    top = found.orderBy(F.desc("v")).limit(20).collect()
    assert found.count() == 24 * 30 and all(6 <= r.y < 16 and 14 <= r.x < 26 for r in top)
    assert model.score(rows(spark, [odd])).first().score > 3 * model.score(rows(spark, normal)).agg(F.max("score")).first()[0]


def test_patches_reach_the_edges_and_interpolate():
    picture = np.arange(35.0).reshape(5, 7, 1)
    assert [(y, x) for y, x, _ in patch_maps.patches(picture, 3, 3)] == [(0, 0), (0, 3), (0, 4), (2, 0), (2, 3), (2, 4)]
    assert np.allclose(patch_maps.spread(np.array([1.0, 3.0]), np.array([1.0, 3.0]), 5, True) @ [10, 20], [10, 10, 15, 20, 20])
    assert (patch_maps.spread(np.array([1.0, 3.0]), np.array([0.5, 2.5]), 4, False) @ [10, 20]).tolist() == [10, 10, 20, 20]


def test_pooled_patches(spark):
    grid = patch_maps.patch_grid(rows(spark, [np.array([[0, 255], [255, 255]])[..., None]]), 1)
    assert np.allclose(patch_maps.pooled(grid).first().features, [0.75, 1.0, math.sqrt(3) / 4])


def test_equal_patches_are_described_once(spark, monkeypatch):
    """Features used to be taken of each patch, also of those that many images share."""
    draw = np.random.default_rng(3)
    pictures = [draw.integers(0, 255, (6, 9, 1)).astype(float) for _ in range(3)]
    made = rows(spark, [*pictures, *pictures, pictures[0], np.zeros((8, 8, 1))])
    described = []
    monkeypatch.setattr(patch_maps, "settle", lambda df, settle=patch_maps.settle: described.append(settle(df)) or described[-1])
    got = {(r.image_id, r.py, r.px): r.features for r in patch_maps.patch_grid(made, 4, 2, "edge_stats").collect()}
    want = {(k, y, x): images.EXTRACTORS["edge_stats"](p) for k, picture in enumerate([*pictures, *pictures, pictures[0], np.zeros((8, 8, 1))]) for y, x, p in patch_maps.patches(picture, 4, 2)}
    assert len(got) == len(want) and len({k[0] for k in got}) == 8
    first = min(k[0] for k in got)
    assert all(np.allclose(got[k + first, y, x], v) for (k, y, x), v in want.items())
    assert described[-1].count() == len({p.tobytes() for picture in [*pictures, np.zeros((8, 8, 1))] for _, _, p in patch_maps.patches(picture, 4, 2)})
