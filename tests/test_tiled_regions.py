"""Regions found tile by tile are those found on the whole image, however it is cut."""

from types import SimpleNamespace

import numpy as np
import pytest

from oddlens.functions import maps, tiled_regions

OPTIONS = [
    {},
    {"min_area": 4, "max_aspect": 3.0, "min_solidity": 0.6},
    {"smoothing": "box", "smoothing_size": 3, "border": 2},
    {"open_size": 3, "close_size": 3, "fill": True},
    {"fill": True, "dilate": 3, "roi": (0.1, 0.0, 0.9, 0.8), "min_fill": 0.2},
    {"merge_gap": 1, "score_quantile": 0.5, "sort_by": "area", "max_regions": 5, "low": 0.5},
    {"smoothing": "gaussian", "smoothing_size": 5, "low": 0.45, "close_size": 5, "fill": True, "dilate": 2, "min_score_mean": 0.5},
]


def pictures():
    """Noise, a spiral through all tiles, a ring, a full image, one row, one pixel, nothing."""
    draw = np.random.default_rng(8)
    noise = maps.smooth(draw.random((23, 31)), "box", 3) * 1.6 - 0.3
    spiral = np.zeros((21, 21))
    y, x, dy, dx, n = 0, 0, 0, 1, 20
    for turn in range(18):
        for _ in range(n):
            spiral[y, x] = 0.7 + 0.01 * turn
            y, x = min(max(y + dy, 0), 20), min(max(x + dx, 0), 20)
        dy, dx = dx, -dy
        n -= 2 if turn % 2 == 1 else 0
        if n <= 0:
            break
    ring = np.zeros((17, 13))
    ring[2:14, 3:11] = 0.9
    ring[5:10, 5:9] = 0.1
    diagonal = np.eye(19) * 0.8
    return [noise, spiral, ring, diagonal, np.full((9, 10), 0.8), np.full((1, 14), 0.65), np.full((1, 1), 0.9), np.zeros((6, 6))]


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(i, y, x, float(p[y, x])) for i, p in enumerate(pictures()) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v double").repartition(4).cache()


def told(df):
    rows = [r.asDict() for r in df.collect()]
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c.split()[0]] for c in maps.REGION.split(", "))) for r in rows)


@pytest.mark.parametrize(("tile", "how"), [(7, OPTIONS[1]), (5, OPTIONS[2]), (7, OPTIONS[4]), (6, OPTIONS[5]), (6, OPTIONS[6])])
def test_tiles_give_the_regions_of_the_whole(pixels, tile, how):
    assert told(tiled_regions.defects(pixels, 0.6, tile=tile, **how)) == told(maps.defects(pixels, 0.6, **how))


@pytest.mark.parametrize("tile", [8])
def test_labels_are_those_of_the_whole(pixels, tile):
    got = {(r.image_id, r.y, r.x): r.region for r in tiled_regions.labelled(pixels, 0.6, tile).collect()}
    want = {}
    for i, p in enumerate(pictures()):
        labels = maps.label_components(p >= 0.6)
        want |= {(i, int(y), int(x)): int(labels[y, x]) for y, x in zip(*np.nonzero(labels), strict=True)}
    assert got == want


def test_no_pixels(spark):
    assert tiled_regions.defects(spark.createDataFrame([], "image_id long, y int, x int, v double"), 0.5).count() == 0


def test_row_ends_have_the_hull_of_all_corners():
    draw = np.random.default_rng(1)
    for _ in range(30):
        y, x = np.nonzero(draw.random((7, 8)) < 0.3)
        if len(x):
            corners = [(int(a) + c, int(b) + d) for a, b in zip(x, y, strict=True) for c in (0, 1) for d in (0, 1)]
            assert maps.hull(*maps.row_ends(x, y)) == maps.hull([c[0] for c in corners], [c[1] for c in corners])


def test_tiles_of_a_batch_are_labelled_apart():
    import pyarrow as pa

    draw = np.random.default_rng(9)
    keys = {"ty": [0, 0, 1, 1, 0], "tx": [0, 1, 0, 1, 0], "height": [7] * 5, "width": [6] * 5}
    shapes = [tiled_regions._shape(SimpleNamespace(**{c: v[k] for c, v in keys.items()}), 4) for k in range(5)]
    masks, values = [draw.random(s) < 0.6 for s in shapes], [draw.random(s) for s in shapes]
    batch = pa.RecordBatch.from_pydict({"image_id": [1, 1, 1, 1, 2], **keys, "values": [v.tobytes() for v in values], "mask": [m.tobytes() for m in masks]})
    seen = 0
    for at, stack, _, labels, key in tiled_regions._stacks(batch, 4):
        of, found = tiled_regions.stack_parts(labels, stack, key, 4)
        for k, place in enumerate(at):
            want = maps.find_regions(values[place], masks[place])
            assert found["area"][of == k].tolist() == [r["area"] for r in want]
            assert np.round(found["v_max"][of == k], 6).tolist() == [r["score_max"] for r in want]
            assert (found["x0"][of == k] - keys["tx"][place] * 4).tolist() == [r["x0"] for r in want]
            seen += 1
    assert seen == 5
