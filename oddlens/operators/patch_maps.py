"""Anomaly maps from patches: image rows cut to patch vectors, any detector on the table of patches, scores put back to pixels.

An image is a row and gives as many patch rows as fit; the detector sees one table of all patches. Scores are gathered
by image (one number a patch) and interpolated between patch centres, or every pixel takes the nearest patch's.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.functions.images import EXTRACTORS, IMAGE, gray, rows_of
from oddlens.functions.maps import tile_starts
from oddlens.operators.pixel_maps import _PixelMap
from oddlens.operators.registry import create_model
from oddlens.sources.scratch import settle, with_row_id


def patches(image: np.ndarray, size: int, stride: int) -> list[tuple[int, int, np.ndarray]]:
    """(y, x, patch) in reading order; the last ones end at the image's edges."""
    h, w, _ = image.shape
    return [(y, x, image[y : y + size, x : x + size]) for y in tile_starts(h, size, stride) for x in tile_starts(w, size, stride)]


PATCH = ["ph", "pw", "pc", "pixels"]


def _cut(batches, size: int, stride: int, plain: bool):
    """Patches with their grey values, or else as they are: shape and pixels."""
    for part, images in rows_of(batches):
        ids, places, shapes, values = [], [], [], []
        for key, image in zip(part.column("image_id").to_pylist(), images, strict=True):
            for y, x, patch in patches(image, size, stride) if image is not None else []:
                ids.append(key)
                places.append((*image.shape[:2], y, x))
                shapes.append(patch.shape)
                values.append(gray(patch).ravel() / 255 if plain else patch.tobytes())
        columns = [pa.array(ids, part.column("image_id").type), *(pa.array([v[k] for v in places], pa.int32()) for k in range(4))]
        names = ["image_id", "height", "width", "py", "px"]
        if plain:
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.list_(pa.float64()))], [*names, "features"])
        else:
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([v[k] for v in shapes], pa.int32()) for k in range(3)), pa.array(values, pa.binary())], [*names, *PATCH])


def _described(batches, features: str, how: dict):
    for batch in batches:
        shapes = zip(*(batch.column(c).to_pylist() for c in PATCH[:3]), strict=True)
        found = [EXTRACTORS[features](np.frombuffer(v).reshape(shape), **how) for shape, v in zip(shapes, batch.column("pixels").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*PATCH, "features"])


def patch_grid(images: DataFrame, size: int = 8, stride: int | None = None, features: str | None = None, **how) -> DataFrame:
    """(image_id, height, width, py, px, features) of each patch: its grey values as parts of 255, or an extractor's features, taken once of equal patches."""
    place = f"image_id {images.schema['image_id'].dataType.simpleString()}, height int, width int, py int, px int"
    cut = partial(_cut, size=size, stride=stride or size, plain=features is None)
    if features is None:
        return images.select(*IMAGE).mapInArrow(cut, f"{place}, features array<double>")
    shape = "ph int, pw int, pc int, pixels binary"
    each = settle(images.select(*IMAGE).mapInArrow(cut, f"{place}, {shape}"))
    many = 4 * images.sparkSession.sparkContext.defaultParallelism
    different = each.select(*PATCH).distinct().repartition(many)  # small rows, much work on each
    found = settle(different.mapInArrow(partial(_described, features=features, how=how), f"{shape}, features array<double>"))
    return each.join(found, PATCH).select("image_id", "height", "width", "py", "px", "features")


def pooled(grid: DataFrame) -> DataFrame:
    """(id, features): mean, maximum and deviation over an image's patches, one after the other."""
    each = grid.select("image_id", F.posexplode("features").alias("j", "v"))
    figures = each.groupBy("image_id", "j").agg(F.avg("v").alias("a"), F.max("v").alias("b"), F.stddev_pop("v").alias("c"))
    by = figures.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("j", "a", "b", "c"))).alias("f"))
    return by.select(F.col("image_id").alias("id"), F.concat(*(F.expr(f"transform(f, s -> s.{c})") for c in "abc")).alias("features"))


def spread(values: np.ndarray, at: np.ndarray, n: int, linear: bool) -> np.ndarray:
    """(n, len(at)) weights by which values at the centres ``at`` give n pixels."""
    pixels = np.arange(n)
    if not linear or len(at) == 1:
        nearest = np.abs(pixels[:, None] - at).argmin(1)  # of two, the first
        return np.eye(len(at))[nearest]
    high = np.clip(np.searchsorted(at, pixels), 1, len(at) - 1)
    t = np.clip((pixels - at[high - 1]) / (at[high] - at[high - 1]), 0, 1)
    out = np.zeros((n, len(at)))
    out[pixels, high - 1] += 1 - t
    out[pixels, high] += t
    return out


def _put_back(frames, size: int, linear: bool):
    for pdf in frames:
        for r in pdf.itertuples():
            cells = sorted((c["py"], c["px"], c["score"]) for c in r.cells)
            ys, xs = (np.array(sorted({c[k] for c in cells})) for k in (0, 1))
            values = np.array([c[2] for c in cells]).reshape(len(ys), len(xs))
            middle = lambda at, n: at + (min(size, n) - 1) / 2
            grid = spread(values, middle(ys, r.height), r.height, linear) @ values @ spread(values, middle(xs, r.width), r.width, linear).T
            y, x = np.mgrid[0 : r.height, 0 : r.width]
            yield pd.DataFrame({"image_id": r.image_id, "y": y.ravel(), "x": x.ravel(), "v": grid.ravel()})


class PatchEmbeddingMap(_PixelMap):
    """``detector`` (a name, spec or model) learns the patches of normal images; maps are its scores of patches."""

    defaults = {"detector": "core_knn", "size": 8, "stride": None, "features": None, "interpolation": "linear", "extractor": {}}

    def _patches(self, images: DataFrame) -> DataFrame:
        return with_row_id(patch_grid(images, self.how["size"], self.how["stride"], self.how["features"], **self.how["extractor"]))

    def fit(self, images: DataFrame) -> PatchEmbeddingMap:
        self.model = create_model(self.how["detector"]).learn(self._patches(images).select("id", "features"))
        return self

    def maps(self, images: DataFrame) -> DataFrame:
        rows = self._patches(images)
        scored = rows.select("id", "image_id", "height", "width", "py", "px").join(self.model.decision_function(rows), "id")
        by = scored.groupBy("image_id", "height", "width").agg(F.collect_list(F.struct("py", "px", "score")).alias("cells"))
        put = partial(_put_back, size=self.how["size"], linear=self.how["interpolation"] == "linear")
        return by.mapInPandas(put, f"image_id {images.schema['image_id'].dataType.simpleString()}, y int, x int, v double")
