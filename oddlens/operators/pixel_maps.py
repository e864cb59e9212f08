"""Anomaly maps against a template of aligned normal images, on long tables (image_id, y, x, v in 0 to 255).

Templates by pixel (mean, deviation, median) are group-bys over (y, x) and maps are joins with them: one row for each
pixel of one image, so the template is small and the join broadcast while it is. Maps that need a neighbourhood
(correlation, structural similarity, alignment) compare image rows with one template image, the first by image_id.
``score`` reduces a map by the mean of its highest part.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlens.functions.images import IMAGE, blurred, edges, gray, pixels_of, rows_of
from oddlens.functions.maps import reduce_map
from oddlens.sources.scratch import settle


class _PixelMap:
    """``fit`` on normal images; ``maps`` gives (image_id, y, x, v), ``score`` (image_id, score)."""

    def __init__(self, reduction: str = "topk_mean", topk: float = 0.01, **how):
        self.reduction, self.topk = reduction, topk
        self.how = {**self.defaults, **how}

    defaults: dict = {}

    def score(self, rows: DataFrame) -> DataFrame:
        return reduce_map(self.maps(rows), self.reduction, self.topk)


class _ByPixel(_PixelMap):
    def fit(self, pixels: DataFrame) -> _ByPixel:
        self.template = settle(self._template(pixels))
        return self

    def maps(self, pixels: DataFrame) -> DataFrame:
        return pixels.join(self.template, ["y", "x"]).select("image_id", "y", "x", self._value().alias("v"))

    def _template(self, pixels: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _value(self) -> Column:
        raise NotImplementedError


class MeanAbsDiffMap(_ByPixel):
    """Distance to the mean image, as a part of 255."""

    def _template(self, pixels):
        return pixels.groupBy("y", "x").agg(F.avg("v").alias("mu"))

    def _value(self):
        return F.least(F.abs(F.col("v") - F.col("mu")) / 255, F.lit(1.0))


class GaussianMap(_ByPixel):
    """Distance to the mean in deviations (at least ``std_floor``)."""

    defaults = {"std_floor": 1.0, "eps": 1e-6}

    def _template(self, pixels):
        return pixels.groupBy("y", "x").agg(F.avg("v").alias("mu"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))

    def _value(self):
        return F.abs(F.col("v") - F.col("mu")) / (F.greatest("sd", F.lit(max(self.how["std_floor"], self.how["eps"]))) + self.how["eps"])


class MADMap(_ByPixel):
    """Distance to the median in median absolute deviations. Values are few, so a pixel's medians come from their counts."""

    defaults = {"mad_floor": 1.0, "eps": 1e-6, "consistency_correction": True}

    def _template(self, pixels):
        middle = settle(pixels.groupBy("y", "x").agg(F.percentile("v", 0.5).alias("med")))
        off = pixels.join(middle, ["y", "x"])
        return off.groupBy("y", "x", "med").agg(F.percentile(F.abs(F.col("v") - F.col("med")), 0.5).alias("mad"))

    def _value(self):
        floor = max(self.how["mad_floor"], self.how["eps"])
        k = 0.6745 if self.how["consistency_correction"] else 1.0
        return k * F.abs(F.col("v") - F.col("med")) / (F.greatest("mad", F.lit(floor)) + self.how["eps"])


def _box(plane: np.ndarray, size: int) -> np.ndarray:
    """Sums over windows, mirrored at the borders."""
    r = size // 2
    wide = np.pad(plane, r, mode="symmetric" if min(plane.shape) >= r else "edge")
    total = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def correlation_map(image: np.ndarray, template: np.ndarray, window: int = 11, eps: float = 1e-6) -> np.ndarray:
    """(1 - local normalised cross-correlation) / 2."""
    q, t, n = image - template.mean(), template - template.mean(), window * window
    sums = [_box(x, window) for x in (q, t, q * q, t * t, q * t)]
    over = np.sqrt(np.maximum(sums[2] - sums[0] ** 2 / n, 0) * np.maximum(sums[3] - sums[1] ** 2 / n, 0)) + eps
    return np.clip((1 - (sums[4] - sums[0] * sums[1] / n) / over) / 2, 0, 1)


def similarity_map(image: np.ndarray, template: np.ndarray, window: int = 7) -> np.ndarray:
    """1 - structural similarity, cut to 0..1."""
    n = window * window
    a, b, aa, bb, ab = (_box(x, window) / n for x in (image, template, image**2, template**2, image * template))
    k = n / (n - 1)
    va, vb, vab = k * (aa - a * a), k * (bb - b * b), k * (ab - a * b)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return np.clip(1 - (2 * a * b + c1) * (2 * vab + c2) / ((a * a + b * b + c1) * (va + vb + c2)), 0, 1)


def structure_map(image: np.ndarray, template: np.ndarray, window: int = 7) -> np.ndarray:
    """The same of the softened edges."""
    return similarity_map(*(blurred(edges(x, 50, 150) * 255.0, 1.0) for x in (image, template)), window=window)


def aligned_map(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Distance to the template as a part of 255, after the shift that the phase correlation of both finds."""
    taper = np.outer(np.hanning(image.shape[0]), np.hanning(image.shape[1]))
    cross = np.fft.fft2(template * taper) * np.conj(np.fft.fft2(image * taper))
    peak = np.abs(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))
    shift = [int(k) - n * (k > n // 2) for k, n in zip(np.unravel_index(int(peak.argmax()), peak.shape), peak.shape, strict=True)]
    (h, w), (dy, dx) = image.shape, shift
    wide = np.pad(image, ((abs(dy),) * 2, (abs(dx),) * 2), mode="symmetric" if abs(dy) < h and abs(dx) < w else "edge")
    moved = wide[abs(dy) - dy : abs(dy) - dy + h, abs(dx) - dx : abs(dx) - dx + w]
    return np.clip(np.abs(moved - template) / 255, 0, 1)


def _mapped(batches, template: np.ndarray, kind: str):
    for part, images in rows_of(batches):
        rows = [k for k, x in enumerate(images) if x is not None]
        planes = [gray(images[k]) for k in rows]
        for plane in planes:
            if plane.shape != template.shape:
                raise ValueError(f"an image of {plane.shape} against a template of {template.shape}")
        found = [MAPS[kind](plane, template) for plane in planes]
        h, w = template.shape
        ids = part.column("image_id").take(pa.array(np.repeat(rows, h * w).astype(np.int64)))
        y, x = (np.tile(z.ravel(), len(rows)).astype(np.int32) for z in np.mgrid[0:h, 0:w])
        yield pa.RecordBatch.from_arrays([ids, pa.array(y), pa.array(x), pa.array(np.concatenate([*(m.ravel() for m in found), np.empty(0)]))], ["image_id", "y", "x", "v"])


MAPS = {"template_ncc_map": correlation_map, "ssim_template_map": similarity_map, "ssim_struct_map": structure_map, "phase_correlation_map": aligned_map}


class TemplateMap(_PixelMap):
    """Image rows (see ``oddlens.functions.images``) against the first training image; one of ``MAPS``."""

    defaults = {"kind": "template_ncc_map"}

    def fit(self, images: DataFrame) -> TemplateMap:
        first = images.where("data IS NOT NULL").orderBy("image_id").select(*IMAGE).first()
        if first is None:
            raise ValueError("no training images")
        self.template = gray(pixels_of(*first[1:]))
        return self

    def maps(self, images: DataFrame) -> DataFrame:
        kind = images.schema["image_id"].dataType.simpleString()
        return images.select(*IMAGE).mapInArrow(partial(_mapped, template=self.template, kind=self.how["kind"]), f"image_id {kind}, y int, x int, v double")
