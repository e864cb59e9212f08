"""Anomaly maps in long form (image_id, y, x, v): reducers, regions of interest, masks, tiles, as group-by plans; kernels per image where labelling or morphology needs neighbours."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reduce_map(pixels: DataFrame, method: str = "topk_mean", topk: float = 0.01, area_threshold: float = 0.5) -> DataFrame:
    """(image_id, score): max, mean, topk_mean (mean of the highest ``topk`` part, one pixel at least) or area (part at or above a threshold)."""
    if method == "topk_mean":
        n = F.count("*").over(Window.partitionBy("image_id"))
        rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("v")))
        top = pixels.withColumn("n", n).withColumn("r", rank).where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * topk)))
        return top.groupBy("image_id").agg(F.avg("v").alias("score"))
    how = {"max": F.max("v"), "mean": F.avg("v"), "area": F.avg((F.col("v") >= area_threshold).cast("double"))}[method]
    return pixels.groupBy("image_id").agg(how.alias("score"))


def clamp_roi(roi: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """x0, y0, x1, y1 as parts of the image, in 0..1 and in order."""
    x0, y0, x1, y1 = (min(max(float(v), 0.0), 1.0) for v in roi)
    return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


def inside_roi(roi: tuple[float, float, float, float], height: int, width: int) -> Column:
    x0, y0, x1, y1 = clamp_roi(roi)
    return (F.col("x") >= int(np.floor(x0 * width))) & (F.col("x") < int(np.ceil(x1 * width))) & (F.col("y") >= int(np.floor(y0 * height))) & (F.col("y") < int(np.ceil(y1 * height)))


def apply_roi(pixels: DataFrame, roi, height: int, width: int) -> DataFrame:
    return pixels.withColumn("v", F.when(inside_roi(roi, height, width), F.col("v")).otherwise(F.lit(0.0)))


def ignore_border(pixels: DataFrame, border: int, height: int, width: int) -> DataFrame:
    edge = (F.col("x") < border) | (F.col("y") < border) | (F.col("x") >= width - border) | (F.col("y") >= height - border)
    return pixels.withColumn("v", F.when(edge, F.lit(0.0)).otherwise(F.col("v")))


def roi_stats(pixels: DataFrame, roi, height: int, width: int) -> DataFrame:
    return pixels.where(inside_roi(roi, height, width)).groupBy("image_id").agg(F.max("v").alias("roi_max"), F.avg("v").alias("roi_mean"))


def to_mask(pixels: DataFrame, threshold: float) -> DataFrame:
    """m is 255 at or above the threshold, else 0."""
    return pixels.withColumn("m", F.when(F.col("v") >= threshold, 255).otherwise(0))


def tile_starts(size: int, tile: int, stride: int) -> list[int]:
    """Where tiles start; the last one ends at the edge."""
    starts = list(range(0, max(1, size - tile + 1), stride))
    return starts if size <= tile or starts[-1] == size - tile else [*starts, size - tile]


def tiles(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """(image_id, y0, x0, y1, x1) of each image (image_id, height, width)."""

    def starts(size: str) -> Column:
        n = F.col(size)
        steps = F.sequence(F.lit(0), F.greatest(n - tile, F.lit(0)), F.lit(stride))
        return F.array_distinct(F.concat(steps, F.array(F.greatest(n - tile, F.lit(0)))))

    spread = images.withColumn("y0", F.explode(starts("height"))).withColumn("x0", F.explode(starts("width")))
    return spread.select("image_id", "y0", "x0", F.least(F.col("y0") + tile, "height").alias("y1"), F.least(F.col("x0") + tile, "width").alias("x1"))


def stitch(tile_pixels: DataFrame, how: str = "max") -> DataFrame:
    """Tile maps (image_id, y0, x0, y, x, v with y and x inside the tile) as one map; overlaps by max, mean or hann weights."""
    at = tile_pixels.withColumns({"y": F.col("y0") + F.col("y"), "x": F.col("x0") + F.col("x")})
    if how == "hann":
        return at.groupBy("image_id", "y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return at.groupBy("image_id", "y", "x").agg((F.max("v") if how == "max" else F.avg("v")).alias("v"))


def label_components(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the 8-connected components of a boolean mask, in the order of their first pixel."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    wide = np.full((h + 2, w + 2), big)
    while True:
        wide[1:-1, 1:-1] = np.where(mask, label, big)
        tall = np.minimum(np.minimum(wide[:-2], wide[1:-1]), wide[2:])
        new = np.where(mask, np.minimum(np.minimum(tall[:, :-2], tall[:, 1:-1]), tall[:, 2:]), 0)
        jump = np.where(new > 0, new.ravel()[np.maximum(new, 1) - 1], 0)  # the label of the pixel that a label names
        if (jump == label).all():
            break
        label = jump
    _, out = np.unique(label, return_inverse=True)
    return out.reshape(h, w) + (0 if (label == 0).any() else 1)


def _window(mask: np.ndarray, size: int, shape: str) -> list[tuple[int, int]]:
    r = size // 2
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if shape == "rect" or a * a + b * b <= r * r + 0.5 * r]


def morph(image: np.ndarray, op: str, size: int, shape: str = "ellipse") -> np.ndarray:
    """erode, dilate, open or close; sizes up to 1 change nothing."""
    if size <= 1:
        return image
    if op in ("open", "close"):
        first, then = ("erode", "dilate") if op == "open" else ("dilate", "erode")
        return morph(morph(image, first, size, shape), then, size, shape)
    r, (h, w) = size // 2, image.shape
    wide = np.pad(image, r, mode="edge")
    shifts = [wide[r + a : r + a + h, r + b : r + b + w] for a, b in _window(image, size, shape)]
    return np.min(shifts, 0) if op == "erode" else np.max(shifts, 0)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    outside = label_components(np.pad(~mask, 1, constant_values=True))
    return ~(outside == outside[0, 0])[1:-1, 1:-1]


def hysteresis(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Components at or above ``low`` that hold a pixel at or above ``high``."""
    labels = label_components(values >= low)
    return np.isin(labels, np.unique(labels[(values >= high) & (labels > 0)])) & (labels > 0)


def smooth(values: np.ndarray, method: str, size: int, sigma: float = 0.0) -> np.ndarray:
    if method == "none" or size <= 1:
        return values
    r, (h, w) = size // 2, values.shape
    wide = np.pad(values, r, mode="reflect" if min(values.shape) > r else "edge")
    shifts = np.stack([wide[a : a + h, b : b + w] for a in range(size) for b in range(size)])
    if method == "median":
        return np.median(shifts, 0)
    if method == "box":
        return shifts.mean(0)
    s = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-0.5 * ((np.arange(size) - r) / s) ** 2)
    return np.tensordot((np.outer(k, k) / np.outer(k, k).sum()).ravel(), shifts, 1)


REGION = "image_id long, region int, x0 int, y0 int, x1 int, y1 int, area long, cx double, cy double, fill_ratio double, aspect_ratio double, score_max double, score_mean double, solidity double"


def pixels_of(labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(y, x) of each label from 1 on, in reading order: one sort for all."""
    flat = labels.ravel()
    order = np.argsort(flat, kind="stable")
    ends = np.cumsum(np.bincount(flat, minlength=labels.max(initial=0) + 1))
    return [np.divmod(order[a:b], labels.shape[1]) for a, b in zip(ends, ends[1:], strict=False)]


def find_regions(values: np.ndarray, mask: np.ndarray) -> list[dict]:
    out = []
    for k, (y, x) in enumerate(pixels_of(label_components(mask)), 1):
        x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
        wide, high = x1 - x0 + 1, y1 - y0 + 1
        v = values[y, x]
        out.append({"region": k, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "area": len(x), "cx": x.mean(), "cy": y.mean(), "fill_ratio": len(x) / (wide * high), "aspect_ratio": max(wide, high) / min(wide, high), "score_max": round(float(v.max()), 6), "score_mean": round(float(v.mean()), 6), "solidity": len(x) / hull_area(x, y)})
    return out


def row_ends(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """The corners of the first and last pixel of each row (pixels in reading order): the hull has no others."""
    first = np.flatnonzero(np.r_[True, np.diff(y) > 0])
    last = np.r_[first[1:] - 1, len(y) - 1]
    left, right, rows = x[first], x[last] + 1, y[first]
    return [*left.tolist(), *left.tolist(), *right.tolist(), *right.tolist()], [*rows.tolist(), *(rows + 1).tolist()] * 2


def hull(x, y) -> list[tuple[int, int]]:
    """The corners of the convex hull of some points."""
    points = sorted(set(zip(map(int, x), map(int, y), strict=True)))

    def chain(rows):
        out: list[tuple[int, int]] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def ring_area(ring: list[tuple[int, int]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Pixels in the convex hull of some pixels in reading order, each a unit square: the area of the hull of their corners."""
    return ring_area(hull(*row_ends(x, y)))


def merged(regions: list[dict], gap: int) -> list[dict]:
    """Regions with those at most ``gap`` apart made one: box and area together, means weighted by area."""
    out = []
    for group in merge_near(regions, gap):
        some = [regions[i] for i in group]
        area = sum(r["area"] for r in some)
        x0, y0, x1, y1 = (pick(r[c] for r in some) for c, pick in (("x0", min), ("y0", min), ("x1", max), ("y1", max)))
        wide, high = x1 - x0 + 1, y1 - y0 + 1
        mean = {c: sum(r[c] * r["area"] for r in some) / area for c in ("cx", "cy", "score_mean", "solidity")}
        out.append({**some[0], **mean, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "area": area, "fill_ratio": area / (wide * high), "aspect_ratio": max(wide, high) / min(wide, high), "score_max": max(r["score_max"] for r in some)})
    return out


def scale_box(box: tuple[int, int, int, int], size: tuple[int, int], to: tuple[int, int]) -> tuple[int, int, int, int]:
    """An inclusive box x0, y0, x1, y1 of a (height, width) image in another one's pixels, at least one pixel, inside it."""
    (h, w), (high, wide) = size, to
    x0, x1 = (int(np.floor(box[0] * wide / w)), int(np.ceil((box[2] + 1) * wide / w)) - 1)
    y0, y1 = (int(np.floor(box[1] * high / h)), int(np.ceil((box[3] + 1) * high / h)) - 1)
    x0, y0 = min(max(x0, 0), wide - 1), min(max(y0, 0), high - 1)
    return x0, y0, min(max(x1, x0), wide - 1), min(max(y1, y0), high - 1)


def pixel_threshold(pixels: DataFrame | None = None, value: float | None = None, strategy: str = "fixed", quantile: float = 0.999) -> float:
    """The threshold of a map: ``fixed`` takes ``value``, ``normal_pixel_quantile`` a quantile of normal pixels' scores."""
    if strategy == "fixed":
        if value is None:
            raise ValueError("a fixed threshold needs its value")
        return float(value)
    if strategy != "normal_pixel_quantile" or pixels is None:
        raise ValueError("unknown strategy, or no pixels for it")
    from oddlens.operators.calibration import normal_pixel_threshold

    return normal_pixel_threshold(pixels, quantile)


def grid_of(pdf: pd.DataFrame) -> np.ndarray:
    values = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1))
    values[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf.v.to_numpy()
    return values


def cleaned(pixels: DataFrame, normalize: str = "minmax", percentiles: tuple[float, float] = (1.0, 99.0), sigma: float = 0.0, open_size: int = 0, close_size: int = 0, component_threshold: float | None = None, min_area: int = 0) -> DataFrame:
    """Maps (image_id, y, x, v) made steadier: scaled (``minmax``, ``percentile`` or ``none``), softened, opened, closed, small components off.

    An image is one group, as in ``defects``.
    """
    if normalize not in ("minmax", "percentile", "none") or not 0 <= percentiles[0] < percentiles[1] <= 100:
        raise ValueError("unknown normalisation or percentiles out of order")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = grid_of(pdf)
        if normalize != "none":
            low, high = (values.min(), values.max()) if normalize == "minmax" else np.percentile(values, percentiles)
            values = np.clip((values - low) / max(high - low, 1e-8), 0, 1)
        if sigma > 0:
            values = smooth(values, "gaussian", 2 * max(1, round(4 * sigma)) + 1, sigma)
        values = morph(morph(values, "open", open_size), "close", close_size)
        if component_threshold is not None and min_area > 0:
            labels = label_components(values >= component_threshold)
            small = (labels > 0) & (np.bincount(labels.ravel())[labels] < min_area)
            values = np.where(small, 0.0, values)
        return pdf.assign(v=values[pdf.y.to_numpy(), pdf.x.to_numpy()])[["image_id", "y", "x", "v"]]

    rows = pixels.select(F.col("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return rows.groupBy("image_id").applyInPandas(one, rows.schema)


def merge_near(regions: list[dict], gap: int) -> list[list[int]]:
    """Indexes of regions whose boxes are at most ``gap`` apart in both axes, transitively."""
    group = list(range(len(regions)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(regions):
        for j in range(i):
            b = regions[j]
            if max(a["x0"] - b["x1"], b["x0"] - a["x1"], a["y0"] - b["y1"], b["y0"] - a["y1"]) - 1 <= gap:
                x, y = sorted((root(i), root(j)))
                group[y] = x
    out: dict[int, list[int]] = {}
    for i in range(len(regions)):
        out.setdefault(root(i), []).append(i)
    return list(out.values())


SORTS = ("score_max", "score_mean", "area")


@dataclass(frozen=True)
class DefectRules:
    """What becomes of a mask and its regions, in this order: border off, smooth, (threshold,) open, close, components off
    that are small or fail a bound on fill, aspect, solidity or score, holes filled, dilate, region of interest; then
    near regions merged, those below the quantile of the image's region scores dropped, the rest sorted."""

    roi: tuple[float, float, float, float] | None = None
    border: int = 0
    smoothing: str = "none"
    smoothing_size: int = 0
    open_size: int = 0
    close_size: int = 0
    min_area: int = 0
    fill: bool = False
    dilate: int = 0
    min_fill: float | None = None
    max_aspect: float | None = None
    min_solidity: float | None = None
    min_score_max: float | None = None
    min_score_mean: float | None = None
    merge_gap: int = 0
    score_quantile: float | None = None
    sort_by: str = "score_max"
    max_regions: int | None = None

    def __post_init__(self):
        if self.sort_by not in SORTS:
            raise ValueError(self.sort_by)

    @property
    def bounds(self) -> list[tuple[str, float, int]]:
        """(figure, bound, 1 for at least and -1 for at most)."""
        every = (("area", self.min_area or None, 1), ("fill_ratio", self.min_fill, 1), ("solidity", self.min_solidity, 1), ("score_max", self.min_score_max, 1), ("score_mean", self.min_score_mean, 1), ("aspect_ratio", self.max_aspect, -1))
        return [b for b in every if b[1] is not None]

    def fails(self, r: dict) -> bool:
        return any(sign * r[c] < sign * b for c, b, sign in self.bounds)

    def failing(self) -> Column | None:
        """The same of a row of regions; None if nothing can fail."""
        return reduce(or_, (sign * F.col(c) < sign * b for c, b, sign in self.bounds)) if self.bounds else None

    def finished(self, image_id: int, found: list[dict]) -> pd.DataFrame:
        found = merged(found, self.merge_gap) if self.merge_gap > 0 else found
        if self.score_quantile is not None and found:
            least = np.quantile([r["score_max"] for r in found], self.score_quantile)
            found = [r for r in found if r["score_max"] >= least]
        order = lambda r: (-r[self.sort_by], -r["score_max"], -r["score_mean"], -r["area"], r["y0"], r["x0"], r["y1"], r["x1"])
        rows = [{**r, "image_id": image_id, "region": k + 1} for k, r in enumerate(sorted(found, key=order)[: self.max_regions])]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REGION.split(", ")])


def defects(pixels: DataFrame, threshold: float, low: float | None = None, **how) -> DataFrame:
    """Regions of each image's map at or above ``threshold``, with ``low`` by hysteresis; ``how``: see ``DefectRules``.

    An image is one group here, so its pixels are in one task: ``tiled_regions.defects`` has no such bound.
    """
    rules = DefectRules(**how)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = grid_of(pdf)
        if rules.border:
            inner = np.zeros_like(values)
            inner[rules.border : -rules.border, rules.border : -rules.border] = values[rules.border : -rules.border, rules.border : -rules.border]
            values = inner
        values = smooth(values, rules.smoothing, rules.smoothing_size)
        mask = hysteresis(values, low, threshold) if low is not None else values >= threshold
        mask = morph(morph(mask, "open", rules.open_size), "close", rules.close_size)
        if rules.bounds:
            mask = mask & ~np.isin(label_components(mask), [r["region"] for r in find_regions(values, mask) if rules.fails(r)])
        mask = fill_holes(mask) if rules.fill else mask
        mask = morph(mask, "dilate", rules.dilate)
        if rules.roi is not None:
            (x0, y0, x1, y1), (h, w) = clamp_roi(rules.roi), mask.shape
            inside = np.zeros_like(mask)
            inside[int(np.floor(y0 * h)) : int(np.ceil(y1 * h)), int(np.floor(x0 * w)) : int(np.ceil(x1 * w))] = True
            mask = mask & inside
        return rules.finished(int(pdf.image_id.iloc[0]), find_regions(values, mask))

    return pixels.select("image_id", "y", "x", "v").groupBy("image_id").applyInPandas(one, REGION)


def cut_tiles(pixels: DataFrame, tiles_: DataFrame) -> DataFrame:
    """The pixels of each tile (image_id, y0, x0, y, x, v; y and x inside the tile), from a map and the rows of ``tiles``."""
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return pixels.join(tiles_, "image_id").where(inside).select("image_id", "y0", "x0", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def hann_weights(tile_pixels: DataFrame, height: int, width: int, floor: float = 1e-3) -> DataFrame:
    """With ``w``: the product of two raised cosines over the tile, at least ``floor``, for ``stitch(..., "hann")``."""

    def along(c: str, n: int) -> Column:
        return F.lit(1.0) if n < 2 else 0.5 - 0.5 * F.cos(2 * np.pi * F.col(c) / (n - 1))

    return tile_pixels.withColumn("w", F.greatest(along("y", height) * along("x", width), F.lit(floor)))
