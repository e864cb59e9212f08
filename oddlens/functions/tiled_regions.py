"""Defect regions of maps of any size: an image is worked on in tiles, never as one group.

A map becomes rows of one tile each (values and mask as bytes). Smoothing and morphology see a margin that the tiles
around give; components are labelled tile by tile, and those that touch across a seam are edges of a graph whose
components are the regions. A component is named by its first pixel in reading order, so a region's name is the least
of its components' and numbers regions as on the whole image. What is known of a region is put together from sums,
extremes and hull corners of its tiles. Results are those of ``maps.defects``.

Only what is kept per region of an image (not per pixel) meets in one group, to merge near regions and to sort them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from oddlens.functions import maps
from oddlens.operators.components import connected_components
from oddlens.sources.scratch import batch_limits, settle

TILE = 256
Frames = Iterator[pd.DataFrame]
KEYS = "image_id long, ty int, tx int, height int, width int"
TILES = f"{KEYS}, values binary, mask binary"
PARTS = f"{KEYS}, fy int, fx int, area long, sx double, sy double, x0 int, y0 int, x1 int, y1 int, v_max double, v_sum double, edge boolean, hull_x array<int>, hull_y array<int>, seam_y array<int>, seam_x array<int>"


def _shape(row, size: int) -> tuple[int, int]:
    return min(size, row.height - row.ty * size), min(size, row.width - row.tx * size)


def _arrays(row, size: int) -> tuple[np.ndarray, np.ndarray]:
    shape = _shape(row, size)
    return np.frombuffer(row.values).reshape(shape), np.frombuffer(row.mask, bool).reshape(shape)


def in_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """(image_id, y, x, v) as tiles, masks empty; an image reaches to its largest y and x, missing pixels are 0."""
    extent = pixels.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))

    at = lambda c: F.floor(F.col(c) / size).cast("int")
    there = pixels.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"), at("y").alias("ty"), at("x").alias("tx"))
    steps = lambda c: F.sequence(F.lit(0), F.floor((F.col(c) - 1) / size).cast("int"))
    every = extent.withColumn("ty", F.explode(steps("height"))).withColumn("tx", F.explode(steps("width")))
    place = ((F.col("y") - F.col("ty") * size) * size + F.col("x") - F.col("tx") * size).alias("at")
    held = there.groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct(place, "v")).alias("pixels"))
    with batch_limits(pixels.sparkSession, _at_once(size, 64)):
        return settle(every.join(held, ["image_id", "ty", "tx"], "left").mapInArrow(partial(_filled, size=size), TILES))


def _at_once(size: int, tiles: int) -> int:
    """So many tiles of TILE pixels' side go to Python at a time, or more smaller ones."""
    return min(10_000, max(tiles, tiles * TILE**2 // size**2))


def _filled(batches, size: int):
    for batch in batches:
        pixels = batch.column("pixels")
        flat, counts = pixels.flatten(), np.nan_to_num(pa.compute.list_value_length(pixels).to_numpy(zero_copy_only=False)).astype(int)
        place, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "v"))
        ends, values, masks = np.cumsum(counts), [], []
        figures = (batch.column(c).to_pylist() for c in ("ty", "tx", "height", "width"))
        for end, n, ty, tx, height, width in zip(ends, counts, *figures, strict=True):
            h, w = min(size, height - ty * size), min(size, width - tx * size)
            tile, at = np.zeros((h, w)), place[end - n : end]
            tile[at // size, at % size] = v[end - n : end]
            values.append(tile.tobytes())
            masks.append(bytes(h * w))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "ty", "tx", "height", "width")), pa.array(values, pa.binary()), pa.array(masks, pa.binary())], [c.split()[0] for c in TILES.split(", ")])


def _stacks(batch: pa.RecordBatch, size: int, inverted: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict]]:
    """The tiles of a batch by their shape: places in the batch, values, masks, labels of components (from 1, tile by tile) and the keys as arrays."""
    keys = {c: batch.column(c).to_numpy() for c in ("ty", "tx", "height", "width")}
    h, w = (np.minimum(size, keys[n] - keys[t] * size) for n, t in (("height", "ty"), ("width", "tx")))
    for shape in sorted(set(zip(h.tolist(), w.tolist(), strict=True))):
        at = np.flatnonzero((h == shape[0]) & (w == shape[1]))
        some = batch.take(pa.array(at))
        values, masks = (np.frombuffer(b"".join(some.column(c).to_pylist()), kind).reshape(len(at), *shape) for c, kind in (("values", float), ("mask", bool)))
        apart = np.zeros((len(at), shape[0] + 1, shape[1]), bool)  # a row without a pixel ends each tile
        apart[:, :-1] = ~masks if inverted else masks
        labels = maps.label_components(apart.reshape(-1, shape[1])).reshape(apart.shape)[:, :-1]
        yield at, values, masks, labels, {c: k[at] for c, k in keys.items()}


def _strips(frames: Frames, size: int, margin: int) -> Frames:
    """For each tile its own rows and, for those around, the pixels within their margin: to tile, corner, size and bytes."""
    for pdf in frames:
        out = []
        for row in pdf.itertuples():
            values, mask = _arrays(row, size)
            y0, x0 = row.ty * size, row.tx * size
            reach = -(-margin // size)
            for ty in range(max(0, row.ty - reach), min(-(-row.height // size), row.ty + reach + 1)):
                for tx in range(max(0, row.tx - reach), min(-(-row.width // size), row.tx + reach + 1)):
                    a, b = max(y0, ty * size - margin), min(y0 + len(values), (ty + 1) * size + margin)
                    c, d = max(x0, tx * size - margin), min(x0 + values.shape[1], (tx + 1) * size + margin)
                    if a < b and c < d:
                        cut = (slice(a - y0, b - y0), slice(c - x0, d - x0))
                        out.append((row.image_id, ty, tx, row.height, row.width, values[cut].tobytes(), mask[cut].tobytes(), a, b, c, d))
        yield pd.DataFrame(out, columns=["image_id", "ty", "tx", "height", "width", "values", "mask", "a", "b", "c", "d"])


def with_margin(tiles: DataFrame, size: int, margin: int, change: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``change`` of values and mask, which sees ``margin`` pixels around each tile where the image has them."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        y, x = row.ty * size, row.tx * size
        top, left = max(0, y - margin), max(0, x - margin)
        shape = min(row.height, y + size + margin) - top, min(row.width, x + size + margin) - left
        values, mask = np.zeros(shape), np.zeros(shape, bool)
        for part in pdf.itertuples():
            cut = (slice(part.a - top, part.b - top), slice(part.c - left, part.d - left))
            values[cut] = np.frombuffer(part.values).reshape(part.b - part.a, part.d - part.c)
            mask[cut] = np.frombuffer(part.mask, bool).reshape(part.b - part.a, part.d - part.c)
        h, w = min(size, row.height - y), min(size, row.width - x)
        own = (slice(y - top, y - top + h), slice(x - left, x - left + w))
        values, mask = (np.ascontiguousarray(k[own]) for k in change(values, mask))
        return pd.DataFrame([{**row[["image_id", "ty", "tx", "height", "width"]].to_dict(), "values": values.tobytes(), "mask": mask.tobytes()}])

    spread = tiles.mapInPandas(partial(_strips, size=size, margin=margin), f"{TILES}, a int, b int, c int, d int")
    with batch_limits(tiles.sparkSession, 64):
        return settle(spread.groupBy("image_id", "ty", "tx").applyInPandas(one, TILES))


def changed(tiles: DataFrame, size: int, change: Callable) -> DataFrame:
    """``change`` (tile, values, mask -> mask) of each tile by itself; a lazy table."""

    def each(frames: Frames) -> Frames:
        for pdf in frames:
            yield pdf.assign(mask=[np.ascontiguousarray(change(row, *_arrays(row, size))).tobytes() for row in pdf.itertuples()])[[c.split()[0] for c in TILES.split(", ")]]

    return tiles.select(*(c.split()[0] for c in TILES.split(", ")), *(c for c in tiles.columns if c == "names")).mapInPandas(each, TILES)


def _ring(x: np.ndarray, y: np.ndarray, box: bool) -> list[tuple[int, int]]:
    """The hull's corners of a component's pixels in reading order; of one that fills its box the box's."""
    if box:
        x0, y0, x1, y1 = x[0], y[0], x[-1] + 1, y[-1] + 1
        return maps.hull([x0, x0, x1, x1], [y0, y1, y0, y1])
    return maps.hull(*maps.row_ends(x, y))


def _lists(parts: list[np.ndarray] | None = None, flat: np.ndarray | None = None, counts: np.ndarray | None = None) -> pa.ListArray:
    flat, counts = (np.concatenate([*parts, np.empty(0, int)]), [len(p) for p in parts]) if parts is not None else (flat, counts)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))


def stack_parts(labels: np.ndarray, values: np.ndarray, key: dict, size: int) -> tuple[np.ndarray, dict]:
    """The components of tiles of one shape: the tile of each, and what is known of them."""
    (_, h, w), (t, y, x) = labels.shape, np.nonzero(labels)
    order = np.argsort(labels[t, y, x], kind="stable")
    t, y, x = t[order], y[order], x[order]
    number, v = labels[t, y, x], values[t, y, x]
    first = np.flatnonzero(np.r_[True, np.diff(number) != 0])
    area, of = np.diff(np.r_[first, len(number)]), t[first]
    seam = (y == 0) | (y == h - 1) | (x == 0) | (x == w - 1)
    y, x = y + (key["ty"] * size)[t], x + (key["tx"] * size)[t]
    edge = (y == 0) | (y == key["height"][t] - 1) | (x == 0) | (x == key["width"][t] - 1)
    each = lambda f, c: f.reduceat(c, first)
    x0, y0, x1, y1 = each(np.minimum, x), each(np.minimum, y), each(np.maximum, x), each(np.maximum, y)
    box = (x1 - x0 + 1) * (y1 - y0 + 1) == area
    rings = [np.array(_ring(x[a : a + n], y[a : a + n], b)) for a, n, b in zip(first, area, box, strict=True)]
    along = each(np.add, seam.astype(int))
    figures = {"fy": y[first], "fx": x[first], "area": area, "sx": each(np.add, x.astype(float)), "sy": each(np.add, y.astype(float)), "x0": x0, "y0": y0, "x1": x1, "y1": y1, "v_max": each(np.maximum, v), "v_sum": each(np.add, v), "edge": each(np.logical_or, edge)}
    return of, figures | {"hull_x": _lists([r[:, 0] for r in rings]), "hull_y": _lists([r[:, 1] for r in rings]), "seam_y": _lists(flat=y[seam], counts=along), "seam_x": _lists(flat=x[seam], counts=along)}


def _parts(batches, size: int, inverted: bool, schema: pa.Schema):
    for batch in batches:
        for at, values, _, labels, key in _stacks(batch, size, inverted) if batch.num_rows else ():
            if labels.any():
                of, figures = stack_parts(labels, values, key, size)
                figures |= {c: k[of] for c, k in key.items()} | {"image_id": batch.column("image_id").take(pa.array(at[of]))}
                yield pa.RecordBatch.from_arrays([(figures[f.name] if isinstance(figures[f.name], pa.Array) else pa.array(figures[f.name])).cast(f.type) for f in schema], schema=schema)


def parts(tiles: DataFrame, size: int, inverted: bool = False) -> DataFrame:
    """The components of all tiles (of the background with ``inverted``), each with the first pixel of its region (ry, rx); settled."""
    with batch_limits(tiles.sparkSession, _at_once(size, 64)):
        found = settle(tiles.mapInArrow(partial(_parts, size=size, inverted=inverted, schema=to_arrow_schema(T._parse_datatype_string(PARTS))), PARTS))
    node = lambda y, x: F.struct("image_id", F.col(y).alias("y"), F.col(x).alias("x"))
    seams = found.select("image_id", "ty", "tx", node("fy", "fx").alias("node"), F.explode(F.arrays_zip("seam_y", "seam_x")).alias("p")).select("image_id", "ty", "tx", "node", F.col("p.seam_y").alias("y"), F.col("p.seam_x").alias("x"))
    step = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    ahead = seams.withColumn("step", step).select("image_id", F.col("ty").alias("from_y"), F.col("tx").alias("from_x"), F.col("node").alias("a"), (F.col("y") + F.col("step.dy")).alias("y"), (F.col("x") + F.col("step.dx")).alias("x"))
    other = (F.floor(F.col("y") / size) != F.col("from_y")) | (F.floor(F.col("x") / size) != F.col("from_x"))
    met = ahead.where(other).join(seams.select("image_id", "y", "x", F.col("node").alias("b")), ["image_id", "y", "x"])
    roots = connected_components(met.select("a", "b")).select(F.col("node.image_id").alias("image_id"), F.col("node.y").alias("fy"), F.col("node.x").alias("fx"), F.col("component.y").alias("to_y"), F.col("component.x").alias("to_x"))
    own = lambda to, of: F.coalesce(to, of)
    return settle(found.join(roots, ["image_id", "fy", "fx"], "left").withColumns({"ry": own("to_y", "fy"), "rx": own("to_x", "fx")}).drop("to_y", "to_x", "seam_y", "seam_x"))


def _hull_area(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([maps.ring_area(maps.hull(x, y)) for x, y in zip(xs, ys, strict=True)], dtype=float)


def regions(found: DataFrame) -> DataFrame:
    """The regions of ``parts``: sums, extremes and hull of their tiles, as ``maps.find_regions`` has them."""
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    sums = found.groupBy("image_id", "ry", "rx").agg(
        *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1", "v_max", "edge")), *(F.sum(c).alias(c) for c in ("area", "sx", "sy", "v_sum")), flat("hull_x"), flat("hull_y")
    )
    wide, high = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return sums.select(
        "image_id", "ry", "rx", "x0", "y0", "x1", "y1", "area", (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"), (F.col("area") / (wide * high)).alias("fill_ratio"), (F.greatest(wide, high) / F.least(wide, high)).alias("aspect_ratio"),
        F.round("v_max", 6).alias("score_max"), F.round(F.col("v_sum") / F.col("area"), 6).alias("score_mean"), (F.col("area") / F.pandas_udf(_hull_area, "double")("hull_x", "hull_y")).alias("solidity"), "v_max", "edge",
    )


def _set_where(tiles: DataFrame, found: DataFrame, chosen: DataFrame, size: int, to: bool, inverted: bool = False) -> DataFrame:
    """Masks with the regions ``chosen`` (image_id, ry, rx) of ``found`` set to ``to``; settled."""
    first = found.join(chosen.select("image_id", "ry", "rx"), ["image_id", "ry", "rx"], "left_semi").groupBy("image_id", "ty", "tx").agg(F.collect_list(F.col("fy") * F.lit(1 << 32).cast("long") + F.col("fx")).alias("names"))

    with batch_limits(tiles.sparkSession, _at_once(size, 64)):
        return settle(tiles.join(first, ["image_id", "ty", "tx"], "left").mapInArrow(partial(_reset, size=size, to=to, inverted=inverted), TILES))


def _named(names: pa.ListArray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The tile of each entry of some tiles' lists, and the entries."""
    names = names.take(pa.array(at))
    counts = np.nan_to_num(pa.compute.list_value_length(names).to_numpy(zero_copy_only=False)).astype(int)
    return np.repeat(np.arange(len(at)), counts), names.flatten()


def _reset(batches, size: int, to: bool, inverted: bool):
    for batch in batches:
        new = batch.column("mask").to_pylist()
        for at, _, masks, labels, key in _stacks(batch, size, inverted) if batch.num_rows else ():
            t, names = _named(batch.column("names"), at)
            names = names.to_numpy(zero_copy_only=False).astype(np.int64)
            chosen = np.zeros(labels.max(initial=0) + 1, bool)
            chosen[labels[t, (names >> 32) - key["ty"][t] * size, (names & 0xFFFFFFFF) - key["tx"][t] * size]] = True
            for k, mask in zip(at.tolist(), np.where(chosen[labels], to, masks), strict=True):
                new[k] = mask.tobytes()
        kept = [c.split()[0] for c in TILES.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(c) if c != "mask" else pa.array(new, pa.binary()) for c in kept], kept)


def labelled(pixels: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(image_id, y, x, v, region) of the pixels at or above ``threshold``: ``region`` numbers an image's regions from 1 by first pixel."""
    from pyspark.sql import Window

    tiles = settle(changed(in_tiles(pixels, tile), tile, lambda row, values, mask: values >= threshold))
    found = parts(tiles, tile)
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("ry", "rx"))
    numbered = found.select("image_id", "ry", "rx").distinct().withColumn("region", number.cast("int"))
    names = found.join(numbered, ["image_id", "ry", "rx"]).groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct("fy", "fx", "region")).alias("names"))

    with batch_limits(tiles.sparkSession, _at_once(tile, 16)):
        return settle(tiles.join(names, ["image_id", "ty", "tx"]).mapInArrow(partial(_numbered, size=tile), "image_id long, y int, x int, v double, region int"))


def _numbered(batches, size: int):
    for batch in batches:
        for at, values, _, labels, key in _stacks(batch, size) if batch.num_rows else ():
            of, names = _named(batch.column("names"), at)
            fy, fx, region = (names.field(c).to_numpy() for c in ("fy", "fx", "region"))
            to = np.zeros(labels.max(initial=0) + 1, np.int32)
            to[labels[of, fy - key["ty"][of] * size, fx - key["tx"][of] * size]] = region
            t, y, x = np.nonzero(labels)
            columns = [y + key["ty"][t] * size, x + key["tx"][t] * size]
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(at[t])), *(pa.array(c, pa.int32()) for c in columns), pa.array(values[t, y, x]), pa.array(to[labels[t, y, x]])], ["image_id", "y", "x", "v", "region"])


def defects(pixels: DataFrame, threshold: float, low: float | None = None, tile: int = TILE, **how) -> DataFrame:
    """As ``maps.defects``, with the same parameters, for images of any size."""
    rules = maps.DefectRules(**how)
    inner = max(rules.smoothing_size, 1) // 2 + 1
    tiles = in_tiles(pixels, tile)

    def smoothed(values, mask):
        return maps.smooth(values, rules.smoothing, rules.smoothing_size), mask

    if rules.border:
        def bordered(row, values, mask):
            y, x = np.arange(len(values)) + row.ty * tile, np.arange(values.shape[1]) + row.tx * tile
            inside = lambda k, n: (k >= rules.border) & (k < n - rules.border)
            return np.outer(inside(y, row.height), inside(x, row.width))

        kept = changed(tiles, tile, bordered)
        tiles = settle(kept.mapInPandas(_masked, TILES))
    if rules.smoothing != "none" and rules.smoothing_size > 1:
        tiles = with_margin(tiles, tile, inner, smoothed)
    least = threshold if low is None else low
    tiles = settle(changed(tiles, tile, lambda row, values, mask: values >= least))
    if low is not None:
        found = parts(tiles, tile)
        tiles = _set_where(tiles, found, regions(found).where(F.col("v_max") < threshold), tile, False)
    if rules.open_size > 1 or rules.close_size > 1:
        margin = 2 * (rules.open_size // 2 + rules.close_size // 2)
        tiles = with_margin(tiles, tile, margin, lambda values, mask: (values, maps.morph(maps.morph(mask, "open", rules.open_size), "close", rules.close_size)))
    if (bad := rules.failing()) is not None:
        found = parts(tiles, tile)
        tiles = _set_where(tiles, found, regions(found).where(bad), tile, False)
    if rules.fill:
        found = parts(tiles, tile, inverted=True)
        tiles = _set_where(tiles, found, regions(found).where(~F.col("edge")), tile, True, inverted=True)
    if rules.dilate > 1:
        tiles = with_margin(tiles, tile, rules.dilate // 2, lambda values, mask: (values, maps.morph(mask, "dilate", rules.dilate)))
    if rules.roi is not None:
        x0, y0, x1, y1 = maps.clamp_roi(rules.roi)

        def gated(row, values, mask):
            y, x = np.arange(len(values)) + row.ty * tile, np.arange(values.shape[1]) + row.tx * tile
            rows = (y >= int(np.floor(y0 * row.height))) & (y < int(np.ceil(y1 * row.height)))
            columns = (x >= int(np.floor(x0 * row.width))) & (x < int(np.ceil(x1 * row.width)))
            return mask & np.outer(rows, columns)

        tiles = settle(changed(tiles, tile, gated))
    return regions(parts(tiles, tile)).groupBy("image_id").applyInPandas(lambda pdf: _finished(pdf, rules), maps.REGION)


def _masked(frames: Frames) -> Frames:
    """Values outside the mask become 0."""
    for pdf in frames:
        yield pdf.assign(values=[np.where(np.frombuffer(m, bool), np.frombuffer(v), 0.0).tobytes() for v, m in zip(pdf["values"], pdf["mask"], strict=True)])


def _finished(pdf: pd.DataFrame, rules: maps.DefectRules) -> pd.DataFrame:
    rows = pdf.sort_values(["ry", "rx"]).to_dict("records")
    return rules.finished(int(pdf.image_id.iloc[0]), [{**r, "region": k + 1} for k, r in enumerate(rows)])
