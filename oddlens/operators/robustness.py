"""Robustness: what corrupted images do to a fitted detector, over all corruptions and severities in one table of rows.

Every test image becomes a row for the clean image and one for each corruption and severity; features, scores and
curves are then computed once, the metrics by group. The threshold of maps is fixed on normal images before.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.functions.images import CORRUPTIONS, IMAGE, extract, rows_of
from oddlens.functions.ranks import quantile
from oddlens.operators.base import Detector
from oddlens.operators.metrics import auroc, average_precision, pixel_segf1
from oddlens.sources.scratch import with_row_id

BY = ("corruption", "severity")


def _changed(batches, seed: int):
    for part, images in rows_of(batches):
        out = []
        for key, name, severity, image in zip(*(part.column(c).to_pylist() for c in ("image_id", "corruption", "severity")), images, strict=True):
            if image is not None and severity:
                image = np.clip(CORRUPTIONS[name](image, severity, np.random.default_rng([seed & 0xFFFFFFFF, *str(key).encode()])), 0, 255).astype(int)
            out.append(None if image is None else image.astype(int).ravel().tolist())
        at = part.schema.get_field_index("data")
        yield part.set_column(at, part.schema.field("data"), pa.array(out, part.schema.field("data").type))


def variants(images: DataFrame, corruptions: tuple[str, ...] = tuple(CORRUPTIONS), severities: tuple[int, ...] = (1, 2, 3, 4, 5), seed: int = 0) -> DataFrame:
    """``images`` (see ``functions.images``, and more columns) once clean (corruption ``clean``, severity 0) and once for each corruption and severity."""
    if unknown := set(corruptions) - CORRUPTIONS.keys():
        raise ValueError(f"unknown corruptions: {sorted(unknown)}")
    each = [("clean", 0), *((c, s) for c in corruptions for s in severities)]
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("corruption"), F.lit(s).alias("severity")) for c, s in each)))
    rest = [c for c in images.columns if c not in IMAGE]
    rows = images.select("image_id", *(F.col(c).cast("int").alias(c) for c in IMAGE[1:4]), F.col("data").cast("array<int>").alias("data"), *rest, kinds.alias("k")).select(*IMAGE, *rest, "k.corruption", "k.severity")
    return rows.mapInArrow(partial(_changed, seed=seed), rows.schema)


def _with_drop(found: DataFrame, metrics: list[str]) -> DataFrame:
    """Beside each metric what it lost against the clean images; the clean row is one row."""
    clean = found.where("severity = 0").select(*(F.col(m).alias(f"clean_{m}") for m in metrics))
    return found.crossJoin(F.broadcast(clean)).select(*BY, *metrics, *((F.col(f"clean_{m}") - F.col(m)).alias(f"{m}_drop") for m in metrics))


def score_robustness(model: Detector, images: DataFrame, extractor: str, corruptions: tuple[str, ...] = tuple(CORRUPTIONS), severities: tuple[int, ...] = (1, 2, 3, 4, 5), seed: int = 0, **how) -> DataFrame:
    """corruption, severity, auroc, average_precision and their drops, of image rows with ``label`` (0/1) and a model fitted on the extractor's features."""
    rows = with_row_id(variants(images, corruptions, severities, seed))
    features = extract(rows.withColumn("image_id", F.col("id")), extractor, **how)
    scored = model.decision_function(features.where("features IS NOT NULL")).join(rows.select("id", "label", *BY), "id")
    found = auroc(scored, BY).join(average_precision(scored, BY), list(BY))
    return _with_drop(found, ["auroc", "average_precision"])


def map_robustness(model, images: DataFrame, masks: DataFrame, normal: DataFrame, corruptions: tuple[str, ...] = tuple(CORRUPTIONS), severities: tuple[int, ...] = (1, 2, 3, 4, 5), seed: int = 0, normal_quantile: float = 0.999) -> DataFrame:
    """corruption, severity, segf1 and its drop: pixels of ``model.maps`` against ``masks`` (image_id, y, x, label), at one threshold, a quantile of the maps of ``normal`` images."""
    threshold = quantile(model.maps(normal), "v", normal_quantile)
    rows = with_row_id(variants(images, corruptions, severities, seed))
    pixels = model.maps(rows.withColumn("image_id", F.col("id"))).withColumnRenamed("image_id", "id").join(rows.select("id", "image_id", *BY), "id")
    judged = pixels.join(masks.select("image_id", "y", "x", "label"), ["image_id", "y", "x"], "left").select(*BY, F.coalesce("label", F.lit(0)).alias("label"), F.col("v").alias("score"))
    return _with_drop(pixel_segf1(judged, threshold, BY), ["segf1"])
