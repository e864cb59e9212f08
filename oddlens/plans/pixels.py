"""Registered map, tile and window queries, with DuckDB SQL. Maps are made of table rows: an order's lines as pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddlens.functions import images, maps, synthesis, tiled_regions
from oddlens.functions.vectors import features
from oddlens.operators import marginal, neighbours, patch_maps, pixel_maps, projectors, robustness  # noqa: F401  (some register their models)
from oddlens.operators.registry import create_model
from oddlens.sources.scratch import read, settle
from oddlens.streaming import watch

_SIDE = 16


def _grid(spark, sf_dir):
    """A 16 x 16 map for each supplier: mean discount of its lines at (quantity, part) hashed to a pixel."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % _SIDE).cast("int").alias("y"), (F.col("l_quantity") % _SIDE).cast("int").alias("x")).agg(F.avg("l_discount").alias("v"))


_G = f"g AS (SELECT l_suppkey AS image_id, (l_partkey % {_SIDE})::INT AS y, (l_quantity % {_SIDE})::INT AS x, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3)"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def reduce_topk(spark, sf_dir):
    return _rounded(maps.reduce_map(_grid(spark, sf_dir), "topk_mean", 0.05), "score")


def reduce_area(spark, sf_dir):
    return _rounded(maps.reduce_map(_grid(spark, sf_dir), "area", area_threshold=0.0583), "score")


def roi_stats(spark, sf_dir):
    return _rounded(maps.roi_stats(_grid(spark, sf_dir), (0.25, 0.25, 0.75, 0.75), _SIDE, _SIDE), "roi_max", "roi_mean")


def border(spark, sf_dir):
    return _rounded(maps.reduce_map(maps.ignore_border(_grid(spark, sf_dir), 2, _SIDE, _SIDE), "mean"), "score")


def tile_coordinates(spark, sf_dir):
    images = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") % 7 + 5).cast("int").alias("height"), (F.col("s_nationkey") + 4).cast("int").alias("width"))
    return maps.tiles(images, 4, 3)


def stitched(spark, sf_dir):
    images = _grid(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(_SIDE).alias("height"), F.lit(_SIDE).alias("width"))
    cut = maps.tiles(images, 8, 6).join(_grid(spark, sf_dir), "image_id").where("y >= y0 AND y < y1 AND x >= x0 AND x < x1")
    local = cut.select("image_id", "y0", "x0", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")
    return _rounded(maps.stitch(local, "mean"), "v")


def defect_regions(spark, sf_dir):
    return maps.defects(_grid(spark, sf_dir), 0.07, min_area=2).select("image_id", "region", "x0", "y0", "x1", "y1", "area", F.round("score_max", 6).alias("score_max"))


def defect_regions_tiled(spark, sf_dir):
    """The same on tiles of 6 x 6 pixels, at a threshold that no mean discount is equal to."""
    found = tiled_regions.defects(_grid(spark, sf_dir), 0.0701, tile=6, min_area=2)
    return found.select("image_id", "region", "x0", "y0", "x1", "y1", "area", F.round("score_max", 6).alias("score_max"))


def labelled_tiles(spark, sf_dir):
    """Pixels by region, labelled on tiles of 5 x 5 pixels."""
    return tiled_regions.labelled(_grid(spark, sf_dir), 0.0601, tile=5).select("image_id", "y", "x", "region")


_REACH = f"""WITH RECURSIVE {_G}, m AS (SELECT image_id, y, x, v, y * {_SIDE} + x AS p FROM g WHERE v >= LEAST),
link AS (SELECT a.image_id, a.p AS a, b.p AS b FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT image_id, p AS a, p AS b FROM m UNION SELECT r.image_id, r.a, l.b FROM reach r JOIN link l ON l.image_id = r.image_id AND l.a = r.b),
comp AS (SELECT image_id, a AS p, min(b) AS c FROM reach GROUP BY 1, 2)"""
_REGIONS = f"""{_REACH}, reg AS (SELECT image_id, c, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area, round(max(v), 6) AS score_max, round(avg(v), 6) AS score_mean FROM comp JOIN m USING (image_id, p) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY score_max DESC, score_mean DESC, area DESC, y0, x0, y1, x1))::INT AS region, x0, y0, x1, y1, area, score_max FROM reg"""


_Z = "p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM p), z AS (SELECT id, (x - mx) / sx AS x, (y - my) / sy AS y FROM p, m)"


def _bytes(spark, sf_dir):
    """A 16 x 16 map of whole numbers up to 250 for each supplier; a tenth of the suppliers are training images."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % _SIDE).cast("int").alias("y"), (F.col("l_quantity") % _SIDE).cast("int").alias("x")).agg((F.max("l_quantity") * 5).cast("int").alias("v"))


_B = f"b AS (SELECT l_suppkey AS image_id, (l_partkey % {_SIDE})::INT AS y, (l_quantity % {_SIDE})::INT AS x, (max(l_quantity) * 5)::INT AS v FROM lineitem GROUP BY 1, 2, 3)"
_FULL = f"{_B}, f AS (SELECT i.image_id, k // {_SIDE} AS y, k % {_SIDE} AS x, coalesce(v, 0) AS v FROM (SELECT image_id, unnest(range(0, {_SIDE * _SIDE})) AS k FROM (SELECT DISTINCT image_id FROM b)) i LEFT JOIN b ON b.image_id = i.image_id AND b.y = k // {_SIDE} AND b.x = k % {_SIDE})"


def _pixel_map(detector):
    def query(spark, sf_dir):
        rows = _bytes(spark, sf_dir)
        return _rounded(detector().fit(rows.where("image_id % 2 = 0")).maps(rows), "v")

    return query


def _images(spark, sf_dir):
    """The maps as image rows, made once for all who read them, in files enough for all cores: a row is small beside the work on it."""
    rows = images.images_of(_bytes(spark, sf_dir), _SIDE, _SIDE)
    return settle(rows.repartition(4 * spark.sparkContext.defaultParallelism, "image_id"))


def _features(name, **how):
    def query(spark, sf_dir):
        found = images.extract(_images(spark, sf_dir), name, **how)
        return found.select("id", F.posexplode("features").alias("k", "v")).select("id", "k", F.round("v", 7).alias("v"))

    return query


def gray_levels(spark, sf_dir):
    """The colour histogram of images whose three channels are the map."""
    rows = _images(spark, sf_dir).withColumn("channels", F.lit(3)).withColumn("data", F.flatten(F.transform("data", lambda v: F.array(v, v, v))))
    found = images.extract(rows, "color_hist", colorspace="rgb", bins=(8, 8, 8))
    return found.select("id", F.posexplode("features").alias("k", "v")).select("id", "k", F.round("v", 7).alias("v"))


def _template_map(kind):
    def query(spark, sf_dir):
        rows = _images(spark, sf_dir)
        return _rounded(pixel_maps.TemplateMap(kind=kind).fit(rows.where("image_id % 2 = 0")).score(rows), "score")

    return query


def _corrupted(name):
    def query(spark, sf_dir):
        found = images.corrupt(_images(spark, sf_dir), name, 3, 7)
        return found.select("image_id", F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v) / F.size("data"), 6).alias("mean"))

    return query


def _patch_map(**how):
    def query(spark, sf_dir):
        rows = _images(spark, sf_dir)
        return _rounded(patch_maps.PatchEmbeddingMap(**how).fit(rows.where("image_id % 2 = 0")).maps(rows), "v")

    return query


def _made_defect(preset):
    """Pixels that changed, inside and outside the mask, of each image."""

    def query(spark, sf_dir):
        rows = _images(spark, sf_dir)
        made = synthesis.synthesise(rows, preset, 5).select("image_id", F.col("data").alias("to"), "mask", "label")
        both = rows.join(made, "image_id").select("image_id", "label", F.posexplode(F.arrays_zip("data", "to", "mask")).alias("k", "p"))
        moved = (F.col("p.data") != F.col("p.to")).cast("long")
        return both.groupBy("image_id", "label").agg(F.sum(F.col("p.mask").cast("long")).alias("area"), F.sum(moved * F.col("p.mask")).alias("inside"), F.sum(moved * (1 - F.col("p.mask"))).alias("outside"))

    return query


def stitched_unequal(spark, sf_dir):
    """Tiles of 8 pixels every 6, each with its own number on top, so that overlaps differ: their mean."""
    sizes = _grid(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(_SIDE).alias("height"), F.lit(_SIDE).alias("width"))
    cut = maps.cut_tiles(_grid(spark, sf_dir), maps.tiles(sizes, 8, 6)).withColumn("v", F.col("v") + F.col("y0") + 10 * F.col("x0"))
    return _rounded(maps.stitch(cut, "mean"), "v")


def stitched_hann(spark, sf_dir):
    """The same, weighted by raised cosines."""
    sizes = _grid(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(_SIDE).alias("height"), F.lit(_SIDE).alias("width"))
    cut = maps.cut_tiles(_grid(spark, sf_dir), maps.tiles(sizes, 8, 6)).withColumn("v", F.col("v") + F.col("y0") + 10 * F.col("x0"))
    return _rounded(maps.stitch(maps.hann_weights(cut, 8, 8), "hann"), "v")


def cleaned_maps(spark, sf_dir):
    return _rounded(maps.cleaned(_bytes(spark, sf_dir), "minmax"), "v")


def _part(spark, sf_dir):
    return features(read(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice")


def standard_scaler(spark, sf_dir):
    rows = _part(spark, sf_dir)
    return projectors.StandardScaler().fit(rows).transform(rows).select("id", F.posexplode("features").alias("k", "v")).select("id", "k", F.round("v", 7).alias("v"))


def pca_projector(spark, sf_dir):
    """Components of the scaled features; of two they are the sum and the difference."""
    rows = _part(spark, sf_dir)
    rows = projectors.StandardScaler().fit(rows).transform(rows)
    found = projectors.PCAProjector(whiten=True).fit(rows).transform(rows)
    return found.select("id", F.posexplode("features").alias("k", "v")).select("id", "k", F.round("v", 6).alias("v"))


def robustness_report(spark, sf_dir):
    """Half of the images have a made pit; the detector learned edges of other images."""
    rows = _images(spark, sf_dir)
    made = synthesis.synthesise(rows.where("image_id % 4 = 1"), "pit", 3).select(*images.IMAGE, F.lit(1).alias("label"))
    tests = made.union(rows.where("image_id % 4 = 3").select(*images.IMAGE, F.lit(0)))
    model = create_model("core_knn").fit(images.extract(rows.where("image_id % 2 = 0"), "edge_stats"))
    return _rounded(robustness.score_robustness(model, tests, "edge_stats", severities=(1, 3, 5)), "auroc", "average_precision", "auroc_drop", "average_precision_drop")


def hourly(spark, sf_dir):
    return _rounded(watch.windowed(read(spark, sf_dir, "events")), "mean", "sd")


def user_sessions(spark, sf_dir):
    return _rounded(watch.sessions(read(spark, sf_dir, "events")), "total")


def queries():
    found = {"pixel_mean_map": _pixel_map(pixel_maps.MeanAbsDiffMap), "pixel_gaussian_map": _pixel_map(pixel_maps.GaussianMap), "pixel_mad_map": _pixel_map(pixel_maps.MADMap)}
    found |= {kind: _template_map(kind) for kind in pixel_maps.MAPS}
    found |= {f"feature_{name}": _features(name) for name in images.EXTRACTORS if name not in ("color_hist", "patch_stats", "multi")}
    found |= {"feature_patch_stats": _features("patch_stats", size=None), "feature_gray_levels": gray_levels}
    found |= {f"corrupt_{name}": _corrupted(name) for name in images.CORRUPTIONS}
    return found | {"map_topk_mean": reduce_topk, "map_area": reduce_area, "map_roi_stats": roi_stats, "map_border_mean": border, "tile_coordinates": tile_coordinates, "tile_stitch": stitched, "tile_stitch_unequal": stitched_unequal, "tile_stitch_hann": stitched_hann, "map_cleaned": cleaned_maps, "feature_standard_scaler": standard_scaler, "feature_pca_projector": pca_projector, "robustness_report": robustness_report, "patch_embedding_map": _patch_map(detector="core_dtc", size=2, interpolation="nearest"), "patch_embedding_map_knn": _patch_map(detector="core_knn", size=4, stride=2, features="edge_stats"), **{f"synthesis_{p}": _made_defect(p) for p in synthesis.PRESETS}, "defect_regions": defect_regions, "defect_regions_tiled": defect_regions_tiled, "labelled_tiles": labelled_tiles, "events_hourly": hourly, "events_sessions": user_sessions}


def oracle_sql():
    return {
        "pixel_mean_map": f"WITH {_B}, t AS (SELECT y, x, avg(v) AS mu FROM b WHERE image_id % 2 = 0 GROUP BY 1, 2) SELECT image_id, y, x, round(least(abs(v - mu) / 255, 1.0), 9) AS v FROM b JOIN t USING (y, x)",
        "pixel_gaussian_map": f"WITH {_B}, t AS (SELECT y, x, avg(v) AS mu, coalesce(stddev_samp(v), 0) AS sd FROM b WHERE image_id % 2 = 0 GROUP BY 1, 2) SELECT image_id, y, x, round(abs(v - mu) / (greatest(sd, 1.0) + 1e-6), 9) AS v FROM b JOIN t USING (y, x)",
        "pixel_mad_map": f"WITH {_B}, m AS (SELECT y, x, median(v) AS med FROM b WHERE image_id % 2 = 0 GROUP BY 1, 2), t AS (SELECT y, x, med, median(abs(v - med)) AS mad FROM b JOIN m USING (y, x) WHERE image_id % 2 = 0 GROUP BY 1, 2, 3) SELECT image_id, y, x, round(0.6745 * abs(v - med) / (greatest(mad, 1.0) + 1e-6), 9) AS v FROM b JOIN t USING (y, x)",
        "feature_patch_stats": f"WITH {_FULL}, c AS (SELECT image_id AS id, (y // 4 * 4 + x // 4)::INT AS cell, v / 255.0 AS v FROM f), s AS (SELECT id, cell, avg(v) AS mu, greatest(stddev_pop(v), 1e-12) AS sd, stddev_pop(v) AS sd0 FROM c GROUP BY 1, 2), z AS (SELECT id, cell, mu, sd0, avg(((v - mu) / sd) ** 3) AS skew, avg(((v - mu) / sd) ** 4) - 3 AS kurt FROM c JOIN s USING (id, cell) GROUP BY 1, 2, 3, 4) SELECT id, (cell * 4 + k)::INT AS k, round([mu, sd0, skew, kurt][k + 1], 7) AS v FROM z, (VALUES (0), (1), (2), (3)) q(k)",
        "feature_gray_levels": f"WITH {_FULL}, n AS (SELECT image_id AS id, v // 32 AS bin, count(*) AS n FROM f GROUP BY 1, 2), a AS (SELECT DISTINCT image_id AS id, unnest(range(0, 24)) AS k FROM b) SELECT a.id, k::INT AS k, round(coalesce(n, 0) / (3.0 * {_SIDE * _SIDE}), 7) AS v FROM a LEFT JOIN n ON n.id = a.id AND n.bin = a.k % 8",
        "map_topk_mean": f"WITH {_G} SELECT image_id, round(avg(v), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY image_id) AS n FROM g) WHERE r <= greatest(1, ceil(n * 0.05)) GROUP BY 1",
        "map_area": f"WITH {_G} SELECT image_id, round(avg((v >= 0.0583)::INT), 9) AS score FROM g GROUP BY 1",
        "map_roi_stats": f"WITH {_G} SELECT image_id, round(max(v), 9) AS roi_max, round(avg(v), 9) AS roi_mean FROM g WHERE x BETWEEN 4 AND 11 AND y BETWEEN 4 AND 11 GROUP BY 1",
        "map_border_mean": f"WITH {_G} SELECT image_id, round(avg(CASE WHEN x BETWEEN 2 AND 13 AND y BETWEEN 2 AND 13 THEN v ELSE 0 END), 9) AS score FROM g GROUP BY 1",
        "tile_coordinates": "WITH i AS (SELECT s_suppkey AS image_id, (s_suppkey % 7 + 5)::INT AS h, (s_nationkey + 4)::INT AS w FROM supplier), y AS (SELECT DISTINCT image_id, h, w, least(k * 3, h - 4) AS y0 FROM i, range(0, 20) r(k) WHERE k * 3 < h - 4 + 3), x AS (SELECT DISTINCT image_id, least(k * 3, w - 4) AS x0 FROM i, range(0, 20) r(k) WHERE k * 3 < w - 4 + 3) SELECT image_id, y0::INT AS y0, x0::INT AS x0, (y0 + 4)::INT AS y1, (x0 + 4)::INT AS x1 FROM y JOIN x USING (image_id)",
        "tile_stitch": f"WITH {_G} SELECT image_id, y, x, round(v, 9) AS v FROM g",
        "defect_regions_tiled": _REGIONS.replace("LEAST", "0.0701"),
        "labelled_tiles": _REACH.replace("LEAST", "0.0601") + " SELECT image_id, y, x, (dense_rank() OVER (PARTITION BY image_id ORDER BY c))::INT AS region FROM comp JOIN m USING (image_id, p)",
        "tile_stitch_unequal": f"WITH {_G}, s AS (SELECT unnest([0, 6, 8]) AS s) SELECT image_id, y, x, round(avg(v + a.s + 10 * b.s), 9) AS v FROM g, s a, s b WHERE y >= a.s AND y < a.s + 8 AND x >= b.s AND x < b.s + 8 GROUP BY 1, 2, 3",
        "tile_stitch_hann": f"WITH {_G}, s AS (SELECT unnest([0, 6, 8]) AS s), t AS (SELECT image_id, y, x, v + a.s + 10 * b.s AS v, greatest((0.5 - 0.5 * cos(2 * pi() * (y - a.s) / 7)) * (0.5 - 0.5 * cos(2 * pi() * (x - b.s) / 7)), 1e-3) AS w FROM g, s a, s b WHERE y >= a.s AND y < a.s + 8 AND x >= b.s AND x < b.s + 8) SELECT image_id, y, x, round(sum(v * w) / sum(w), 9) AS v FROM t GROUP BY 1, 2, 3",
        "map_cleaned": f"WITH {_B}, e AS (SELECT image_id, (max(y) + 1) * (max(x) + 1) > count(*) AS holes, min(v) AS lo, max(v) AS hi FROM b GROUP BY 1) SELECT image_id, y, x, round(least(greatest((v - CASE WHEN holes THEN 0 ELSE lo END) / greatest(hi - CASE WHEN holes THEN 0 ELSE lo END, 1e-8), 0), 1), 9) AS v FROM b JOIN e USING (image_id)",
        "feature_standard_scaler": f"WITH {_Z} SELECT id, k::INT AS k, round(CASE k WHEN 0 THEN x ELSE y END, 7) AS v FROM z, (VALUES (0), (1)) q(k)",
        "feature_pca_projector": f"WITH {_Z}, c AS (SELECT avg(x * y) AS r FROM z) SELECT id, k::INT AS k, round(CASE k WHEN 0 THEN (x + sign(r) * y) / sqrt(2 * (1 + abs(r))) ELSE (x - sign(r) * y) / sqrt(2 * (1 - abs(r))) END, 6) AS v FROM z, c, (VALUES (0), (1)) q(k)",
        "patch_embedding_map": f"WITH {_FULL}, c AS (SELECT image_id, y // 2 AS py, x // 2 AS px, y % 2 * 2 + x % 2 AS k, v / 255.0 AS v FROM f), m AS (SELECT k, avg(v) AS mu FROM c WHERE image_id % 2 = 0 GROUP BY k), d AS (SELECT image_id, py, px, sqrt(sum((v - mu) ** 2)) AS d FROM c JOIN m USING (k) GROUP BY 1, 2, 3) SELECT image_id, y::INT AS y, x::INT AS x, round(d, 9) AS v FROM f JOIN d USING (image_id) WHERE py = y // 2 AND px = x // 2",
        "events_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS sd FROM events GROUP BY 1, 2",
        "events_sessions": "WITH a AS (SELECT *, (ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n, round(sum(value), 9) AS total FROM b GROUP BY user_id, s",
    }
