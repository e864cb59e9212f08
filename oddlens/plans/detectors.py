"""Registered detector queries: training scores over tables, and DuckDB SQL for the exact ones. Scores are rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlens.functions.vectors import features
from oddlens.operators import distance_covariance, ensembles, graph_scores, kernels, linear, marginal, neighbours, randomised  # noqa: F401  (they register their models)
from oddlens.operators.registry import catalogue, create_model, model_names
from oddlens.sources.scratch import read, with_row_id

LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _round(scores: DataFrame) -> DataFrame:
    return scores.select("id", F.round("score", 6).alias("score"))


def on_lines(spec):
    """A detector over four columns of lineitem, whose rows have no key: they get one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = with_row_id(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_COLUMNS))
        model = create_model(spec).fit(features(rows, "id", *LINE_COLUMNS))
        return rows.join(model.train_scores, "id").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("score", 6).alias("score"))

    return query


def on_embeddings(spec, name: str = "score"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(create_model(spec).fit(features(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")).train_scores)

    return query


def on_parts(spec):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(create_model(spec).fit(features(read(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice")).train_scores)

    return query


def rzscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To 9 places: means of two z-scores often lie on a border of 6."""
    model = create_model("core_rzscore").fit(features(read(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice"))
    return model.train_scores.select("id", F.round("score", 9).alias("score"))


def on_suppliers(spec):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(create_model(spec).fit(features(read(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", "s_nationkey")).train_scores)

    return query


def ecod_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: ECOD over lineitem, labels at the 90 % quantile, anomalies and total by return flag."""
    rows = with_row_id(read(spark, sf_dir, "lineitem").select("l_returnflag", *LINE_COLUMNS))
    model = create_model("core_ecod").fit(features(rows, "id", *LINE_COLUMNS))
    labelled = rows.join(model.train_scores, "id").withColumn("label", (F.col("score") > model.threshold).cast("long"))
    return labelled.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("label").alias("n_anomalies"), F.round(F.max("score"), 6).alias("max_score"))


_MELT = "r AS (SELECT row_number() OVER () AS rid, * FROM lineitem), m AS (" + " UNION ALL ".join(f"SELECT rid, {j} AS j, {c} AS v FROM r" for j, c in enumerate(LINE_COLUMNS)) + ")"
_TAILS = (
    _MELT + """, mu AS (SELECT j, avg(v) AS mu FROM m GROUP BY j), f AS (SELECT m.j, avg((v - mu) ** 3) / nullif(pow(avg((v - mu) ** 2), 1.5), 0) AS sk FROM m JOIN mu USING (j) GROUP BY m.j),
t AS (SELECT rid, j, -ln(greatest(cume_dist() OVER (PARTITION BY j ORDER BY v), 1e-12)) AS l,
  -ln(greatest((count(*) OVER (PARTITION BY j) - rank() OVER (PARTITION BY j ORDER BY v) + 1) / count(*) OVER (PARTITION BY j), 1e-12)) AS u FROM m),
s AS (SELECT rid, l, u, CASE WHEN sk IS NULL OR abs(sk) < 1e-12 THEN l + u WHEN sk > 0 THEN u ELSE l END AS k FROM t JOIN f USING (j)), """
)


def _line_sql(score: str) -> str:
    return f"WITH {_TAILS} q AS (SELECT rid, {score} AS score FROM s GROUP BY rid) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(score, 6) AS score FROM r JOIN q USING (rid)"


_ECOD, _COPOD = "sum(greatest(k, l, u))", "sum(greatest(k, (l + u) / 2))"

_PARTS = "m AS (SELECT p_partkey AS id, 0 AS j, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part)"


def _robust(how: str, places: int = 6) -> str:
    return f"""WITH {_PARTS}, a AS (SELECT j, median(v) AS med FROM m GROUP BY j), b AS (SELECT m.j, greatest(median(abs(v - med)), 1e-12) AS mad FROM m JOIN a USING (j) GROUP BY m.j)
SELECT id, round({how}, {places}) AS score FROM (SELECT id, 0.6745 * abs(v - med) / mad AS z FROM m JOIN a USING (j) JOIN b USING (j)) GROUP BY id"""


_HBOS = f"""WITH {_PARTS}, f AS (SELECT j, min(v) AS lo, max(v) AS hi, count(*) AS n FROM m GROUP BY j),
b AS (SELECT id, m.j, n, CASE WHEN hi <= lo THEN 0 ELSE least(greatest(floor((v - lo) / (hi - lo) * 10), 0), 9) END AS bin FROM m JOIN f USING (j)),
c AS (SELECT j, bin, count(*) AS c FROM b GROUP BY j, bin)
SELECT id, round(sum(-ln((c + 0.1) / (n + 1.0))), 6) AS score FROM b JOIN c USING (j, bin) GROUP BY id"""

_DTC = f"WITH {_PARTS}, a AS (SELECT j, avg(v) AS mu FROM m GROUP BY j) SELECT id, round(sqrt(sum((v - mu) ** 2)), 6) AS score FROM m JOIN a USING (j) GROUP BY id"

_MAHALANOBIS = """WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part),
f AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) + 1e-6 AS a, var_samp(y) + 1e-6 AS d, covar_samp(x, y) AS b FROM p)
SELECT id, round((d * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * d - b * b), 6) AS score FROM p, f"""


_PAIRED = "p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part), f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, coalesce(nullif(stddev_pop(x), 0), 1) AS sx, coalesce(nullif(stddev_pop(y), 0), 1) AS sy FROM p), z AS (SELECT id, (x - mx) / sx AS x, (y - my) / sy AS y FROM p, f)"

_SHRUNK = """WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part), c AS (SELECT id, x - (SELECT avg(x) FROM p) AS x, y - (SELECT avg(y) FROM p) AS y FROM p),
m AS (SELECT count(*) AS n, avg(x * x) AS a, avg(y * y) AS d, avg(x * y) AS b, avg((x * x + y * y) ** 2) AS fourth FROM c),
t AS (SELECT *, (a + d) / 2 AS mu, a * a + d * d + 2 * b * b AS spread FROM m), g AS (SELECT *, (fourth - spread) / (2 * n) AS beta, (spread - 2 * mu * (a + d) + 2 * mu * mu) / 2 AS delta FROM t),
k AS (SELECT *, CASE WHEN delta = 0 THEN 0 ELSE least(beta, delta) / delta END AS part FROM g), s AS (SELECT (1 - part) * a + part * mu AS a, (1 - part) * d + part * mu AS d, (1 - part) * b AS b FROM k)
SELECT id, round((d * x * x - 2 * b * x * y + a * y * y) / (a * d - b * b), 6) AS score FROM c, s"""

_KDE_RATIO = f"""WITH {_PAIRED}, s AS (SELECT a.id, ln(sum(exp(-0.5 * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)))) AS wide, ln(sum(exp(-0.5 * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 0.04))) - 2 * ln(0.2) AS near FROM z a, z b GROUP BY a.id)
SELECT id, round(greatest(wide - near, 0), 6) AS score FROM s"""

_DBSCAN = f"""WITH {_PAIRED}, d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM z a, z b), c AS (SELECT id FROM d WHERE d <= 0.5 GROUP BY id HAVING count(*) >= 5),
n AS (SELECT d.id, min(d) FILTER (c.id IS NOT NULL) AS near FROM d LEFT JOIN c ON c.id = d.other GROUP BY d.id) SELECT id, round(CASE WHEN near IS NULL THEN 1 WHEN near > 0.5 THEN near + 0.5 ELSE near END, 6) AS score FROM n"""

_QMCD = """WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part), r AS (SELECT count(*) AS n, min(x) AS lx, greatest(max(x) - min(x), 1e-300) AS sx, min(y) AS ly, greatest(max(y) - min(y), 1e-300) AS sy FROM p), u AS (SELECT id, (x - lx) / sx AS x, (y - ly) / sy AS y FROM p, r),
q AS (SELECT a.id, sum((1.5 - abs(a.x - b.x) * (1 - abs(a.x - b.x))) * (1.5 - abs(a.y - b.y) * (1 - abs(a.y - b.y)))) / count(*) - 16.0 / 9 AS s FROM u a, u b GROUP BY a.id),
m AS (SELECT avg(s) AS mu, var_pop(s) AS var, max(s) + min(s) AS edge FROM q), t AS (SELECT edge, avg((s - mu) ** 3) < 0 OR avg((s - mu) ** 4) / any_value(var) ** 2 < 3 AS turn FROM q, m GROUP BY edge)
SELECT id, round(CASE WHEN turn THEN edge - s ELSE s END, 6) AS score FROM q, t"""

_DIGITS = "CASE WHEN score = 0 THEN 0 ELSE round(score * pow(10, 11 - floor(log10(abs(score))))) / pow(10, 11 - floor(log10(abs(score)))) END"

_ENSEMBLE = f"""WITH mad AS ({_robust("max(z)", 15)}), hbos AS ({_HBOS.replace(", 6)", ", 15)")}), dtc AS ({_DTC.replace(", 6)", ", 15)")}), a AS (SELECT 0 AS k, * FROM mad UNION ALL SELECT 1, * FROM hbos UNION ALL SELECT 2, * FROM dtc),
m AS (SELECT k, id, {_DIGITS} AS score FROM a), r AS (SELECT id, (row_number() OVER (PARTITION BY k ORDER BY score, id) - 1) / (count(*) OVER (PARTITION BY k) - 1) AS s FROM m) SELECT id, round(avg(s), 6) AS score FROM r GROUP BY id"""


def edges(k: int, distance: str = "list_distance(a.v, b.v)") -> str:
    """CTEs e (id, v) and edges (id, other, d, rank)."""
    return f"""e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM (SELECT a.id, b.id AS other, {distance} AS d FROM e a JOIN e b ON a.id <> b.id)) WHERE rank <= {k})"""


def _pairs(k: int) -> str:
    return edges(k) + ", g AS (SELECT l.id, l.rank AS a, r.rank AS b, x.v AS va, y.v AS vb FROM edges l JOIN edges r ON l.id = r.id AND l.rank < r.rank JOIN e x ON x.id = l.other JOIN e y ON y.id = r.other)"


_NEIGHBOUR_SQL = {
    "core_kde": "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT count(*) AS n, any_value(len(v)) AS d FROM e) SELECT a.id, round(ln(any_value(n)) + any_value(d) * 0.5 * ln(2 * pi()) - ln(sum(exp(-0.5 * list_distance(a.v, b.v) ** 2))), 6) AS score FROM e a, e b, n GROUP BY a.id",
    "core_knn": f"WITH {edges(5)} SELECT id, round(max(d), 6) AS score FROM edges GROUP BY id",
    "core_knn_mean": f"WITH {edges(5)} SELECT id, round(avg(d), 6) AS score FROM edges GROUP BY id",
    "core_knn_median": f"WITH {edges(5)} SELECT id, round(median(d), 6) AS score FROM edges GROUP BY id",
    "core_knn_cosine": f"WITH {edges(5, 'list_cosine_distance(a.v, b.v)')} SELECT id, round(max(d), 6) AS score FROM edges GROUP BY id",
    "core_lid": f"WITH {edges(20)}, k AS (SELECT id, max(d) AS far FROM edges GROUP BY id) SELECT id, round(-avg(ln(d / far)), 6) AS score FROM edges JOIN k USING (id) GROUP BY id",
    "core_ldof": f"WITH {_pairs(10)}, i AS (SELECT id, avg(list_distance(va, vb)) AS inner_ FROM g GROUP BY id), o AS (SELECT id, avg(d) AS outer_ FROM edges GROUP BY id) SELECT id, round(outer_ / inner_, 6) AS score FROM o JOIN i USING (id)",
    "core_odin": f"WITH {edges(10)}, n AS (SELECT e.id, count(x.other) AS n FROM e LEFT JOIN edges x ON x.other = e.id GROUP BY e.id) SELECT id, round(1 - n / (SELECT max(n) FROM n), 6) AS score FROM n",
    "core_neighborhood_entropy": f"""WITH {edges(20)}, s AS (SELECT id, median(d) AS m, min(d) AS lo FROM edges GROUP BY id), w AS (SELECT id, exp(-(d - lo) / m) AS w FROM edges JOIN s USING (id)),
        t AS (SELECT id, sum(w) AS t FROM w GROUP BY id) SELECT id, round(1 + sum(w / t * ln(w / t)) / ln(20), 6) AS score FROM w JOIN t USING (id) GROUP BY id""",
    "core_oddoneout": f"WITH {edges(5)}, m AS (SELECT id, avg(d) AS m FROM edges GROUP BY id) SELECT x.id, round(avg(x.d) / avg(m.m), 6) AS score FROM edges x JOIN m ON m.id = x.other GROUP BY x.id",
    "core_lof": f"""WITH {edges(20)}, k AS (SELECT id, max(d) AS kd FROM edges GROUP BY id), l AS (SELECT x.id, 1 / (avg(greatest(x.d, k.kd)) + 1e-10) AS lrd FROM edges x JOIN k ON k.id = x.other GROUP BY x.id)
        SELECT x.id, round(avg(o.lrd) / any_value(m.lrd), 6) AS score FROM edges x JOIN l o ON o.id = x.other JOIN l m ON m.id = x.id GROUP BY x.id""",
    "core_knn_degree": f"""WITH {edges(10)}, q AS (SELECT quantile_cont(kd, 0.5) AS r FROM (SELECT id, max(d) AS kd FROM edges GROUP BY id)),
        n AS (SELECT a.id, count(*) FILTER (list_distance(a.v, b.v) <= r AND list_distance(a.v, b.v) > 1e-12) AS n FROM e a JOIN e b ON a.id <> b.id, q GROUP BY a.id) SELECT id, round(1 / (n + 1), 6) AS score FROM n""",
    "core_abod": f"""WITH {_pairs(10)}, h AS (SELECT g.id, list_transform(list_zip(va, e.v), lambda p: p[1] - p[2]) AS a, list_transform(list_zip(vb, e.v), lambda p: p[1] - p[2]) AS b FROM g JOIN e USING (id))
        SELECT id, round(-var_pop(list_dot_product(a, b) / (list_dot_product(a, a) * list_dot_product(b, b))), 6) AS score FROM h GROUP BY id""",
    "core_cof": f"""WITH {_pairs(20)}, l AS (SELECT id, b AS rank, min(list_distance(va, vb)) AS link FROM g GROUP BY id, b),
        c AS (SELECT x.id, sum(2.0 * (21 - x.rank) / (21 * 20) * least(x.d, coalesce(l.link, x.d))) AS acd FROM edges x LEFT JOIN l USING (id, rank) GROUP BY x.id)
        SELECT x.id, round(any_value(m.acd) * 20 / sum(o.acd), 6) AS score FROM edges x JOIN c o ON o.id = x.other JOIN c m ON m.id = x.id GROUP BY x.id""",
    "core_sod": f"""WITH {edges(20)}, sh AS (SELECT a.id, b.id AS ref, count(*) AS n FROM edges a JOIN edges b ON a.other = b.other AND a.id <> b.id GROUP BY a.id, b.id),
        refs AS (SELECT id, ref FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, ref) AS r FROM sh) WHERE r <= 10), m AS (SELECT id, unnest(range(0, len(v))) AS j, unnest(v) AS v FROM e),
        z AS (SELECT refs.id, m.j, avg(v) AS mu, var_pop(v) AS var FROM refs JOIN m ON m.id = refs.ref GROUP BY refs.id, m.j), lv AS (SELECT id, 0.8 * avg(var) AS lv FROM z GROUP BY id),
        d AS (SELECT z.id, sqrt(avg((m.v - mu) ** 2)) AS s FROM z JOIN lv USING (id) JOIN m ON m.id = z.id AND m.j = z.j WHERE var < lv GROUP BY z.id)
        SELECT e.id, round(coalesce(s, 0), 6) AS score FROM e LEFT JOIN d USING (id)""",
}


#: Models whose registered query runs on a small table, as their batch or their cost is bounded or their SQL is plain there.
_SMALL = {
    "core_loci": on_suppliers({"name": "core_loci", "kwargs": {"many": True}}),
    "core_sos": on_suppliers("core_sos"),
    "core_imdd": on_suppliers("core_imdd"),
    "core_lmdd": on_suppliers("core_lmdd"),
    "core_feature_bagging": on_embeddings("core_feature_bagging"),
    "core_feature_bagging_spec": on_parts({"name": "core_feature_bagging_spec", "kwargs": {"base_estimator_spec": "core_hbos"}}),
    "core_mahalanobis": on_parts("core_mahalanobis"),
    "core_mahalanobis_shrinkage": on_parts("core_mahalanobis_shrinkage"),
    "core_kde_ratio": on_parts("core_kde_ratio"),
    "core_dbscan": on_parts("core_dbscan"),
    "core_qmcd": on_parts("core_qmcd"),
    "core_score_ensemble": on_parts({"name": "core_score_ensemble", "kwargs": {"detectors": ("core_mad", "core_hbos", "core_dtc")}}),
}


def queries():
    out = {"model_catalogue": lambda spark, sf_dir: catalogue(spark), "ecod_report": ecod_report, "core_ecod": on_lines("core_ecod"), "core_copod": on_lines("core_copod")}
    out |= {n: on_parts(n) for n in ("core_mad", "core_hbos", "core_dtc")} | {"core_rzscore": rzscore}
    out |= {n: on_embeddings(n) for n in ("core_loop", "core_rgraph", *_NEIGHBOUR_SQL) if not n.startswith("core_knn_m")}
    out |= _SMALL
    out |= {n: on_embeddings(n) for n in model_names() if n not in out}
    out |= {f"core_knn_{m}": on_embeddings({"name": "core_knn", "kwargs": {"method": m}}) for m in ("mean", "median")}
    return out


def oracle_sql():
    ecod = _line_sql(_ECOD)
    return {
        "core_ecod": ecod,
        "core_copod": _line_sql(_COPOD),
        "ecod_report": f"WITH {_TAILS} q AS (SELECT rid, {_ECOD} AS score FROM s GROUP BY rid), cut AS (SELECT quantile_cont(score, 0.9) AS cut FROM q) SELECT l_returnflag, count(*) AS n, count(*) FILTER (score > cut) AS n_anomalies, round(max(score), 6) AS max_score FROM r JOIN q USING (rid), cut GROUP BY l_returnflag",
        "core_mad": _robust("max(z)"),
        "core_rzscore": _robust("avg(z)", 9),
        "core_hbos": _HBOS,
        "core_dtc": _DTC,
        "core_mahalanobis": _MAHALANOBIS,
        "core_mahalanobis_shrinkage": _SHRUNK,
        "core_kde_ratio": _KDE_RATIO,
        "core_dbscan": _DBSCAN,
        "core_qmcd": _QMCD,
        "core_score_ensemble": _ENSEMBLE,
        **_NEIGHBOUR_SQL,
    }
