"""Detectors over all pairs of rows that need several rounds: minimum spanning tree and stochastic outlier selection.

Both meet rows with blocks by the joins of ``metric_join``; between the rounds there are only small tables.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from oddlens.operators.base import Detector
from oddlens.operators.components import connected_components
from oddlens.operators.metric_join import Blocks, Layout, Meeting, Space, _cell_parts, _runs, _sent, _sent_type, cell_bank, choose_pivots, grid_shape, in_blocks, in_steps, meet, nearest_blocks, nearest_foreign, on_grid, small_batches
from oddlens.operators.neighbours import nearest
from oddlens.operators.registry import register_model
from oddlens.sources.scratch import settle, with_row_id

FOUND = "comp long, d double, a long, b long, other long"
LISTED = 16  # nearest rows of each row, found once for all rounds


def _foreign_cell(left: pa.Table, right: pa.Table, space: Space, pivots: np.ndarray) -> pa.Table:
    """For each component among the rows, its shortest way to a row of another one: ties by the lesser and the greater node."""
    y, others, comps, layout = cell_bank(right, space)
    groups, out = _runs(layout.rows), []
    for values, ids, extra in zip(left.column("values").to_pylist(), left.column("ids"), left.column("extra"), strict=True):
        x, ids, own = space.of(values), ids.values.to_numpy(zero_copy_only=False), extra.values.to_numpy(zero_copy_only=False)
        best = np.full(len(x), np.inf)
        for start, end, least in _cell_parts(x, layout, groups, pivots, space):
            rows = np.arange(len(x)) if least is None else np.flatnonzero(least <= space.reach(best))
            at, to, d = nearest_foreign(x[rows], own[rows], y[start:end], comps[start:end], space)
            at, to = rows[at], to + start
            np.minimum.at(best, at, d)
            out.append((own[at], d, np.minimum(ids[at], others[to]), np.maximum(ids[at], others[to]), comps[to]))
    own, d, low, high, other = (np.concatenate([o[j] for o in out] or [np.empty(0, float if j == 1 else int)]) for j in range(5))
    order = np.lexsort((high, low, d, own))
    first = order[np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])] if len(order) else order
    return pa.Table.from_arrays([pa.array(v[first]) for v in (own, d, low, high, other)], ["comp", "d", "a", "b", "other"])


def _searched(asked: DataFrame, rows: DataFrame, n: int, space: Space, pivots: np.ndarray) -> DataFrame:
    """(comp, e): the shortest edges from the rows ``asked`` (id, features, extra: component) to rows of other components."""
    bank, held = in_blocks(rows, space, pivots, n), in_blocks(asked, space, pivots, asked.count())
    work = partial(_foreign_cell, space=space, pivots=pivots)
    found = on_grid(held.table.withColumnRenamed("block", "own"), "own", held.layout.block, bank, grid_shape(held, bank), lambda left, right: work(left, right), FOUND)
    return settle(found.groupBy("comp").agg(F.min(F.struct("d", "a", "b", "other")).alias("e")))


def spanning_edges(rows: DataFrame, n: int, space: Space) -> DataFrame:
    """(a, b, d): the minimum spanning tree of ``rows`` (id long, features; n of them), by Boruvka's rounds.

    In each round every component but the largest takes its shortest edge to another; ties go by the lesser and the greater
    node. All rows' LISTED nearest rows are found once, and a row's first one of another component is its shortest way
    there. Only rows whose whole list has become their own component's, and reaches no farther than the
    component's shortest edge so far, are searched for among all rows.
    """
    empty = rows.sparkSession.createDataFrame([], "a long, b long, d double")
    if n < 2:
        return empty
    rows, out = rows.select("id", "features"), None
    pivots = choose_pivots(rows, space, n)
    held = in_blocks(rows, space, pivots, n)
    live = nearest_blocks(held, held, min(LISTED, n - 1), True)
    last = settle(live.groupBy("id").agg(F.max("d").alias("last"), F.count("*").alias("listed")))
    live = live.select("id", "other", "d")
    of = settle(rows.select("id", F.col("id").alias("comp")))
    while True:
        largest = of.groupBy("comp").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps")).first()
        if largest.comps == 1:
            return empty if out is None else out
        live = settle(live.select("id", "other", "d").join(of, "id").join(of.toDF("other", "to"), "other").where("comp <> to"))
        each = live.where(F.col("comp") != largest.m.comp).select("comp", F.struct("d", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.col("to").alias("other")).alias("e"))
        best = settle(each.groupBy("comp").agg(F.min("e").alias("e")))
        if largest.comps < n:
            quiet = of.where(F.col("comp") != largest.m.comp).join(live.select("id").distinct(), "id", "left_anti").join(last.where(F.col("listed") < n - 1), "id")
            asked = quiet.join(best.select("comp", "e.d"), "comp", "left").where(F.col("d").isNull() | (F.col("last") <= F.col("d")))
            asked = settle(asked.select("id", F.col("comp").alias("extra")).join(rows, "id"))
            if not asked.isEmpty():
                more = _searched(asked, rows.join(of.withColumnRenamed("comp", "extra"), "id"), n, space, pivots)
                best = settle(best.union(more).groupBy("comp").agg(F.min("e").alias("e")))
        edges = best.select("e.a", "e.b", "e.d").distinct()
        out = settle(edges if out is None else out.union(edges))
        merged = connected_components(best.select(F.col("comp").alias("a"), F.col("e.other").alias("b"))).toDF("comp", "new")
        of = settle(of.join(merged, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")))


@register_model("core_mst_outlier", "classical", "core")
class MSTOutlier(Detector):
    """The longest edge at a row in the minimum spanning tree of all training rows; other rows: distance to the nearest, and with ``max`` at least its edge."""

    @classmethod
    def defaults(cls):
        return {"metric": "euclidean", "score_mode": "max"}

    def _fit(self, train):
        named = with_row_id(train, "node")
        rows = named.select(F.col("node").alias("id"), "features")
        edges = spanning_edges(rows, train.count(), Space(self.n_features, self.metric))
        longest = edges.select(F.explode(F.array("a", "b")).alias("node"), "d").groupBy("node").agg(F.max("d").alias("own"))
        self.own = settle(named.select("id", "node").join(longest, "node", "left").select("id", F.coalesce("own", F.lit(0.0)).alias("own")))

    def _train_scores(self, train):
        return self.own.select("id", F.col("own").alias("score"))

    def _score(self, rows):
        near = nearest(rows, self.train, 1, self.n_features, False, self.metric).join(self.own.withColumnRenamed("id", "other"), "other")
        far = F.col("d") if self.score_mode == "nn" else F.greatest("d", "own")
        return near.select("id", F.when(F.col("d") <= 1e-12, F.col("own")).otherwise(far).alias("score"))


# Stochastic outlier selection

STATE = "block long, ids array<long>, values binary, extra array<long>, beta array<double>, low array<double>, high array<double>, near array<double>, done boolean, total array<double>"
PASSES = 60
NEAREST = 48  # neighbours from which a row's precision is first bounded
FOLDS = 40.0  # a row's chances below e^-FOLDS / n of the largest are less than the last place of their sum


def _asked(batches, space: Space, pivots: np.ndarray, layout: Layout, folds: float, second: str, schema: pa.Schema):
    """Each block of rows with the blocks that may hold rows of its rows' chances: precision and ``second`` of a row travel as pairs in ``radius``, its weight in ``extra``."""
    for batch in batches:
        for i in range(batch.num_rows):
            beta, near, other, weight = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("beta", "near", second, "extra"))
            with np.errstate(divide="ignore"):
                reach = near + folds / beta
            one = pa.ListArray.from_arrays(pa.array([0, len(beta)], pa.int32()), pa.array(np.arange(len(beta))))
            asked = pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1), batch.column("values").slice(i, 1), pa.array([reach.tobytes()]), one], ["ids", "values", "radius", "extra"])
            for sent in _sent([asked], space, pivots, layout, None, schema, False):
                at = sent.column("extra")[0].values.to_numpy()
                pairs = pa.array([np.concatenate([beta[at], other[at]]).tobytes()], schema.field("radius").type)
                weights = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(weight[at])).cast(schema.field("extra").type)
                yield pa.RecordBatch.from_arrays([sent.column("block"), sent.column("ids"), sent.column("values"), pairs, weights], schema=schema)


def _apart(m: Meeting, space: Space):
    """Some rows, their distances to the block's, and which of these are the rows themselves."""
    for part, d in in_steps(m.x, len(m.y), lambda z: space.between(z, m.y)):
        yield part, d, m.ids[part, None] == m.others[None]


def _sums(m: Meeting, space: Space) -> pa.RecordBatch:
    """For each row: sum of e = exp(-beta (d - near)), of d e and of d^2 e over the other rows, equal ones by their number."""
    beta, near = np.split(m.radius, 2)
    out = np.zeros((3, len(m.x)))
    for part, d, same in _apart(m, space):
        gap = d - near[part, None]
        e = np.exp(-beta[part, None] * np.maximum(gap, 0)) * (m.other_extra - same)
        out[:, part] = e.sum(1), (gap * e).sum(1), (gap * gap * e).sum(1)
    return pa.RecordBatch.from_arrays([pa.array(m.ids), *(pa.array(v) for v in out)], ["id", "s0", "s1", "s2"])


def _missed(m: Meeting, space: Space) -> pa.RecordBatch:
    """For each bank row: the log of the chance that none of the rows picks it. The second of a pair is the log of the row's sum of exp(-beta d)."""
    beta, whole = np.split(m.radius, 2)
    out = np.zeros(len(m.y))
    for part, d, same in _apart(m, space):
        p = np.exp(np.minimum(-beta[part, None] * d - whole[part, None], 0))
        out += (np.log(np.maximum(1 - p, 1e-300)) * (m.extra[part, None] - same)).sum(0)
    return pa.RecordBatch.from_arrays([pa.array(m.others), pa.array(out)], ["id", "miss"])


def _every_pair(state: DataFrame, held: Blocks, compare, schema: str, folds: float, second: str = "near") -> DataFrame:
    kind = _sent_type(T.LongType())
    asked = state.mapInArrow(partial(_asked, space=held.space, pivots=held.pivots, layout=held.layout, folds=folds, second=second, schema=to_arrow_schema(kind)), kind)
    with small_batches(state.sparkSession):
        return settle(meet(asked, held, partial(compare, space=held.space), schema))


def _newton(beta, low, high, s0, s1, s2, goal: float, eps: float):
    """One safeguarded Newton step on rows' precisions towards the entropy ``goal``: in log beta, inside the bracket; and which are done."""
    s0 = np.maximum(s0, 1e-300)
    mean = s1 / s0
    gap = np.log(s0) + beta * mean - goal
    spread = np.maximum(s2 / s0 - mean**2, 0)
    up = gap > 0
    low, high = np.where(up, beta, low), np.where(up, high, beta)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        step = beta * np.exp(np.clip(gap / (beta**2 * spread), -3, 3))
    inside = np.isfinite(step) & (step > low) & (step < high)
    middle = np.where(np.isinf(high), beta * 4, np.where(low > 0, np.sqrt(np.maximum(low, 1e-300) * np.where(np.isinf(high), 1, high)), beta / 4))
    done = (np.abs(gap) <= eps) | (up & (beta**2 * spread < 1e-12))  # or ties leave the entropy above the goal
    return np.where(done, beta, np.where(inside, step, middle)), low, high, done


def _started(batches, goal: float, eps: float, schema: pa.Schema):
    """(id, near, beta): the precision at which a row's copies and nearest rows alone have the entropy ``goal``; with all rows it has no less."""
    for batch in batches:
        lists = [sorted((v["d"], v["w"]) for v in r) for r in batch.column("v").to_pylist()]
        d, w = np.full((len(lists), max(map(len, lists), default=0) + 1), 0.0), np.zeros((len(lists), max(map(len, lists), default=0) + 1))
        for i, (r, copies) in enumerate(zip(lists, batch.column("copies").to_pylist(), strict=True)):
            w[i, 0] = copies - 1
            for j, (gap, weight) in enumerate(r, 1):
                d[i, j], w[i, j] = gap, weight
        near = np.where(w > 0, d, np.inf).min(1)
        gap = np.maximum(d - near[:, None], 0)
        beta = 1 / np.maximum((gap * w).sum(1) / np.maximum(w.sum(1), 1), 1e-300)
        low, high = np.zeros(len(beta)), np.full(len(beta), np.inf)
        for _ in range(200):
            e = np.exp(-beta[:, None] * gap) * w
            beta, low, high, done = _newton(beta, low, high, e.sum(1), (gap * e).sum(1), (gap * gap * e).sum(1), goal, eps)
            if done.all():
                break
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(near), pa.array(np.where(done, beta, low))], schema=schema)


def _stepped(batches, goal: float, eps: float, schema: pa.Schema):
    """A step of ``_newton`` for each block."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            beta, low, high, near = (np.array(r[c], float) for c in ("beta", "low", "high", "near"))
            s0, s1, s2 = np.array([[v["s0"], v["s1"], v["s2"]] for v in r["sums"]], float).reshape(-1, 3).T
            r["total"] = (np.log(np.maximum(s0, 1e-300)) - beta * near).tolist()  # log of the sum of exp(-beta d)
            beta, low, high, done = _newton(beta, low, high, s0, s1, s2, goal, eps)
            r["beta"], r["low"], r["high"], r["done"] = beta.tolist(), low.tolist(), high.tolist(), bool(done.all())
            del r["sums"]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


@register_model("core_sos", "classical", "core")
class SOS(Detector):
    """Stochastic outlier selection over the scored rows: the chance that no other row picks this one as neighbour.

    Rows with equal features are one row and its number. Each row's precision is found by Newton's steps, all rows at once,
    from the precision that its nearest rows alone would have, which is never above it: a row's chances beyond FOLDS and the
    log of the number of rows are below the last place of their sum, so a step joins rows with the blocks within that reach
    only. The last pass sums log(1 - p) by the picked row.
    """

    @classmethod
    def defaults(cls):
        return {"perplexity": 4.5, "metric": "euclidean", "eps": 1e-5}

    def _fit(self, train):
        pass

    def _score(self, rows):
        named = with_row_id(rows.groupBy("features").agg(F.count("*").alias("extra")), "node")
        n, different = named.agg(F.sum("extra"), F.count("*")).first()
        if (n or 0) < 2:
            return rows.select("id", F.lit(1.0).alias("score"))
        own = named.select(F.col("node").alias("id"), "features", "extra")
        space = Space(self.n_features, self.metric)
        held = in_blocks(own, space, choose_pivots(own, space, different), different)
        goal, eps, folds, kind = float(np.log(self.perplexity)), min(self.eps, 1e-9), FOLDS + float(np.log(n)), T._parse_datatype_string(STATE)
        same = lambda v: F.transform("ids", lambda _: F.lit(float(v)))
        beside = max(1, min(different - 1, max(NEAREST, int(8 * self.perplexity))))
        edges = nearest_blocks(held, held, beside, True).join(own.select(F.col("id").alias("other"), F.col("extra").alias("w")), "other")
        near = own.select("id", F.col("extra").alias("copies")).join(edges.groupBy("id").agg(F.collect_list(F.struct("d", "w")).alias("v")), "id", "left")
        start = T._parse_datatype_string("id long, near double, beta double")
        near = near.withColumn("v", F.coalesce("v", F.array().cast("array<struct<d:double,w:bigint>>")))
        least = near.mapInArrow(partial(_started, goal=goal, eps=eps, schema=to_arrow_schema(start)), start)
        each = held.table.select("block", F.posexplode("ids").alias("at", "id")).join(least, "id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "near", "beta"))).alias("v"))
        figure = lambda c: F.transform("v", lambda v: v[c])
        state = held.table.select("block", "ids", "values", "extra").join(each, "block")
        if few := n - 1 <= self.perplexity:  # even equal chances have too little entropy
            state = settle(state.select("block", "ids", "values", "extra", same(0).alias("beta"), same(0).alias("low"), same(np.inf).alias("high"), figure("near").alias("near"), F.lit(True).alias("done"), same(np.log(n - 1)).alias("total")))
        else:
            low = F.transform("v", lambda v: v["beta"] * (1 - 1e-9))
            state = settle(state.select("block", "ids", "values", "extra", figure("beta").alias("beta"), low.alias("low"), same(np.inf).alias("high"), figure("near").alias("near"), F.lit(False).alias("done"), same(0).alias("total")))
        for _ in range(0 if few else PASSES):
            sums = _every_pair(state, held, _sums, "id long, s0 double, s1 double, s2 double", folds).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("s0", "s1", "s2")))
            each = held.table.select("block", F.posexplode("ids").alias("at", "id")).join(sums, "id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "s0", "s1", "s2"))).alias("sums"))
            state = settle(state.join(each, "block").mapInArrow(partial(_stepped, goal=goal, eps=eps, schema=to_arrow_schema(kind)), kind))
            if state.where("NOT done").isEmpty():
                break
        picked = _every_pair(state, held, _missed, "id long, miss double", folds, "total").groupBy("id").agg(F.exp(F.sum("miss")).alias("score"))
        found = named.select("features", "node").join(picked.withColumnRenamed("id", "node"), "node", "left").select("features", F.coalesce("score", F.lit(1.0)).alias("score"))
        return rows.select("id", "features").join(found, "features").select("id", "score")
