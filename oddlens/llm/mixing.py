"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of the budget by its weight; no source gets more than ``most`` times its own size, and
what it would get beyond that is shared out again by weight until no source is above. A source's share is met by
whole passes over it and, for the rest, by a choice of documents: they are counted by exact token length, lengths
are taken in proportion, and a bounded-knapsack dynamic program over the lengths left fits the remaining budget.
Which documents of a length are chosen is decided by a seeded hash of doc_id.

Only totals for each source reach the driver (one row for each source: up to ``MOST_SOURCES``); the histogram of a
source is one group of at most as many rows as there are lengths (more sources are refused: each is a row of the
driver's table of shares). Documents are ranked within buckets of one
(source, length) that hold about BUCKET rows, however many documents are alike.

Null or empty text has size 0 and takes nothing. A null source is a source. Rows that repeat a doc_id are
documents of their own; a null doc_id is ranked like any other value. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddlens.llm.common import Batches, byte_rows, mix64, settle

MOST_SOURCES = 1_000_000
BUCKET = 20_000
SPARE = 8  # the dynamic program fits the last budget of this many of the longest texts: some 5 bytes a word


def _sizes(batches: Batches) -> Batches:
    for batch in batches:
        sizes = [len((t or b"").split()) for t in byte_rows(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])


def targets(totals: dict[str | None, int], weights: dict[str | None, float], budget: float, least: float, most: float) -> dict[str | None, float]:
    """Shares of ``budget`` by weight, each from ``least`` to ``most`` times its source's total.

    Sources out of bounds are fixed at their bound and the rest is shared again, until none is out of bounds.
    """
    out: dict[str | None, float] = {}
    left = float(budget)
    free = dict(weights)
    while free:
        whole = sum(free.values())
        share = {s: left * w / whole if whole else 0.0 for s, w in free.items()}
        above = {s for s in free if share[s] > most * totals[s]}
        below = {s for s in free if share[s] < least * totals[s]}
        surplus = sum(share[s] - most * totals[s] for s in above) - sum(least * totals[s] - share[s] for s in below)
        fixed = above if above and surplus >= 0 or not below else below
        if not fixed:
            return out | share
        for s in fixed:
            out[s] = (most if s in above else least) * totals[s]
            left -= out[s]
            del free[s]
        left = max(0.0, left)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to ``budget``, or as near below as can be found.

    Lengths are distinct and positive. Proportional first, then single documents by largest remainder, down to a
    spare budget of a few documents; that is left to the bounded knapsack, which is exact for it.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    spare = min(budget, SPARE * int(lengths.max()))
    exact = counts * ((budget - spare) / total)
    take = np.minimum(np.floor(exact).astype(np.int64), counts)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(take - exact, kind="stable"):
        if left > spare and lengths[i] <= left and take[i] < counts[i]:
            take[i] += 1
            left -= int(lengths[i])
    if left > 0:
        take += _knapsack(lengths, counts - take, left)
    return take


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the copies of each length with the largest sum up to ``budget``."""
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    first = np.full(budget + 1, -1, np.int32)  # the item that first made a sum reachable
    items: list[tuple[int, int]] = []
    for i in np.argsort(mix64(lengths.astype(np.uint64)), kind="stable"):
        copies, part = min(int(counts[i]), budget // int(lengths[i])), 1
        while copies > 0 and not reach[budget]:  # 1, 2, 4, ... copies and a rest
            part = min(part, copies)
            weight = part * int(lengths[i])
            new = reach[: budget + 1 - weight] & ~reach[weight:]
            first[weight:][new] = len(items)
            reach[weight:] |= new
            items.append((int(i), part))
            copies -= part
            part *= 2
    out = np.zeros(len(lengths), np.int64)
    best = int(np.flatnonzero(reach)[-1])
    while best:
        i, part = items[first[best]]
        out[i] += part
        best -= part * int(lengths[i])
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each length of one source: whole passes, and documents to take once more."""
    pdf = pdf.sort_values("size").reset_index(drop=True)
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(pdf["target"].iloc[0])
    passes = int(target // total) if total else 0
    real = lengths > 0
    extra = np.zeros(len(pdf), np.int64)
    if total:
        extra[real] = fit(lengths[real], counts[real], round(target) - passes * total)
    return pdf.assign(passes=passes, extra=extra)[["key", "size", "n", "passes", "extra"]]


def mix(docs: DataFrame, weights: tuple[float, ...] | dict[str | None, float], budget: float, least: float = 0, most: float = 2, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for each row of ``docs`` (doc_id, text, source).

    ``weights``: by source, or a tuple that sources in code point order, null last, take in turn. ``budget``: words
    of the mix as a multiple of all words. ``taken`` is a multiple of ``size``: the words that the mix takes of the
    document, repeats counted, between ``least`` (rounded down) and ``most`` (rounded up) passes.
    """
    if budget > most or budget < least:
        raise ValueError("the budget can't be met between least and most")
    spark = docs.sparkSession
    sized = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(_sizes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, size long"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("total")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError("more sources than the driver takes")
    totals = {r.source: r.total for r in sorted(sums, key=lambda r: (r.source is None, r.source))}
    by_source = weights if isinstance(weights, dict) else {s: weights[i % len(weights)] for i, s in enumerate(totals)}
    goal = targets(totals, {s: by_source.get(s, 0) for s in totals}, budget * sum(totals.values()), least, most)
    facts = spark.createDataFrame([("n" if s is None else "s" + s, totals[s], float(goal[s])) for s in totals], "key string, source_size long, target double")
    keyed = sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    counts = keyed.groupBy("key", "size").agg(F.count("*").alias("n"))
    plan = settle(counts.join(facts, "key").groupBy("key").applyInPandas(_plan, "key string, size long, n long, passes long, extra long"))

    order = F.xxhash64("doc_id", F.lit(seed))
    rows = keyed.withColumn("order", order).join(plan, ["key", "size"]).withColumn("bucket", F.pmod("order", F.ceil(F.col("n") / BUCKET)))
    partly = rows.where("extra > 0 AND extra < n").groupBy("key", "size", "bucket", "extra").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    quota = partly.select("key", "size", "bucket", F.greatest(F.lit(0), F.least("held", F.col("extra") - F.coalesce(before, F.lit(0)))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("order", "doc_id"))
    ranked = rows.join(quota, ["key", "size", "bucket"], "left").withColumn("rank", rank)
    once_more = F.when(F.col("extra") >= F.col("n"), 1).when(F.col("rank") <= F.col("quota"), 1).otherwise(0)
    return ranked.withColumn("taken", F.col("size") * (F.col("passes") + once_more)).join(facts, "key").select("doc_id", "size", "source_size", "target", "taken", "source")
