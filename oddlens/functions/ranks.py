"""Ranks and exact quantiles by running counts of distinct values over range partitions; nothing passes through one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddlens.sources.scratch import settle


def running_counts(values: DataFrame) -> DataFrame:
    """(j, v, n) with a row for each distinct value -> also ``upto``, the sum of n over all values up to v of that j."""
    parts = settle(values.repartitionByRange("j", "v").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("j", "part").agg(F.sum("n").alias("held"))
    before = F.sum("held").over(Window.partitionBy("j").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("j", "part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("j", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("inside", inside).join(starts, ["j", "part"]).select("j", "v", "n", (F.col("start") + F.col("inside")).alias("upto"))


def running_sums(rows: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """``rows`` with each of ``sums`` replaced by its sum over the rows of the same keys up to this one by ``order``, and ``all_`` of it over all of them.

    Rows are range-partitioned by keys and order; what the partitions before and beside hold of a key is added from a
    table that has rows only for the keys that partitions share, two for each partition at most. Equal values of
    ``order`` are summed one after another in any order.
    """
    parts = settle(rows.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id()))
    held = parts.groupBy(*keys, "__part").agg(*(F.sum(c).alias(c) for c in sums))
    beside = Window.partitionBy(*keys)
    before = beside.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shared = settle(held.withColumn("__n", F.count("*").over(beside)).where("__n > 1").select(*keys, "__part", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"__{c}_before") for c in sums), *(F.sum(c).over(beside).alias(f"__{c}_all") for c in sums)))
    inside = Window.partitionBy(*keys, "__part")
    upto = inside.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = parts.withColumns({f"__{c}_in": F.sum(c).over(inside) for c in sums}).withColumns({c: F.sum(c).over(upto) for c in sums})
    found = found.join(F.broadcast(shared), [*keys, "__part"], "left")
    whole = {f"all_{c}": F.coalesce(f"__{c}_all", f"__{c}_in") for c in sums}
    out = found.withColumns(whole | {c: F.col(c) + F.coalesce(f"__{c}_before", F.lit(0.0)) for c in sums})
    return out.select(*rows.columns, *whole)


def smallest(rows: DataFrame, value: Column | str, k: int) -> float | None:
    """The k-th smallest value (from 1) of one column, null ones left out."""
    value = F.col(value) if isinstance(value, str) else value
    counts = rows.select(F.lit(0).alias("j"), value.alias("v")).where("v IS NOT NULL").groupBy("j", "v").agg(F.count("*").alias("n"))
    return running_counts(counts).where(F.col("upto") >= k).agg(F.min("v")).first()[0]


def quantiles_by(values: DataFrame, qs: list[float]) -> dict:
    """j -> the interpolated quantiles of its values v (null ones are left out), from (j, v) rows."""
    counts = values.where("v IS NOT NULL").groupBy("j", "v").agg(F.count("*").alias("n"))
    upto = settle(running_counts(counts))
    totals = upto.groupBy("j").agg(F.max("upto").alias("total"))
    places = [(F.col("total") - 1) * F.lit(float(q)) for q in qs]

    def reached(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("v")))

    parts = [x for k, p in enumerate(places) for x in (reached(F.floor(p)).alias(f"a{k}"), reached(F.ceil(p)).alias(f"b{k}"), F.first(p - F.floor(p)).alias(f"t{k}"))]
    found = upto.join(F.broadcast(totals), "j").groupBy("j").agg(*parts).collect()
    return {r.j: [r[f"a{k}"] if r[f"t{k}"] == 0 or math.isinf(r[f"a{k}"]) else r[f"a{k}"] + (r[f"b{k}"] - r[f"a{k}"]) * r[f"t{k}"] for k in range(len(qs))] for r in found}


def quantiles(rows: DataFrame, value: Column | str, qs: list[float]) -> list[float | None]:
    """The exact quantiles of one column, interpolated; None where there are no values."""
    value = F.col(value) if isinstance(value, str) else value
    return quantiles_by(rows.select(F.lit(0).alias("j"), value.cast("double").alias("v")), qs).get(0, [None] * len(qs))


def quantile(rows: DataFrame, value: Column | str, q: float) -> float | None:
    return quantiles(rows, value, [q])[0]
