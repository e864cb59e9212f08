"""Expressions on feature vectors (``array<double>``) and the long form (id, j, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(*columns: str) -> Column:
    return F.array(*(F.col(c).cast("double") for c in columns)).alias("features")


def features(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(id, features) from a key and numeric columns, or from one array column."""
    if len(columns) == 1 and df.schema[columns[0]].dataType.typeName() == "array":
        return df.select(F.col(key).alias("id"), F.col(columns[0]).cast("array<double>").alias("features"))
    return df.select(F.col(key).alias("id"), pack(*columns))


def melt(df: DataFrame) -> DataFrame:
    """(id, j, v) of (id, features)."""
    return df.select("id", F.posexplode("features").alias("j", "v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """Scaled to length 1; the length is floored at eps. It is the one element of an array, so that a row works it out once, not once for each feature."""
    length = F.array(F.greatest(norm(a), F.lit(eps)))
    return F.get(F.transform(length, lambda n: F.transform(a, lambda x: x / n)), F.lit(0))


def row_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of matching vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def signed_power(a: Column, power: float) -> Column:
    return F.transform(a, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(power)))


def constants(values) -> Column:
    """An array column of numbers known at plan time, one for each feature."""
    return F.array(*(F.lit(float(x)) for x in values))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
