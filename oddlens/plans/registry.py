"""All registered queries outside the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddlens.plans import detectors, pixels, relational

_PARTS = (detectors, relational, pixels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.ecod_report(spark, sf_dir)
