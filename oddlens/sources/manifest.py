"""Dataset manifests: records image_path, category, split, label, mask_path, group_id (and a meta map when read from JSON lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "image_path string, category string, split string, label int, mask_path string, group_id string, meta map<string,string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines and lines that start with # are skipped. Records that break a rule raise when read.

    Rules: image_path and category are there; split is train, val or test; label is 0 or 1; a test record has a
    label; train and val records aren't anomalous.
    """
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    rows = lines.select(F.from_json("value", SCHEMA).alias("r")).select("r.*")
    wrong = rows.withColumn("wrong", problem())
    return wrong.select(*rows.columns, F.when(F.col("wrong").isNotNull(), F.raise_error(F.col("wrong"))).alias("wrong")).where("wrong IS NULL").drop("wrong")


def problem():
    """What is wrong with a record; null if nothing is."""
    return (
        F.when(F.col("image_path").isNull() | (F.col("image_path") == ""), "image_path is missing")
        .when(F.col("category").isNull() | (F.col("category") == ""), "category is missing")
        .when(~F.col("split").isin("train", "val", "test"), "unknown split")
        .when(~F.col("label").isin(0, 1), "label must be 0 or 1")
        .when((F.col("split") == "test") & F.col("label").isNull(), "a test record needs a label")
        .when(F.col("split").isin("train", "val") & (F.col("label") == 1), "a train or val record can't be anomalous")
    )


def validate(rows: DataFrame) -> DataFrame:
    return rows.withColumn("problem", problem()).where("problem IS NOT NULL")


def stats(rows: DataFrame) -> DataFrame:
    """(field, value, n) of category, split, label and mask in one pass."""
    fields = {"category": "category", "split": "split", "label": F.col("label").cast("string"), "mask": F.when(F.col("mask_path").isNotNull(), "present")}
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit("missing")).alias("value")) for k, v in fields.items()))
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def select(rows: DataFrame, categories=None, splits=None, labels=None, has_mask: bool | None = None, path_contains: str | None = None) -> DataFrame:
    for name, wanted in (("category", categories), ("split", splits), ("label", labels)):
        if wanted is not None:
            rows = rows.where(F.col(name).isin(list(wanted)))
    if has_mask is not None:
        rows = rows.where(F.col("mask_path").isNotNull() == has_mask)
    return rows if path_contains is None else rows.where(F.contains("image_path", F.lit(path_contains)))


def follow_groups(rows: DataFrame, default: str = "train") -> DataFrame:
    """assigned_split: a record's own, else the one its group has in its category (the first by name), else ``default``."""
    lead = rows.where("split IS NOT NULL AND group_id IS NOT NULL").groupBy("category", "group_id").agg(F.min("split").alias("lead"))
    return rows.join(lead, ["category", "group_id"], "left").withColumn("assigned_split", F.coalesce("split", "lead", F.lit(default))).drop("lead")


def benchmark_split(rows: DataFrame, test_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """assigned_split of every record, by group: explicit splits first, then what the group has, then a seeded draw.

    A group with an anomalous record and no split of its own goes to test whole, as a record without a group does by
    itself; of the normal groups about ``test_fraction`` go to test, by a hash of seed, category and group. A group whose
    records name different splits raises.
    """
    key = F.coalesce(F.concat(F.lit("g:"), "group_id"), F.concat(F.lit("p:"), "image_path"))
    keyed = rows.withColumn("__key", key)
    facts = keyed.groupBy("category", "__key").agg(F.min("split").alias("__first"), F.max("split").alias("__last"), F.max("label").alias("__worst"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "category", "__key"), F.lit(1_000_000)) < int(test_fraction * 1_000_000)
    chosen = F.when(F.col("__first") != F.col("__last"), F.raise_error(F.concat(F.lit("a group names several splits: "), "__key"))).when(F.col("__first").isNotNull(), F.col("__first"))
    chosen = chosen.when(F.col("__worst") == 1, "test").when(draw, "test").otherwise("train")
    out = keyed.join(facts, ["category", "__key"]).withColumn("assigned_split", chosen)
    return out.select(*rows.columns, "assigned_split")


def profile(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_anomalous"), F.count_if(F.col("label") == 0).alias("n_normal"), F.count("mask_path").alias("n_masks"), F.count_distinct("group_id").alias("n_groups"))


def from_folders(spark: SparkSession, root: str, category: str) -> DataFrame:
    """A manifest from a folder layout <root>/<split>/<good or a defect's name>/file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    split, kind = F.get(parts, F.size(parts) - 3), F.get(parts, F.size(parts) - 2)
    return files.select(F.col("path").alias("image_path"), F.lit(category).alias("category"), split.alias("split"), F.when(split == "test", (kind != "good").cast("int")).otherwise(F.lit(0)).alias("label"), F.lit(None).cast("string").alias("mask_path"), F.lit(None).cast("string").alias("group_id"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
