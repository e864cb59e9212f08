"""The pipeline over ``documents``: five stages, each over all that the one before kept, written as Parquet between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddlens.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from oddlens.llm.common import apart, settle, table
from oddlens.llm.quality_rules import words

DUE, RANK = "__due", "__rank"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go. It learns from the labelled rows among ``docs``."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest doc_id stays."""
    return ngram_join.keep_one(docs, n=5, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One and a half times the words: every document once, and a second time as its source's weight asks.

    The filters have passed every document by now, so the mix repeats documents but leaves none out.
    """
    mixed = settle(mixing.mix(docs, weights=(3, 1, 2), budget=1.5, least=1, most=2))
    is_due = F.coalesce(F.col("taken") > F.col("size"), F.lit(False))
    # Most documents' repeats follow from a broadcast bitmap of their ids and sources; only what two bitmaps leave open is joined.
    maybe, _ = apart(docs, mixed.where(is_due), "doc_id", "source")
    unsure, due = apart(maybe, mixed.where(~is_due), "doc_id", "source")
    return docs.union(due).union(_due(unsure, mixed.withColumn("due", is_due.cast("long"))))


def _due(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix repeats: of rows that share doc_id and source, as many as are due."""
    by_key = settle(mixed.groupBy("doc_id", "source").agg(F.sum("due").alias("due"), F.count("*").alias("n")).where("due > 0"))
    out = docs.join(full := by_key.where("due = n"), _same(docs, full), "left_semi")
    some = by_key.where("due < n")
    if some.isEmpty():
        return out
    # Not all of these rows are due: of those of one size, as many as are.
    sizes = settle(mixed.join(some, _same(mixed, some), "left_semi").groupBy("doc_id", "source", "size").agg(F.sum("due").alias("due")).where("due > 0"))
    rows = docs.join(sizes, _same(docs, sizes) & (F.size(words(F.coalesce(docs["text"], F.lit("")))) == sizes["size"]))
    rank = F.row_number().over(Window.partitionBy(docs["doc_id"], docs["source"], sizes["size"]).orderBy(F.xxhash64(docs["text"])))
    rows = rows.select(*(docs[c] for c in docs.columns), sizes["due"].alias(DUE), rank.alias(RANK))
    return out.union(rows.where(F.col(RANK) <= F.col(DUE)).select(docs.columns))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["source"].eqNullSafe(b["source"])


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """40 shards, balanced by bytes, tokens and rows: doc_id, size, text_crc32, shard, slot of each row."""
    return sharding.shard(docs, shards=40)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: Learned scores and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
