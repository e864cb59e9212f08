"""Exact deduplication by progressive refinement: length, then a hash of the first bytes, then a hash of everything.

1. One scan measures each row: bytes of the text and a hash of its first ``PREFIX`` bytes. What is written is 24 bytes a row.
2. Lengths that occur twice go on; among their rows, pairs of length and prefix hash that occur twice go on.
3. A second scan hashes whole texts, only where length and prefix hash survived; groups are rows of equal length and
   SHA-256. All other rows are alone.

Everything is a DataFrame expression. Texts are never shuffled: survivors are told to the second scan by a bitmap of
their hashes (``common.bitmap_of``) that is broadcast and has a bounded size. A bit can also be set for another key;
such a row's text is hashed for nothing and its group has one member, so results don't depend on the map. Beyond some
16 million surviving keys it fills up, and the more of it is full the more texts are hashed that needn't be, at worst all.

Null text counts as empty. Of equal texts the row with the largest doc_id stays, a null doc_id being smallest; where
several rows share text and doc_id, exactly one of them stays. ``keep_id`` is null where all ids of a group are. Rows
that repeat a doc_id are rows of their own. Other columns are ignored unless carried. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import bitmap_of, discard, marked, settle

PREFIX = 64


def _same(text: Column) -> Column:
    return text


def groups(docs: DataFrame, normalise: Callable[[Column], Column] = _same, carry: Mapping[str, Column] | None = None, prefix: int = PREFIX) -> DataFrame:
    """One row per document: doc_id, n_bytes, keep_id, group_size, kept, then the columns in ``carry``.

    ``normalise`` says which texts are equal; ``carry`` has columns of ``docs`` to keep, or expressions over them, by name.
    """
    carry = dict(carry or {})
    docs = docs.withColumn("__text", normalise(F.coalesce(docs["text"], F.lit(""))))
    length, start = F.octet_length("__text"), F.xxhash64(F.octet_length("__text"), F.substring(F.col("__text").cast("binary"), 1, prefix))
    measured = settle(docs.select(length.alias("n_bytes"), start.alias("start")))
    lengths = settle(measured.groupBy("n_bytes").count().where("count > 1").select(F.xxhash64("n_bytes").alias("key")))
    long_enough = marked(measured.withColumn("key", F.xxhash64("n_bytes")), "key", bitmap_of(lengths), "again").where("again")
    starts = settle(long_enough.groupBy("n_bytes", "start").count().where("count > 1").select(F.col("start").alias("key")))
    rows = marked(docs.withColumn("__key", start), "__key", bitmap_of(starts), "__again")
    rows = settle(rows.select("doc_id", length.alias("n_bytes"), F.when(F.col("__again"), F.unhex(F.sha2("__text", 256))).alias("full"), F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in carry.items())))
    discard(measured, lengths, starts)
    first = F.max(F.struct("doc_id", "row"))  # nulls are smallest in a struct's order
    shared = rows.where("full is not null").groupBy("n_bytes", "full").agg(F.count("*").alias("group_size"), first.alias("first")).where("group_size > 1")
    shared = settle(shared).select(F.col("n_bytes").alias("__n"), F.col("full").alias("__full"), "group_size", "first")
    # Settled, so that AQE splits the rows of a hot text in this join instead of finding them beside an aggregate.
    found = rows.join(shared, (rows["n_bytes"] == shared["__n"]) & (rows["full"] == shared["__full"]), "left")
    alone = F.col("first").isNull()
    return found.select(
        "doc_id", "n_bytes", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"), *carry,
    )
