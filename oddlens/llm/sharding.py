"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Items are placed from the largest down, each in the shard where the dot product of its vector with the residual
capacity is highest. An item is a group of equal texts; groups above a part of a shard's bytes are dealt out to
pieces row by row, and groups below the mean size of a bundle are bundled by a hash of the text. So at most
BUNDLES groups stand for themselves beside BUNDLES bundles and some PIECES for each shard, whatever the input: the packing sees
only their sums. A document's shard follows from its
item by a join, its slot from the item's first slot and a rank inside the item, so no task holds a shard.

Null text has no bytes and no tokens and forms a group of its own. Rows that repeat a doc_id are rows of their
own. Order inside an item is by doc_id, nulls first. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddlens.llm.common import Batches, byte_rows, settle

BUNDLES = 1 << 15
PIECES = 64  # a piece of a split group has at most about this part of a shard's bytes
ROW_BYTES = 16


def _measure(batches: Batches) -> Batches:
    for batch in batches:
        texts = byte_rows(batch, "text")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t or b"") + ROW_BYTES for t in texts], pa.int64()),
                pa.array([len((t or b"").split()) for t in texts], pa.int64()),
                pa.array([None if t is None else zlib.crc32(t) for t in texts], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(b"null" if t is None else b"t" + t) for t in texts], pa.binary()),
            ],
            ["doc_id", "size", "tokens", "text_crc32", "digest"],
        )


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of ``vectors``: bytes, tokens, rows), the largest first, by the dot product."""
    total = vectors.sum(0)
    parts = vectors / np.where(total > 0, total, 1) * shards
    residual = np.full((shards, vectors.shape[1]), 1.0) * (total > 0)
    where = np.zeros(len(vectors), np.int64)
    for i in np.lexsort([np.arange(len(parts)), -parts.max(1)]):
        # Capacity is shared by all dimensions, so a shard that is full in one has a negative residual there.
        where[i] = k = int(np.argmax(residual @ parts[i]))
        residual[k] -= parts[i]
    return where


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs`` (doc_id, text).

    size: UTF-8 bytes of the text and 16; text_crc32: of these bytes, null for null; slot: from 0 without a gap in
    each shard. Sizes of shards come near equal; tokens and rows are balanced besides. The same files give the same
    shards. Equal texts stay in one shard unless their group is over 1/PIECES of a shard.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, tokens long, text_crc32 long, digest binary")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit, alone = max(1, total // (shards * PIECES)), total // BUNDLES
    groups = rows.groupBy("digest").agg(*sums)
    large = settle(groups.where(F.col("size") > min(limit, alone)).select("digest", F.ceil(F.col("size") / limit).alias("pieces")))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("string")
    piece = F.concat(F.hex("digest"), F.lit("/"), F.pmod(F.xxhash64("doc_id") + F.col("row"), "pieces").cast("string"))
    items = rows.join(F.broadcast(large), "digest", "left").withColumn("item", F.when(F.col("pieces").isNull(), bundle).otherwise(piece))
    # At most BUNDLES or shards * PIECES groups are large, so the broadcast and the items below are bounded.
    found = items.groupBy("item").agg(*sums).toPandas().sort_values("item").reset_index(drop=True)
    found["shard"] = pack(found[["size", "tokens", "rows"]].to_numpy(float), shards)
    found["start"] = found.groupby("shard")["rows"].cumsum() - found["rows"]
    placed = spark.createDataFrame(found[["item", "shard", "start"]], "item string, shard int, start long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("doc_id", "digest"))
    return items.join(F.broadcast(placed), "item").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + rank - 1).cast("long").alias("slot"))
