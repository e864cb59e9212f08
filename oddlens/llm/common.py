"""What the text operators share: words, 64-bit hashes, tables settled in the shared folder, connected components.

Words are maximal runs without space, tab, line feed, vertical tab, form feed or carriage return;
``bytes.split`` and ``bytes.lower`` have exactly these rules (ASCII only), so texts are worked on as UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlens.operators import components
from oddlens.sources.scratch import discard, settle, shared_dir

__all__ = ["discard", "settle", "shared_dir"]

WORD = r"[^\x20\x09-\x0D]+"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets everything at ``most`` entries, so its memory is bounded."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; empty where there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * _GOLDEN + hashes[i : i + len(out)]
    return mix64(out)


def long(x: np.ndarray) -> np.ndarray:
    """Unsigned as Spark's signed longs, bit for bit."""
    return x.view(np.int64)


def byte_rows(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def bounded_batches(spark: SparkSession, rows: int = 1000, most: str = "16m") -> None:
    """Lower the session's limits of the batches that go to Python: whole texts and sets make rows of many kilobytes."""
    for key, value, size in (("maxRecordsPerBatch", rows, int), ("maxBytesPerBatch", most, str)):
        key = f"spark.sql.execution.arrow.{key}"
        if size is str or int(spark.conf.get(key)) > value:
            spark.conf.set(key, value)


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``most`` bytes, so what is made of a run stays small however large a batch is."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def list_array(parts: list[np.ndarray], kind: pa.DataType = None) -> pa.Array:
    """A list column from one numpy array for each row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind or pa.int64()))


Batches = Iterator[pa.RecordBatch]

MAP_BITS = 27  # log2 of the bits of a membership map, at most: 16 MB, whatever it stands for


class MembershipMap:
    """A bit for each hashed key: says no only for keys that aren't in it. Its size is bounded, not its keys."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def place(keys: np.ndarray, bits: int) -> np.ndarray:
        return (mix64(keys.astype(np.int64).view(np.uint64) + _GOLDEN) >> np.uint64(64 - bits)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys, self.bits)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _marked(batches: Batches, bits: int) -> Batches:
    for batch in batches:
        at = np.unique(MembershipMap.place(batch.column(0).to_numpy(), bits))
        words, start = np.unique(at >> 6, return_index=True)
        if len(words):
            marks = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(long(marks))], ["word", "mark"])


CHUNK = 1 << 12  # 64-bit words of a map that travel as one value


def _chunked(batches: Batches) -> Batches:
    """The map's words (word, mark), sorted, as binary chunks."""
    at, words = None, None
    for batch in batches:
        word, mark = (batch.column(c).to_numpy() for c in ("word", "mark"))
        chunk = word // CHUNK
        for k in np.unique(chunk):
            if k != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([words.tobytes()])], ["chunk", "words"])
                at, words = k, np.zeros(CHUNK, np.uint64)
            words[word[chunk == k] % CHUNK] = mark[chunk == k].view(np.uint64)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([words.tobytes()])], ["chunk", "words"])


def membership_map(keys: DataFrame) -> MembershipMap:
    """Of the longs in the only column of ``keys``, a settled table without nulls. The driver gets it in a few hundred chunks."""
    bits = min(MAP_BITS, max(12, (16 * keys.count()).bit_length()))
    marks = keys.mapInArrow(partial(_marked, bits=bits), "word long, mark long").groupBy("word").agg(F.bit_or("mark").alias("mark"))
    dealt = marks.repartition(F.floor(F.col("word") / CHUNK)).sortWithinPartitions("word")
    words = np.zeros(max(CHUNK, 1 << (bits - 6)), np.uint64)
    for r in dealt.mapInArrow(_chunked, "chunk long, words binary").toLocalIterator():
        words[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.words, np.uint64)
    return MembershipMap(words, bits)


LEAST_BITS, MOST_BITS = 15, 28
BUCKET = 1 << 15  # bits of one value of bitmap_construct_agg


def bitmap_of(keys: DataFrame) -> tuple[DataFrame, int]:
    """The bitmap (bucket, bitmap) of the hashes in the only column of ``keys``, a settled table, and its number of bits.

    16 bits a key, so about one in 16 other keys finds its bit set, and ``MOST_BITS`` at most (32 MB). Built and read by
    SQL functions only.
    """
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    at = F.pmod(keys[0], F.lit(bits)) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bitmap")), bits


def marked(rows: DataFrame, key: str, found: tuple[DataFrame, int], name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether the bit of the hash in ``key`` is set. ``key`` is dropped."""
    bitmaps, bits = found
    rows = rows.withColumn("__bit", F.pmod(F.col(key), F.lit(bits))).join(F.broadcast(bitmaps.withColumnRenamed("bucket", "__bucket")), F.expr(f"__bit div {BUCKET} + 1 = __bucket"), "left")
    octet = f"cast(conv(hex(substring(__bitmap, cast(__bit % {BUCKET} div 8 + 1 as int), 1)), 16, 10) as int)"
    is_set = F.expr(f"coalesce((shiftright({octet}, cast(__bit % 8 as int)) & 1) = 1, false)")
    return rows.withColumn(name, is_set).drop("__bit", "__bucket", "__bitmap", key)


def apart(rows: DataFrame, keys: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose columns ``by`` may be among ``keys`` (a settled table), and those where they surely aren't.

    Both parts are scans of ``rows`` and leave out none. So only the first part, with what it carries, has to be shuffled to be joined to ``keys``.
    """
    alike = F.xxhash64(*(F.col(c).cast(keys.schema[c].dataType) for c in by))  # a hash depends on the type
    flagged = marked(rows.withColumn("__key", alike), "__key", bitmap_of(settle(keys.select(F.xxhash64(*by).alias("key")))), "__there")
    return flagged.where("__there").drop("__there"), flagged.where("NOT __there").drop("__there")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph of ``edges`` (a, b, taken as longs), a settled table; see ``operators.components``."""
    return components.connected_components(edges.select(F.col("a").cast("long"), F.col("b").cast("long")))
