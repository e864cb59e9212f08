"""Suffix-array dedup with sparse suffix arrays: passages of many words that stand at more than one place.

Only suffixes at content-selected positions are kept: the minimisers of ANCHOR-word hashes in windows so wide that any
passage of ``least`` words holds at least one, the same one wherever the passage stands. A suffix's record has
the words to its right and, for the extension to the left, the words before it. The records are range-partitioned and
sorted by anchor and right words; neighbours are compared and matches extended to both sides, then once more in the
order of the words to the left. Each order gives the longest match on its side, so a suffix whose neighbours reach as
far is settled; for the others, the windows between those two bounds are hashed and compared, so no repeat is missed
and none is made up.

Anchors that occur once are dropped first, by a count that is shuffled as hashes alone; equal records of a repeated
anchor are one class before anything is sorted, so copies of a passage never meet in one task. An anchor that reaches
a border of the sorted partitions is compared by the same steps over all its partitions, with the rows at the borders
carried over; so an anchor may have any number of classes.

A place is a row of the table and a position: repeats across documents, inside one document (overlapping ones too)
and between rows that share a doc_id all count. Rows without a doc_id take part and are returned with a null one.
Null texts and texts of fewer than ``least`` words have no passages. Words are compared as they are. doc_id may
have any type that can be grouped; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from oddlens.llm.common import Batches, WordHashes, byte_rows, long, membership_map, settle, slices, windows

ANCHOR = 16  # words of an anchor
SEEN = 200_000  # classes that a task remembers to have sent the words of


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over all runs of ``n``, in about log2(n) passes."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x = pick(x[:-step], x[step:])
        width += step
    return x


def anchors(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the minimisers of a text's words."""
    grams = windows(hashes, ANCHOR)
    span = least - ANCHOR + 1
    if len(grams) < span:
        return np.empty(0, np.int64), grams[:0]
    lowest = _sliding(grams, span, np.minimum)
    padded = np.concatenate([np.zeros(span - 1, np.uint64), lowest, np.zeros(span - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, span, np.maximum) == grams)
    return at, grams[at]


def _anchors(batches: Batches, least: int) -> Batches:
    """The different anchors of some texts, and how often they stand there."""
    cache = WordHashes()
    for batch in slices(batches):
        found = [anchors(cache.of((t or b"").split()), least)[1] for t in byte_rows(batch, "text")]
        grams, counts = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(long(grams)), pa.array(counts)], ["anchor", "n"])


def _key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _records(batches: Batches, least: int, repeated) -> Batches:
    """A row for each place of a repeated anchor; the words around it (those before it from right to left) come with
    the first places that a task sees of a class."""
    cache, reach, seen = WordHashes(), least - ANCHOR, set()
    for batch in slices(batches):
        rows, columns = [], ([], [], [], [], [], [], [], [])
        for row, text in enumerate(byte_rows(batch, "text")):
            hashes = cache.of((text or b"").split())
            at, grams = anchors(hashes, least)
            keep = repeated.value.has(long(grams)) if len(grams) else np.zeros(0, bool)
            words, key = (hashes >> np.uint64(32)).astype(np.uint32), _key(text or b"")
            for p, g in zip(at[keep].tolist(), long(grams)[keep].tolist(), strict=True):
                left, right = words[max(0, p - reach) : p][::-1].tobytes(), words[p : p + least].tobytes()
                context = xxhash.xxh3_64_intdigest(left + right, len(left)) - (1 << 63)
                known = (g, context) in seen
                if not known:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((g, context))
                rows.append(row)
                for c, x in zip(columns, (g, context, key, p, len(left) // 4, len(right) // 4, None if known else left, None if known else right), strict=True):
                    c.append(x)
        parts = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.binary()) for c in columns[6:])]
        yield pa.RecordBatch.from_arrays(parts, ["doc_id", "anchor", "context", "key", "at", "room", "rest", "before", "after"])


class _Classes:
    """Classes (anchor, context, before, after) as matrices, and how far their matches are known to reach."""

    def __init__(self, table: pa.Table, least: int):
        self.least = least
        self.anchor, self.context = (table.column(c).to_numpy() for c in ("anchor", "context"))
        self.bytes = table.column("before").to_pylist(), table.column("after").to_pylist()
        self.before, self.after = (self._matrix(x, n) for x, n in zip(self.bytes, (least - ANCHOR, least), strict=True))
        self.left, self.right, self.lo, self.hi = (np.zeros(len(self.anchor), np.int64) for _ in range(4))

    @staticmethod
    def _matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        padded = np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in rows), np.uint32).reshape(len(rows), width)
        return padded, np.array([len(x) // 4 for x in rows], np.int64)

    def meet(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare the classes i with the classes j, of the same anchors."""
        left, right = (self._common(side, i, j) for side in (self.before, self.after))
        enough = left + right >= self.least
        for k in (i, j):
            np.maximum.at(self.left, k, left)
            np.maximum.at(self.right, k, right)
            np.maximum.at(self.lo, k[enough], left[enough])
            np.maximum.at(self.hi, k[enough], right[enough])

    @staticmethod
    def _common(side: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        words, lengths = side
        same = words[i] == words[j]
        return np.minimum(np.where(same.all(1), words.shape[1], same.argmin(1)), np.minimum(lengths[i], lengths[j]))

    def neighbours(self, order: np.ndarray) -> None:
        i, j = order[:-1], order[1:]
        same = self.anchor[i] == self.anchor[j]
        self.meet(i[same], j[same])

    def windows(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Words before the anchor, and hash, of each window of class i that another may share by the bounds."""
        before, after = (side[0][i, : side[1][i]] for side in (self.before, self.after))
        first, last = self.least - int(self.right[i]), int(self.left[i])
        words = np.concatenate([before[:last][::-1], after[: self.least - first]]).astype(np.uint64)
        return np.arange(last, first - 1, -1), long(windows(words, self.least)[: last - first + 1])

    def table(self, keep: np.ndarray) -> pa.RecordBatch:
        columns = (self.anchor, self.context, self.left, self.right, self.lo, self.hi)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], REACH)


REACH = ["anchor", "context", "left", "right", "lo", "hi"]
REACH_SCHEMA = "anchor long, context long, left long, right long, lo long, hi long"
WORDS = ["before", "after"]


def _settled(classes: _Classes) -> None:
    """Settle what the neighbours left open: equal windows within the bounds, in anchors with an open class."""
    able = classes.left + classes.right >= classes.least
    open_ = able & ((classes.lo < classes.left) | (classes.hi < classes.right))
    some = np.flatnonzero(able & np.isin(classes.anchor, classes.anchor[open_]))
    if not len(some):
        return
    found = [classes.windows(i) for i in some.tolist()]
    row = np.repeat(some, [len(x) for x, _ in found])
    left, key = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    order = np.lexsort((key, left, classes.anchor[row]))
    row, left, key = row[order], left[order], key[order]
    same = (key[1:] == key[:-1]) & (left[1:] == left[:-1]) & (classes.anchor[row[1:]] == classes.anchor[row[:-1]])
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    np.maximum.at(classes.lo, row[shared], left[shared])
    np.maximum.at(classes.hi, row[shared], classes.least - left[shared])


def _anchor_groups(batches: Batches):
    """Tables of whole anchors without repeated classes, and whether they stand at a border of the sorted partition."""
    rest, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*(rest.to_batches() if rest is not None else []), batch]).combine_chunks()
        keys = table.column("anchor").to_numpy()
        start, end = int(np.searchsorted(keys, keys[0], "right")) if first else 0, int(np.searchsorted(keys, keys[-1]))
        if first and end:
            yield _once(table.slice(0, start)), True
            first = False
        if end > start:
            yield _once(table.slice(start, end - start)), False
        rest = table.slice(end)
    if rest is not None:
        yield _once(rest), True


def _once(table: pa.Table) -> pa.Table:
    anchor, context = (table.column(c).to_numpy() for c in ("anchor", "context"))
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])])
    return table.filter(pa.array(new))


def _compared(batches: Batches, least: int) -> Batches:
    """How far the matches of each class reach; of anchors at a border of the partition, the classes with their words."""
    nothing = pa.array([], pa.binary())
    for table, border in _anchor_groups(batches):
        if border:
            zeros = pa.array(np.zeros(table.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("anchor", "context")), *[zeros] * 4, *(table.column(c).combine_chunks() for c in WORDS)], [*REACH, *WORDS])
            continue
        classes = _Classes(table, least)
        rows = np.arange(len(classes.anchor))
        classes.neighbours(rows)
        classes.neighbours(np.array(sorted(rows, key=lambda i: (classes.anchor[i], classes.bytes[0][i])), np.int64))
        _settled(classes)
        found = classes.table(classes.hi > 0)
        yield pa.RecordBatch.from_arrays([*found.columns, *[pa.nulls(found.num_rows, nothing.type)] * 2], [*REACH, *WORDS])


def _chained(batches: Batches, least: int) -> Batches:
    """What neighbours of a sorted partition share; its first and last row come with their words, to be carried over."""
    last, part = None, TaskContext.get().partitionId()

    def edge(row: pa.Table, end: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(row.column(c).combine_chunks() for c in ("anchor", "context")), *[pa.array([0], pa.int64())] * 4, *(row.column(c).combine_chunks() for c in WORDS), pa.array([2 * part + end], pa.int64())], [*REACH, *WORDS, "place"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).select(["anchor", "context", *WORDS])
        if last is None:
            yield edge(rows.slice(0, 1), 0)
        rows = rows if last is None else pa.concat_tables([last, rows])
        classes = _Classes(rows, least)
        classes.neighbours(np.arange(len(classes.anchor)))
        found = classes.table(classes.left + classes.right > 0)
        yield pa.RecordBatch.from_arrays([*found.columns, *[pa.nulls(found.num_rows, pa.binary())] * 2, pa.nulls(found.num_rows, pa.int64())], [*REACH, *WORDS, "place"])
        last = rows.slice(rows.num_rows - 1)
    if last is not None:
        yield edge(last, 1)


def _window_keys(batches: Batches, least: int) -> Batches:
    for batch in batches:
        classes = _Classes(pa.Table.from_batches([batch]), least)
        classes.left, classes.right = (batch.column(c).to_numpy() for c in ("left", "right"))
        found = [classes.windows(i) for i in range(batch.num_rows)]
        row = np.repeat(np.arange(batch.num_rows), [len(x) for x, _ in found])
        left, key = (np.concatenate([*(x[k] for x in found), np.empty(0, np.int64)]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (classes.anchor[row], classes.context[row], left, key)], ["anchor", "context", "before", "window"])


def _over_partitions(rows: DataFrame, least: int) -> DataFrame:
    """The same comparison for the anchors at borders: both orders over all partitions, then the open windows."""
    schema = REACH_SCHEMA + ", before binary, after binary, place long"
    found = []
    for side in ("after", "before"):
        order = rows.repartitionByRange("anchor", side).sortWithinPartitions("anchor", side)
        chained = settle(order.mapInArrow(partial(_chained, least=least), schema))
        # Two rows of each partition: as many as there are tasks, so one task may hold them.
        edges = chained.where("place IS NOT NULL").select("anchor", "context", *WORDS, "place").coalesce(1).sortWithinPartitions("place")
        found += [part.select(*REACH) for part in (chained.where("place IS NULL"), edges.mapInArrow(partial(_chained, least=least), schema).where("place IS NULL"))]
    reach = found[0].union(found[1]).union(found[2]).union(found[3]).groupBy("anchor", "context").agg(*(F.max(c).alias(c) for c in REACH[2:]))
    reach = settle(reach.where(F.col("left") + F.col("right") >= least))
    open_ = reach.where("lo < left OR hi < right").select("anchor").distinct()
    able = rows.join(reach.join(open_, "anchor"), ["anchor", "context"])
    keys = settle(able.mapInArrow(partial(_window_keys, least=least), "anchor long, context long, before long, window long"))
    shared = keys.groupBy("anchor", "before", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    more = keys.join(shared, ["anchor", "before", "window"]).groupBy("anchor", "context").agg(F.max("before").alias("lo"), (F.lit(least) - F.min("before")).alias("hi"))
    return reach.where("hi > 0").select("anchor", "context", "lo", "hi").union(more)


def _joined(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): spans that touch or overlap made one."""
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", (F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int")).withColumn("part", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _passages(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, key, start, end) of each passage; the key stands for the text."""
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    counts = texts.select("text").mapInArrow(partial(_anchors, least=least), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = settle(counts.where("n > 1").select("anchor"))
    sent = docs.sparkSession.sparkContext.broadcast(membership_map(repeated))
    schema = f"doc_id {_id_type(docs)}, anchor long, context long, key long, at long, room long, rest long, before binary, after binary"
    records = settle(texts.mapInArrow(partial(_records, least=least, repeated=sent), schema))
    places = settle(records.groupBy("anchor", "context").agg(F.count("*").alias("places")))
    shared = places.where("places > 1").select("anchor", "context", F.lit(least - ANCHOR).cast("long").alias("lo"), F.lit(least).cast("long").alias("hi"))
    several = places.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1").select("anchor")
    rows = records.where("after IS NOT NULL").select("anchor", "context", *WORDS).join(several, "anchor")
    order = rows.repartitionByRange("anchor", "after").sortWithinPartitions("anchor", "after", "before")
    compared = settle(order.mapInArrow(partial(_compared, least=least), REACH_SCHEMA + ", before binary, after binary"))
    matched = compared.where("after IS NULL").select("anchor", "context", "lo", "hi")
    border = _over_partitions(compared.where("after IS NOT NULL").select("anchor", "context", *WORDS), least)
    reach = settle(shared.union(matched).union(border).groupBy("anchor", "context").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")))
    spans = records.drop(*WORDS).join(reach, ["anchor", "context"])
    spans = spans.select("doc_id", "key", (F.col("at") - F.least("lo", "room")).alias("start"), (F.col("at") + F.least("hi", "rest")).alias("end")).distinct()
    return _joined(spans, ["doc_id", "key"])


def _listed(passages: DataFrame) -> tuple[Column, Column]:
    return F.sum(F.col("end") - F.col("start")), F.sort_array(F.collect_list(F.struct("start", "end")))


def repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_words_repeated, passages (array of start, end: words, end exclusive) of each text with a repeated passage.

    A passage has at least ``least`` words that stand at some other place of ``docs`` (doc_id, text) too; passages that
    touch or overlap are joined. Equal texts of one doc_id give one row, different texts of it a row each.
    """
    passages = _passages(docs, least)
    words, found = _listed(passages)
    return passages.groupBy("doc_id", "key").agg(words.alias("n_words_repeated"), found.alias("passages")).drop("key")


def _keyed(batches: Batches) -> Batches:
    for batch in slices(batches):
        keys = [None if t is None else _key(t) for t in byte_rows(batch, "text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, KEY])


def _windows_of(batches: Batches, least: int) -> Batches:
    """The places of all windows inside the passages of each text."""
    cache = WordHashes()
    for batch in slices(batches):
        rows, found, at = [], [], []
        for row, (text, spans) in enumerate(zip(byte_rows(batch, "text"), batch.column("passages").to_pylist(), strict=True)):
            hashes = windows(cache.of(text.split()), least)
            places = np.concatenate([np.arange(x["start"], x["end"] - least + 1) for x in spans])
            rows.append(np.full(len(places), row))
            found.append(hashes[places])
            at.append(places)
        row = pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64))
        window, place = np.concatenate([*found, np.empty(0, np.uint64)]), np.concatenate([*at, np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("key").take(row), pa.array(long(window)), pa.array(place.astype(np.int64))], ["doc_id", "key", "window", "at"])


def _cut(text: str, gone: list[dict], kept: list[dict]) -> str:
    """The text without the words of the spans ``gone`` that aren't in ``kept`` too, and without the blanks after them."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    drop = np.zeros(len(words), bool)
    for spans, value in ((gone, True), (kept, False)):
        for x in spans:
            drop[x["start"] : x["end"]] = value
    starts = [a for a, _ in words] + [len(text)]
    return text[: starts[0]] + "".join(text[starts[i] : starts[i + 1]] for i in range(len(words)) if not drop[i])


def _cut_all(batches: Batches, names: list[str]) -> Batches:
    for batch in slices(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in ("text", GONE, KEPT)), strict=True)
        texts = pa.array([t if gone is None else _cut(t, gone, kept or []) for t, gone, kept in rows], pa.string())
        yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names)


KEY, GONE, KEPT = "__key_of_text", "__gone_of_text", "__kept_of_text"


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """``docs`` with every repeated passage left at one place, the first by doc_id (null first), text hash and position.

    All rows and columns stay; a text may become empty. Equal texts of one doc_id count as one place, so both keep
    what is first there. doc_id must have an order.
    """
    passages = settle(_passages(docs, least))
    listed = passages.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("passages"))
    keyed = docs.mapInArrow(_keyed, StructType([*docs.schema.fields, StructField(KEY, LongType())]))

    def of_text(rows: DataFrame) -> Column:
        return keyed["doc_id"].eqNullSafe(rows["doc_id"]) & (keyed[KEY] == rows["key"])

    held = keyed.join(listed, of_text(listed)).select(listed["doc_id"], listed["key"], keyed["text"], listed["passages"]).dropDuplicates(["doc_id", "key"])
    spots = settle(held.mapInArrow(partial(_windows_of, least=least), f"doc_id {_id_type(docs)}, key long, window long, at long"))
    place = F.struct("doc_id", "key", "at")
    first = spots.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places")
    told = settle(spots.join(first, "window").select("doc_id", "key", F.col("at").alias("start"), (F.col("at") + least).alias("end"), (place == F.col("first")).alias("kept")))
    sides = [_joined(told.where("kept" if kept else "NOT kept"), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("kept" if kept else "gone")) for kept in (False, True)]
    cuts = sides[0].join(sides[1].withColumnRenamed("doc_id", "d").withColumnRenamed("key", "k"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "key", F.col("gone").alias(GONE), F.col("kept").alias(KEPT))
    out = keyed.join(cuts, of_text(cuts), "left").select(*(keyed[c] for c in docs.columns), GONE, KEPT)
    return out.mapInArrow(partial(_cut_all, names=docs.columns), docs.schema)
