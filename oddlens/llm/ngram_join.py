"""N-gram Jaccard join: which texts share at least a given part of their word n-grams, and their components.

Method (set-relation skipping):

* *index level* - every set is ordered by one global order (rare n-grams first, known frequent ones last) and only
  its prefix is indexed. A list belongs to an n-gram and a class of sizes; a set stands in the class of its own size
  and of its largest possible partner. Within a list, entries are skipped by size and by position: two sets whose first
  common n-gram stands at positions i and j differ in at least i + j elements. Long lists are sorted by position and
  cut into blocks, and a pair of blocks is left out whole by its least positions and by its range of sizes. A 512-bit
  parity map, and for long texts 256 counts by hash bucket, bound the symmetric difference from below and drop most
  other pairs exactly. What is left of a list is passed on as a few edges that connect its possible partners, not as pairs.
* *answer level* - sets of a group of possible partners are compared with pivots first. With the sizes of the
  symmetric differences d(x, p) and d(p, z) known, d(x, z) lies between their difference and their sum, so a set near
  a pivot takes over most of the pivot's answers and few pairs are intersected. Where only components are asked
  for, a group too large for a task first meets ROUNDS pivots by a join; the sets that these connect need no comparison
  with one another, so only the rest of the group meets it, in pairs of blocks.

No pair is lost: lists and groups of more than BLOCK sets, or of more than GRAMS elements, are dealt out as pairs of
blocks, every pair of sets that is still open meeting in one of them. Equal sets are one class from the start, known
by a 64-bit hash of the set, so copies never meet as pairs and texts that share a doc_id stay apart. Which n-grams
count as frequent only moves them in the order; any order gives the same result.

Rows without words (or null text) are linked with nothing. A repeated doc_id is placed by each row's own text.
Rows whose doc_id is null get the component of an equal text that has one, else null. doc_id must be a whole number
(any integer type, or text that casts to a long).
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from oddlens.llm.common import Batches, WordHashes, apart, bounded_batches, byte_rows, connected_components, discard, list_array, long, membership_map, mix64, settle, slices, windows

MAPS = 8  # 64-bit words of a parity map
MAP_NAMES = [f"m{k}" for k in range(MAPS)]
BLOCK = 2048  # sets of a list or group that meet in one task: at most about twice as many
GRAMS = 2_000_000  # their elements: as well
STEPS = 32  # entries of lists that are compared in one sweep; longer lists go by blocks
SENT = 4_000_000  # elements, or rows, up to which a small side is broadcast; it is shuffled beyond
PIVOTS = 16  # sets of a block whose distances from the others are remembered
ROUNDS = 3  # pivots that a group larger than a block meets first
LONG = 700  # elements from which a set also has counts: there the parity map no longer tells sets apart
TAG = "__class_of_text"
FREQUENT = 50_000  # n-grams known as frequent, at most: a bound for the broadcast, not for the result


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word runs; of the whole sequence if it is shorter; none without words."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(n, len(hashes))) ^ np.uint64(0 if len(hashes) >= n else len(hashes)))


def _sets(batches: Batches, n: int):
    cache = WordHashes()
    for batch in slices(batches):
        yield batch, [shingles(cache.of((t or b"").lower().split()), n) for t in byte_rows(batch, "text")]


def _class_of(s: np.ndarray) -> int:
    """The class of a set, as a signed long."""
    return int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "big", signed=True)


def _frequent(batches: Batches, n: int) -> Batches:
    """N-grams found in at least 8 documents and one in 500 of some thousand rows."""
    kept: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate([*kept, np.empty(0, np.uint64)]), return_counts=True)
        keep = counts >= max(8, len(kept) // 500)
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(long(grams[keep])), pa.array(counts[keep])], ["gram", "n"])

    for _, sets in _sets(batches, n):
        kept += sets
        if sum(map(len, kept)) > 2_000_000:
            yield counted()
    yield counted()


def _most_different(total, threshold: int):
    """The largest symmetric difference of two linked sets with ``total`` elements together."""
    return total - 2 * -(-threshold * total // (100 + threshold))


def _size_classes(n: int, threshold: int) -> list[int]:
    """The classes in whose lists a set of ``n`` elements stands: its own, and that of the largest set it may be linked with.

    A class spans four times the ratio that linked sets may have, so there are one or two; it never falls with ``n``.
    """
    width = 4 * math.log(100 / threshold) + 0.01
    return sorted({math.floor(math.log(m) / width) for m in (n, 100 * n // threshold)})


def _describe(batches: Batches, n: int, threshold: int, frequent) -> Batches:
    grams, rank = frequent.value
    for batch, sets in _sets(batches, n):
        classes_of, prefixes, spread, counts, maps = [], [], [], [], np.zeros((len(sets), MAPS), np.uint64)
        for i, s in enumerate(sets):
            classes_of.append(_class_of(s))
            at = np.minimum(np.searchsorted(grams, s), max(0, len(grams) - 1))
            late = np.where(grams[at] == s, rank[at], 0) if len(grams) else np.zeros(len(s), np.int64)
            ordered = s[np.argsort(late, kind="stable")] if late.any() else s
            prefix = ordered[: len(s) - -(-threshold * len(s) // 100) + 1 if len(s) else 0]
            classes = _size_classes(len(s), threshold) if len(s) else [0]
            prefixes.append(long(np.concatenate([mix64(prefix + np.uint64(c + 1)) for c in classes])))
            spread.append(len(classes))
            per_bit = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * MAPS), minlength=64 * MAPS)
            maps[i] = np.packbits((per_bit & 1).astype(np.uint8)).view(np.uint64)
            counts.append(np.minimum(per_bit.reshape(-1, 2).sum(1), 255).astype(np.uint8).tobytes() if len(s) >= LONG else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes_of, pa.int64()), list_array(prefixes), pa.array(spread, pa.int32()), pa.array(counts, pa.binary()), *(pa.array(long(maps[:, k].copy())) for k in range(MAPS))],
            ["doc_id", "n", "id", "prefix", "spread", "counts", *(f"m{k}" for k in range(MAPS))],
        )


def _only_sets(batches: Batches, n: int, wanted) -> Batches:
    batches = (b.filter(pa.array(wanted.value.has(b.column("doc_id").to_numpy()))) for b in batches)
    for batch, sets in _sets(batches, n):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(_class_of, sets), pa.int64()), list_array([np.sort(long(s)) for s in sets])], ["doc_id", "id", "grams"])


def _tagged(batches: Batches, n: int, wanted) -> Batches:
    """Rows with the class of their set, where a membership map has the doc_id; null elsewhere."""
    cache = WordHashes()
    for batch in slices(batches):
        ids = batch.column("doc_id").cast(pa.int64())
        there = wanted.value.has(ids.fill_null(0).to_numpy())
        texts = batch.column("text").filter(pa.array(there)).cast(pa.binary()).to_pylist()
        tags = np.zeros(batch.num_rows, np.int64)
        tags[there] = [_class_of(shingles(cache.of((t or b"").lower().split()), n)) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, mask=~there)], [*batch.schema.names, TAG])


def _in_blocks(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows with the ``group`` in which they meet those of the same ``key``: pairs of blocks where ``blocks`` is over 1."""
    own = F.pmod(F.xxhash64("id"), blocks)
    pairs = df.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    group = F.xxhash64(key, F.least("own", "with"), F.greatest("own", "with"))
    return pairs.withColumn("group", group).drop("own", "with")


def _dealt(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """The same, with the rows of a group side by side."""
    return _in_blocks(df, key, blocks).drop(key).repartition("group").sortWithinPartitions("group")


def _whole_groups(batches: Batches):
    """Tables that hold whole groups, from rows sorted by ``group``."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([*rest, batch]).combine_chunks()
            groups = table.column("group").to_numpy()
            end = int(np.searchsorted(groups, groups[-1]))
            if end:
                yield table.slice(0, end)
            rest = table.slice(end).to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges that connect what the pairs connect, one for each node but the smallest of a component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x) and (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
    keep = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[label[keep]], pa.int64()), pa.array(nodes[keep], pa.int64())], ["a", "b"])


def _counts_differ(x: list, y: list) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1).astype(np.int16) for c in (x, y))
    return np.abs(x - y).sum(1)


class _Entries:
    """Index entries sorted by list and position, and which pairs of them may be linked."""

    def __init__(self, table: pa.Table, threshold: int):
        groups, at = table.column("group").to_numpy(), table.column("at").to_numpy()
        order = np.lexsort((at, groups))
        self.groups, self.at, self.threshold = groups[order], at[order], threshold
        self.ids, self.sizes = (table.column(c).to_numpy()[order] for c in ("id", "n"))
        self.maps, self.counts = _maps_of(table)[order], table.column("counts").take(pa.array(order)).to_pylist()

    def partners(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (x, y) of rows that no bound rules out."""
        most = _most_different(self.sizes[x] + self.sizes[y], self.threshold)
        keep = (self.at[x] + self.at[y] <= most) & (np.abs(self.sizes[x] - self.sizes[y]) <= most) & (self.ids[x] != self.ids[y])
        x, y, most = x[keep], y[keep], most[keep]
        keep = np.bitwise_count(self.maps[x] ^ self.maps[y]).sum(1, dtype=np.int64) <= most
        x, y, most = x[keep], y[keep], most[keep]
        both = np.array([self.counts[i] is not None and self.counts[j] is not None for i, j in zip(x, y, strict=True)], bool)
        if both.any():
            both[both] = _counts_differ([self.counts[i] for i in x[both]], [self.counts[j] for j in y[both]]) > most[both]
            x, y = x[~both], y[~both]
        return x, y


def _blocks(e: _Entries, start: int, end: int, size: int):
    """Pairs of rows of one long list, by pairs of blocks; those that positions or sizes rule out are skipped whole."""
    cuts = range(start, end, size)
    low, high = ([pick(e.sizes[c : min(c + size, end)]) for c in cuts] for pick in (np.min, np.max))
    for i, a in enumerate(cuts):
        for j, b in enumerate(cuts[i:], i):
            if e.at[a] + e.at[b] > _most_different(int(high[i]) + int(max(high)), e.threshold):
                break  # positions only rise from here
            most = _most_different(int(high[i] + high[j]), e.threshold)
            if e.at[a] + e.at[b] > most:
                continue
            if max(low[i] - high[j], low[j] - high[i]) > most:
                continue
            x, y = np.meshgrid(np.arange(a, min(a + size, end)), np.arange(b, min(b + size, end)), indexing="ij")
            later = x < y
            yield x[later], y[later]


def _candidates(batches: Batches, threshold: int, steps: int = STEPS) -> Batches:
    """Edges between the possible partners of index lists."""
    for table in _whole_groups(batches):
        e = _Entries(table, threshold)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.flatnonzero(np.concatenate([[True], e.groups[1:] != e.groups[:-1], [True]]))
        short = np.repeat(np.diff(cuts) <= steps, np.diff(cuts))
        for step in range(1, steps):
            x = np.flatnonzero((e.groups[:-step] == e.groups[step:]) & short[:-step])
            if not len(x):
                break
            found.append(e.partners(x, x + step))
        for k in np.flatnonzero(np.diff(cuts) > steps):
            for x, y in _blocks(e, int(cuts[k]), int(cuts[k + 1]), 8 * steps):
                x, y = e.partners(x, y)
                if len(x):
                    yield _stars(e.ids[x], e.ids[y])
        if sum(len(x) for x, _ in found):
            yield _stars(*(np.concatenate([e.ids[z[k]] for z in found]) for k in (0, 1)))


def _maps_of(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(m).to_numpy().view(np.uint64) for m in MAP_NAMES], 1)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    a, b = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _linked(batches: Batches, threshold: int, every: bool) -> Batches:
    """Links (a, b) between the sets of a group: all of them, or as many as connect what they connect."""
    for table in _whole_groups(batches):
        groups = table.column("group").to_numpy()
        cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1), len(groups)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield _links_of(table.slice(start, end - start), threshold, every)


def _links_of(group: pa.Table, threshold: int, every: bool) -> pa.RecordBatch:
    """Links of one group. Rows of one ``label`` are known to be connected; those of one ``side`` (0 or 1) meet elsewhere."""
    maps, sizes, ids, grams = _maps_of(group), group.column("n").to_numpy(), group.column("id").to_numpy(), _arrays(group.column("grams"))
    label, side = group.column("label").to_numpy().copy(), group.column("side").to_numpy()
    pivots, differ = [], np.full((PIVOTS, len(ids)), -1, np.int32)  # symmetric differences from the pivots, where known
    left, right = [], []
    for i in range(1, len(ids)):
        most = _most_different(sizes[:i] + sizes[i], threshold)
        open_ = (ids[:i] != ids[i]) & ((side[:i] != side[i]) | (side[i] < 0))
        open_ &= np.bitwise_count(maps[:i] ^ maps[i]).sum(1, dtype=np.int64) <= most
        for k, j in enumerate(pivots):
            if not every:
                open_ &= label[:i] != label[i]
            if not open_.any():
                break
            if open_[j]:
                differ[k, i] = d = int(sizes[i] + sizes[j]) - 2 * _common(grams[i], grams[j])
                via = differ[k, :i]
                near = open_ & (via >= 0) & (via + d <= most)
                near[j] = d <= most[j]
                open_ &= ~(near | ((via >= 0) & (np.abs(via - d) > most)))
                open_[j] = False
                linked = np.flatnonzero(near)
                for z in linked if every else linked[np.unique(label[linked], return_index=True)[1]]:
                    left.append(min(ids[i], ids[z]))
                    right.append(max(ids[i], ids[z]))
                if near.any():
                    label[np.isin(label, label[:i][near])] = label[i]
        while True:
            if not every:
                open_ &= label[:i] != label[i]
            if not open_.any():
                break
            j = int(np.argmax(open_))
            d = int(sizes[i] + sizes[j]) - 2 * _common(grams[i], grams[j])
            open_[j] = False
            if len(pivots) < PIVOTS and j not in pivots:
                pivots.append(j)
                differ[len(pivots) - 1, [i, j]] = d, 0
            if d <= most[j]:
                left.append(min(ids[i], ids[j]))
                right.append(max(ids[i], ids[j]))
                label[label == label[i]] = label[j]
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _described(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """doc_id, n, id (class), prefix (keys of lists, once for each of ``spread`` classes), counts, m0..: a row for each of ``docs``."""
    bounded_batches(docs.sparkSession)
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    top = docs.select("text").mapInArrow(partial(_frequent, n=n), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT).toPandas().sort_values(["n", "gram"])
    grams, rank = top["gram"].to_numpy(np.int64).view(np.uint64), np.arange(1, len(top) + 1)
    order = np.argsort(grams)
    frequent = spark.sparkContext.broadcast((grams[order], rank[order]))
    return settle(docs.mapInArrow(partial(_describe, n=n, threshold=threshold, frequent=frequent), "doc_id long, n long, id long, prefix array<long>, spread int, counts binary, " + ", ".join(f"m{k} long" for k in range(MAPS))))


def _representatives(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (id, rep: smallest doc_id) of equal sets, and one row (id, rep, n, prefix, maps) for each class."""
    there = rows.where("n > 0 AND doc_id IS NOT NULL").withColumnRenamed("doc_id", "rep")
    classes = settle(there.groupBy("id").agg(F.min("rep").alias("rep")))
    # Both joins' sides are dealt by id, so the repeated rows of a doc_id go without another shuffle.
    reps = there.join(classes.withColumnRenamed("rep", "least"), "id").where("rep = least").drop("least").dropDuplicates(["id"])
    return classes, settle(reps)


def _sets_of(reps: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Sets by class of the documents ``reps`` (a settled table), and of a few more: texts aren't shuffled to find them."""
    wanted = docs.sparkSession.sparkContext.broadcast(membership_map(reps))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return texts.mapInArrow(partial(_only_sets, n=n, wanted=wanted), "doc_id long, id long, grams array<long>").where(F.size("grams") > 0)


def _entries(batches: Batches, lists) -> Batches:
    """The index entries of the lists that a membership map has: a row for each element of a prefix."""
    for batch in batches:
        prefix = batch.column("prefix")
        ends, grams = prefix.offsets.to_numpy(), prefix.values.to_numpy()
        grams, ends = grams[ends[0] : ends[-1]], ends - ends[0]
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        keep = lists.value.has(grams)
        rest = batch.drop_columns(["prefix", "spread"]).take(pa.array(row[keep]))
        length = np.diff(ends) // batch.column("spread").to_numpy()
        at = (np.arange(len(grams)) - ends[row]) % length[row] if len(grams) else grams
        yield pa.RecordBatch.from_arrays([pa.array(grams[keep]), pa.array(at[keep].astype(np.int32)), *rest.columns], ["gram", "at", *rest.schema.names])


def _possible(reps: DataFrame, threshold: int) -> DataFrame:
    """(id, component): the groups of possible partners, from the index."""
    counts = settle(reps.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("members")).where("members > 1"))
    hot = settle(counts.where(F.col("members") > BLOCK))  # a small table: joined without a shuffle of the entries
    lists = reps.sparkSession.sparkContext.broadcast(membership_map(counts.select("gram")))
    discard(counts)
    columns = ["id", "n", "counts", *MAP_NAMES]
    schema = "gram long, at int, id long, n long, counts binary, " + ", ".join(f"{m} long" for m in MAP_NAMES)
    entries = reps.select(*columns, "prefix", "spread").mapInArrow(partial(_entries, lists=lists), schema)
    entries = entries.join(hot, "gram", "left")
    dealt = _dealt(entries, "gram", F.ceil(F.coalesce("members", F.lit(1)) / BLOCK))
    group = connected_components(dealt.drop("members").mapInArrow(partial(_candidates, threshold=threshold), "a long, b long"))
    discard(hot)
    return group.withColumnRenamed("node", "id")


def _met_pivots(large: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) of the sets of ``large`` groups (component, id, n, grams) with ROUNDS pivots of their group.

    A pivot is a set that none before it is linked with; one row for each group is joined to the group's rows, by
    broadcast up to SENT elements and by a join whose hot groups AQE splits beyond.
    """
    links = None
    for _ in range(ROUNDS):
        open_ = large.select("component", "id") if links is None else large.select("component", "id").join(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti")
        pivot = settle(open_.groupBy("component").agg(F.min_by("id", F.xxhash64("id")).alias("id")))
        sets = settle(pivot.join(large, ["component", "id"]).select("component", F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("grams").alias("others")))
        sets = F.broadcast(sets) if (sets.agg(F.sum("m")).first()[0] or 0) <= SENT else sets
        common = F.size(F.array_intersect("grams", "others"))
        met = large.join(sets, "component").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * threshold).where(common * (100 + threshold) >= (F.col("n") + F.col("m")) * threshold)
        found = met.select(F.col("pivot").alias("a"), F.col("id").alias("b"))  # the pivot with itself too, so it is taken
        links = settle(found if links is None else links.union(found))
    return links.where("a <> b")


def _open_pairs(large: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of ``large`` groups dealt out so that any two that ``met`` leaves unconnected come together.

    The most common label of a group is side 0; its rows meet the others, side 1, and these meet one another too.
    """
    label = connected_components(met).toDF("id", "label")
    label = F.broadcast(label) if label.count() <= SENT else label
    rows = large.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = settle(rows.groupBy("component", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("grams")))
    blocks = F.greatest(F.ceil(F.sum("rows") / BLOCK), F.ceil(F.sum("grams") / GRAMS)).cast("int")
    main = sizes.groupBy("component").agg(F.max_by("label", F.struct("rows", "label")).alias("main"))
    sides = sizes.join(main, "component").withColumn("side", (F.col("label") != F.col("main")).cast("int"))
    sides = settle(sides.groupBy("component", "main").pivot("side", [0, 1]).agg(blocks).toDF("component", "main", "first", "second").where("second IS NOT NULL"))
    rows = rows.join(sides, "component").withColumn("side", (F.col("label") != F.col("main")).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("second")).cast("long"))
    rows = rows.withColumn("own", own)
    across = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("second")).otherwise(F.col("first")) - 1)))
    first, second = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    across = across.withColumn("group", F.xxhash64("component", F.lit("across"), first.cast("long"), second.cast("long")))
    within = rows.where("side = 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("second") - 1)))
    within = within.withColumn("group", F.xxhash64("component", F.lit("within"), F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long"))).withColumn("side", F.lit(-1))
    return across.unionByName(within)


def _all_links(reps: DataFrame, docs: DataFrame, n: int, threshold: int, every: bool) -> DataFrame:
    """Links (a, b) between the classes ``reps``: all, once each, or enough to connect the components. Deletes ``reps``."""
    group = _possible(reps, threshold)
    members = settle(reps.join(group, "id").select("id", "rep", "n", "component", *MAP_NAMES))
    discard(reps)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / GRAMS))
    sizes = settle(members.groupBy("component").agg(blocks.alias("blocks")).where("blocks > 1"))
    sets = _sets_of(settle(members.select("rep")), docs, n)
    with_sets = settle(members.join(sets, "id").where("rep = doc_id").drop("rep", "doc_id").dropDuplicates(["id"]))
    few = with_sets.join(sizes, "component", "left_anti").withColumn("group", F.col("component"))
    large = with_sets.join(sizes, "component")
    columns = ["group", "id", "n", "grams", "label", "side", *MAP_NAMES]
    plain = [F.col("id").alias(c) if c == "label" else F.lit(-1).alias(c) if c == "side" else F.col(c) for c in columns]
    dealt, links = few.select(*plain), None
    if not sizes.isEmpty():
        if every:
            dealt = dealt.union(_in_blocks(large, "component", F.col("blocks")).select(*plain))
        else:
            large = large.drop("blocks")
            links = settle(_met_pivots(large, threshold))
            dealt = dealt.union(_open_pairs(large, links).select(columns))
    dealt = dealt.repartition("group").sortWithinPartitions("group", "id")
    found = dealt.mapInArrow(partial(_linked, threshold=threshold, every=every), "a long, b long")
    found = found if links is None else found.union(links)
    return found.distinct() if every else found


def links(docs: DataFrame, n: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links between different texts, and membership.

    Returns ``(pairs, members)``: pairs (a, b) of class representatives (a < b; equal where texts share that doc_id)
    with Jaccard similarity of their sets of at least ``threshold`` per cent, and members (doc_id, n_shingles, rep), one row for each row of ``docs``.
    """
    described = _described(docs, n, threshold)
    classes, reps = _representatives(described)
    rows = settle(described.select("doc_id", "n", "id"))
    discard(described)
    members = rows.join(classes, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    pairs = _all_links(reps, docs, n, threshold, True)
    for end in "ab":
        pairs = pairs.join(classes.select(F.col("id").alias(end), F.col("rep").alias(f"rep_{end}")), end)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), members


def _placed(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, id (class), component_id of each row."""
    described = _described(docs, n, threshold)
    classes, reps = _representatives(described)
    rows = settle(described.select("doc_id", "n", "id"))
    discard(described)
    component = connected_components(_all_links(reps, docs, n, threshold, False)).withColumnRenamed("node", "id")
    linked = settle(component.join(classes, "id"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    found = classes.join(linked.join(least, "component").select("id", "least"), "id", "left").select("id", F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "id").join(found, "id", "left")
    return out.select("doc_id", "n_shingles", "id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def components(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (columns doc_id, text; others are ignored).

    A set holds the distinct ``n``-word shingles of the whole text with A-Z lower-cased; with fewer words, the whole
    sequence; two documents link when 100 * intersection >= ``threshold`` * union. The component is the smallest
    doc_id that links reach. Disk: the described rows (some tenth of the text), the sets of possible duplicates.
    """
    return _placed(docs, n, threshold).drop("id")


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; all columns stay.

    Rows without words, or without a doc_id, are all kept. Rows that repeat a doc_id are kept or dropped each by its own text.
    """
    placed = _placed(docs, n, threshold).where("doc_id IS NOT NULL")
    is_copy = (F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))
    drop = settle(placed.where(is_copy).select("doc_id", "id").distinct())
    mixed = settle(placed.where(~is_copy).join(drop.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct())
    maybe, kept = apart(docs, drop, "doc_id")  # texts of documents that surely stay aren't shuffled
    if mixed.isEmpty():
        return kept.union(maybe.join(drop.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns))
    # Some texts of these doc_ids go and some stay; only their sets are computed again.
    wanted = docs.sparkSession.sparkContext.broadcast(membership_map(mixed))
    schema = StructType([*docs.schema.fields, StructField(TAG, LongType())])
    tagged = maybe.mapInArrow(partial(_tagged, n=n, wanted=wanted), schema)
    drop = drop.join(mixed.withColumn("some", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("some"), F.col("id")).alias("only")).distinct()
    gone = (tagged["doc_id"] == drop["doc_id"]) & (drop["only"].isNull() | (drop["only"] == tagged[TAG]))
    return kept.union(tagged.join(drop, gone, "left_anti").drop(TAG).select(docs.columns))
