"""Repair of conversations by weighted finite-state composition.

Three machines are composed: the conversation as an acceptor of its rows, an edit transducer (keep 0, rerole 1, delete
2, insert 5; a truncated row that isn't deleted owes 5 more; blank and repeated rows can only be deleted) and the
acceptor of the role grammar ``(s?(ua)+)?`` over role initials. A state of the composed machine is a place between two
rows and a state of the grammar; its arcs are made when it is reached, rows with the same initial and fault share
them. Weights are (cost, label string), compared lexicographically. Costs to the end are worked out backwards, in
topological order; the way from the start that takes the least label among the cheapest arcs is then the least string,
as two arcs of a state never share both label and cost.

A conversation may hold any part of the table, so none is gathered. Its rows (no texts, some 50 bytes each) are
range-partitioned by conversation and place; a run of one conversation in one partition is a *fragment*. Only the first
and the last fragment of a partition can have others of their conversation beside them: of those, the driver gets a
4 x 4 matrix of costs and then the four states they lead to, so at most two small rows a task; then all fragments are
edited on their own. Texts are shuffled once, for the digest. A SHA-256 can't be put together from parts: a conversation's
text streams through one task, sorted by Spark, a batch at a time.

Rows are taken by turn, nulls first; rows that share a turn by role and text digest. Null role or text counts as one
space; a null conv_id is a conversation. Roles other than s..., u..., a... (an empty one too) are only rerolled or deleted. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from functools import lru_cache, partial
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddlens.llm.common import Batches, discard, settle
from oddlens.sources.scratch import setting

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
NONE, BLANK, REPEATED, CUT = range(4)  # a row's fault
#: The grammar: state -> role initial -> state. A conversation may end in START and in ANSWERED.
START, SYSTEM, ASKED, ANSWERED = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": ASKED}, SYSTEM: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
ENDS = (START, ANSWERED)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60  # no way

Arc = tuple[str, int, int, str]  # label, cost, next state, role that the row gets ("" where it keeps its own or goes)
Costs = tuple[int, int, int, int]


@lru_cache(None)
def arcs(state: int, initial: str, fault: int) -> tuple[Arc, ...]:
    """Arcs of the composed machine that consume a row, by label."""
    out: list[Arc] = [("D", DELETE, state, "")]
    if fault not in (BLANK, REPEATED):
        owed = TRUNCATED * (fault == CUT)
        if initial in GRAMMAR[state]:
            out.append(("K", KEEP + owed, GRAMMAR[state][initial], ""))
        out += [("R", REROLE + owed, GRAMMAR[state][i], role) for i, role in ROLES.items() if i in GRAMMAR[state]]
    return tuple(out)


@lru_cache(None)
def insertion(state: int) -> tuple[int, str]:
    """The state after an inserted row, and its role: each state allows exactly one of user and assistant."""
    return next((GRAMMAR[state][i], role) for i, role in ROLES.items() if i in GRAMMAR[state])


def with_insertions(costs: Iterable[int]) -> Costs:
    """Costs from the states of a place, insertions included: two in a row at most, more come back to the same state."""
    out = list(costs)
    for _ in range(2):
        out = [min(c, INSERT + out[insertion(q)[0]]) for q, c in enumerate(out)]
    return tuple(out)


AT_END = with_insertions(0 if q in ENDS else FAR for q in GRAMMAR)

Rows = list[tuple[str, int]]  # (initial, fault)


def costs_to_go(rows: Rows, right: Costs) -> list[Costs]:
    """For each place, the least cost from each state; ``right`` is that of the last place."""
    out = [right]
    for initial, fault in reversed(rows):
        after = out[-1]
        out.append(with_insertions(min(c + after[to] for _, c, to, _ in arcs(q, initial, fault)) for q in GRAMMAR))
    return out[::-1]


def walk(rows: Rows, to_go: list[Costs], state: int) -> tuple[int, list[tuple[str, str, list[str]]]]:
    """The end state, and for each row its label, its new role and the roles inserted before it: the least string."""
    steps = []
    for (initial, fault), here, after in zip(rows, to_go, to_go[1:], strict=False):
        inserted: list[str] = []
        while True:
            best = [(label, to, role) for label, c, to, role in arcs(state, initial, fault) if c + after[to] == here[state]]
            to, role = insertion(state)
            if INSERT + here[to] == here[state]:
                best.append(("I", to, role))
            label, state, role = min(best)
            if label != "I":
                break
            inserted.append(role)
        steps.append((label, role, inserted))
    return state, steps


def finish(state: int) -> list[str]:
    """Roles inserted after the last row."""
    out = []
    while state not in ENDS:
        state, role = insertion(state)
        out.append(role)
    return out


def repair_rows(rows: Rows) -> tuple[int, str, list[tuple[str, str, list[str]]], list[str]]:
    """Cost, audit, steps and closing roles of one conversation that is at hand."""
    to_go = costs_to_go(rows, AT_END)
    state, steps = walk(rows, to_go, START)
    tail = finish(state)
    return to_go[0][START], "".join("I" * len(ins) + label for label, _, ins in steps) + "I" * len(tail), steps, tail


# Fragments


def _fragment_type(conv_id: T.DataType) -> T.StructType:
    fields = [("conv_id", conv_id), ("chunk", T.LongType()), ("edge", T.BooleanType()), ("rows", T.ArrayType(T.LongType())), ("initials", T.StringType()), ("faults", T.BinaryType())]
    return T.StructType([T.StructField(*f) for f in [*fields, ("first_turn", T.LongType()), ("last_turn", T.LongType()), ("least_turn", T.LongType()), ("turns", T.LongType())]])


def _packed(batches: Batches, schema: pa.Schema, at_once: int = 2000) -> Batches:
    """Sorted rows as fragments; the first and the last of the partition are edges."""
    chunk, open_, ready, first = TaskContext.get().partitionId(), None, [], True

    def closed(edge: bool) -> dict:
        conv, ids, initials, faults, turns = open_
        known = [t for t in turns if t is not None]  # sorted, nulls first
        distinct = bool(known) + sum(a != b for a, b in pairwise(known))
        return {"conv_id": conv, "chunk": chunk, "edge": edge, "rows": ids, "initials": "".join(initials), "faults": bytes(faults), "first_turn": turns[0], "last_turn": turns[-1], "least_turn": known[0] if known else None, "turns": distinct}

    for batch in batches:
        for conv, row, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "row", "turn", "initial", "fault")), strict=True):
            if open_ is None or conv != open_[0]:
                if open_ is not None:
                    ready.append(closed(first))
                    first = False
                    if len(ready) >= at_once:
                        yield pa.RecordBatch.from_pylist(ready, schema=schema)
                        ready = []
                open_ = (conv, [], [], [], [])
            for values, value in zip(open_[1:], (row, initial, fault, turn), strict=True):
                values.append(value)
    if open_ is not None:
        yield pa.RecordBatch.from_pylist([*ready, closed(True)], schema=schema)


def _rows_of(fragment: Mapping) -> Rows:
    return list(zip(fragment["initials"], fragment["faults"], strict=True))


def _matrices(batches: Batches) -> Batches:
    """The costs through each fragment: from each state (rows) to each state (columns)."""
    for batch in batches:
        for f in batch.to_pylist():
            rows = _rows_of(f)
            costs = [costs_to_go(rows, tuple(0 if q == end else FAR for q in GRAMMAR))[0] for end in GRAMMAR]
            row = {"conv_id": f["conv_id"], "chunk": f["chunk"], "costs": [costs[e][q] for q in GRAMMAR for e in GRAMMAR], "initials": f["initials"][0] + f["initials"][-1], "first_turn": f["first_turn"], "last_turn": f["last_turn"]}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("conv_id", batch.schema.field("conv_id").type), ("chunk", pa.int64()), ("costs", pa.list_(pa.int64())), ("initials", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]))


def _led(batches: Batches, right: Mapping[tuple, Costs]) -> Batches:
    """The state to which each state leads through a fragment, given the costs beyond it."""
    for batch in batches:
        for f in batch.to_pylist():
            if (key := (f["conv_id"], f["chunk"])) in right:
                to_go = costs_to_go(rows := _rows_of(f), right[key])
                yield pa.RecordBatch.from_pylist([{"conv_id": key[0], "chunk": key[1], "ends": [walk(rows, to_go, q)[0] for q in GRAMMAR]}], schema=pa.schema([("conv_id", batch.schema.field("conv_id").type), ("chunk", pa.int64()), ("ends", pa.list_(pa.int64()))]))


def _beside(fragments: DataFrame) -> dict[tuple, dict]:
    """For fragments of conversations that have several: costs beyond, state before, last role initial and turn before, whether it is the last."""
    conv_id = fragments.schema["conv_id"].dataType.simpleString()
    edges = fragments.where("edge")
    several: dict[object, list] = {}
    for r in edges.mapInArrow(_matrices, f"conv_id {conv_id}, chunk long, costs array<long>, initials string, first_turn long, last_turn long").toLocalIterator():
        several.setdefault(r.conv_id, []).append(r)
    several = {k: sorted(v, key=lambda r: r.chunk) for k, v in several.items() if len(v) > 1}
    right: dict[tuple, Costs] = {}
    for conv, parts in several.items():
        beyond = AT_END
        for r in reversed(parts):
            right[conv, r.chunk] = beyond
            beyond = tuple(min(r.costs[4 * q + e] + beyond[e] for e in GRAMMAR) for q in GRAMMAR)
    if not right:
        return {}
    ends = {(r.conv_id, r.chunk): r.ends for r in edges.mapInArrow(partial(_led, right=right), f"conv_id {conv_id}, chunk long, ends array<long>").toLocalIterator()}
    out = {}
    for conv, parts in several.items():
        state, before = START, None
        for r in parts:
            key = (conv, r.chunk)
            out[key] = {"right": right[key], "state": state, "initial": before.initials[-1] if before else "", "turn": before.last_turn if before else None, "last": r is parts[-1]}
            state, before = ends[key][state], r
    return out


ALONE = {"right": AT_END, "state": START, "initial": "", "turn": None, "last": True}


def opened(roles: list[str]) -> str:
    return "".join(f"{role}:\n" for role in roles)


def _edited(batches: Batches, beside: Mapping[tuple, dict], schema: pa.Schema) -> Batches:
    """Figures of each fragment, its part of the audit, and the lines it gives: row, role ("" is its own) and what is inserted before."""
    for batch in batches:
        out = []
        for f in batch.to_pylist():
            side = beside.get((f["conv_id"], f["chunk"]), ALONE)
            rows = _rows_of(f)
            to_go = costs_to_go(rows, side["right"])
            state, steps = walk(rows, to_go, side["state"])
            tail = finish(state) if side["last"] else []
            lines = [{"row": None if label == "D" else r, "role": role, "before": opened(ins)} for r, (label, role, ins) in zip(f["rows"], steps, strict=True) if label != "D" or ins]
            if tail:
                lines.append({"row": None, "role": "", "before": opened(tail)})
            cost = to_go[0][side["state"]] - to_go[-1][state] + INSERT * len(tail)
            roles = side["initial"] + f["initials"]
            out.append(
                {"conv_id": f["conv_id"], "chunk": f["chunk"], **{n: f["faults"].count(k) for n, k in (("blank", BLANK), ("duplicate", REPEATED), ("truncated", CUT))}, "illegal": sum(a + b not in LEGAL for a, b in pairwise(roles)), "cost": cost}
                | {"audit": "".join("I" * len(ins) + label for label, _, ins in steps) + "I" * len(tail), "lines": lines, "least": f["least_turn"], "most": f["last_turn"], "turns": f["turns"] - (side["turn"] is not None and side["turn"] == f["first_turn"])}
            )
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _digests(batches: Batches, schema: pa.Schema) -> Batches:
    """SHA-256 of the lines of each conversation, joined by newlines; rows come sorted."""
    at, digest, empty, ready = None, None, True, []
    for batch in batches:
        for conv, before, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "before", "role", "text")), strict=True):
            if digest is None or conv != at:
                if digest is not None:
                    ready.append((at, digest.hexdigest()))
                at, digest, empty = conv, hashlib.sha256(), True
            lines = before[:-1].split("\n") if before else []
            for line in [*lines, *([] if role is None else [f"{role}:{text}"])]:
                digest.update(("" if empty else "\n").encode() + line.encode())
                empty = False
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), schema.types, strict=True)], schema=schema)
            ready = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], schema.types[0]), pa.array([digest.hexdigest()])], schema=schema)


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def initial_of(role: Column) -> Column:
    """The initials that the grammar knows, or ``?``."""
    return F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("?")


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    conv_id = turns.schema["conv_id"].dataType
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    kept = settle(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row")))
    end = F.rtrim("text", F.lit(SPACES))
    small = kept.select("conv_id", "turn", "role", "row", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("digest"))
    first = small.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), REPEATED).when(F.col("cut"), CUT).otherwise(NONE)
    place = ["conv_id", "turn", "role", "digest", "row"]
    rows = small.join(first, "row", "left").select(*place, initial_of(F.col("role")).alias("initial"), fault.alias("fault"))
    packed = _fragment_type(conv_id)
    fragments = settle(rows.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(partial(_packed, schema=_arrow(packed)), packed))
    name = conv_id.simpleString()
    shape = T.StructType([T.StructField("conv_id", conv_id), *T._parse_datatype_string("chunk long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines array<struct<row:long, role:string, before:string>>, least long, most long, turns long").fields])
    edited = settle(fragments.mapInArrow(partial(_edited, beside=_beside(fragments), schema=_arrow(shape)), shape))
    discard(fragments)

    lines = edited.select(F.xxhash64("conv_id").alias("part"), "conv_id", "chunk", F.posexplode("lines").alias("at", "line")).select("part", "conv_id", "chunk", "at", "line.row", F.col("line.role").alias("new"), "line.before")
    new = F.when((F.col("new") != "") & F.col("row").isNotNull(), F.col("new"))
    texts = kept.select(F.xxhash64("conv_id").alias("part"), "row", "role", "text").repartition("part")
    found = lines.repartition("part").join(texts, ["part", "row"], "left").select("part", "conv_id", "chunk", "at", "before", F.coalesce(new, "role").alias("role"), "text")
    # The window asks Spark for whole conversations in order; dealt so already, rows aren't shuffled again.
    stream = found.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("conv_id", "chunk", "at")))
    digests = stream.mapInArrow(partial(_digests, schema=pa.schema([("conv_id", _arrow(packed).field("conv_id").type), ("repaired_sha256", pa.string())])), f"conv_id {name}, repaired_sha256 string")

    with setting(kept.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # both sides stay dealt by conversation
        digests = settle(digests)
    discard(kept)

    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
    sums = edited.groupBy("conv_id").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), audit.alias("audit")
    )
    digests = digests.withColumnRenamed("conv_id", "__conv")
    return sums.join(digests, sums["conv_id"].eqNullSafe(digests["__conv"]), "left").drop("__conv").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that the CRC-32 of ``conv_id:turn`` chooses; nulls are one space first.

    Of its remainder by 20: 0 drops the row, 1 empties the text, 2 takes out ``.!?``, 3 repeats the row, 4 makes it the user's.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair`` after ``damage``, with a row for every conversation of ``turns``; zeros, an empty audit and the empty text's digest where no row is left."""
    ids, done = turns.select("conv_id").distinct(), repair(damage(turns)).withColumnRenamed("conv_id", "__conv")
    nothing = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return ids.join(done, ids["conv_id"].eqNullSafe(done["__conv"]), "left").drop("__conv").withColumns(nothing)
