"""Exact deduplication, spelling variants and conversation repair against brute force, and on awkward rows."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlens.llm import common, conversation_repair, exact_dedup, queries, spelling

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, row long, fault string, part int"


# Exact deduplication


def same_texts(rows, change=lambda t: t):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(change(text or ""), []).append((-1 if doc_id is None else doc_id, i))
    out = []
    for members in groups.values():
        most = max(m[0] for m in members)
        for k, (doc_id, _) in enumerate(sorted(members, key=lambda m: -m[0])):
            out.append((doc_id, most, len(members), k == 0))
    return sorted(out)


def figures(df):
    least = lambda x: -1 if x is None else x
    return sorted((least(r.doc_id), least(r.keep_id), r.group_size, r.kept) for r in df.collect())


AWKWARD = [(1, None), (2, ""), (3, " "), (4, "x" * 300_000), (5, "x" * 300_000), (5, "x" * 300_000), (None, "a"), (None, "a"), (None, "b"), (7, "b"), (8, "ab" * 50 + "c"), (9, "ab" * 50 + "d"), (10, "été"), (11, "ete")]


@pytest.mark.parametrize("prefix", [1, 64])
@pytest.mark.parametrize("bits", [1, 28])
def test_exact_groups_equal_brute_force(spark, monkeypatch, prefix, bits):
    monkeypatch.setattr(common, "LEAST_BITS", bits)  # one bit of a map: everything passes it
    monkeypatch.setattr(common, "MOST_BITS", bits)
    df = spark.createDataFrame([(*r, 5, 1, 2) for r in AWKWARD], "doc_id long, text string, row long, n_bytes int, start int").repartition(3)
    assert figures(exact_dedup.groups(df, prefix=prefix)) == same_texts(AWKWARD)
    upper = [(i, t and t.upper()) for i, t in AWKWARD] + AWKWARD
    df = spark.createDataFrame(upper, "doc_id long, text string").repartition(5)
    assert figures(exact_dedup.groups(df, normalise=F.lower, prefix=prefix)) == same_texts(upper, str.lower)


def test_only_survivors_are_hashed_whole(spark, monkeypatch):
    rows = [(i, f"{'p' * 64}{i:04d}" if i < 20 else f"{i:04d} other") for i in range(200)] + [(500 + i, "q" * (200 + i)) for i in range(50)] + [(900, "0021 other")]
    seen, whole = [], exact_dedup.settle
    monkeypatch.setattr(exact_dedup, "settle", lambda df: seen.append(whole(df)) or seen[-1])
    out = figures(exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == same_texts(rows)
    rows = next(t for t in seen if {"doc_id", "full"} <= set(t.columns))
    hashed = {r.doc_id for r in rows.where("full IS NOT NULL").collect()}
    assert {*range(20), 21, 900} <= hashed and len(hashed) < 30


def test_a_hot_text_and_no_rows(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(3000)]
    assert figures(exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == same_texts(rows)
    assert exact_dedup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_query_is_native(spark):
    plan = queries.op11_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out = {}
    for w in n:
        beside = [v for v in n if near(w, v)]
        best = min(beside, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, len(beside)]
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {w: (form, root, n[w], k, n[form] if form else None) for w, (form, k, root) in out.items()}


def found_variants(words):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words).collect()}


def test_variants_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    base = ["".join(draw.choice(list("abcdé"), 8)) for _ in range(40)]
    words = set(base)
    for w in base * 6:  # chains and stars of edits, anagrams, both ends
        i, c = int(draw.integers(0, len(w) + 1)), str(draw.choice(list("abcdéÿ")))
        words |= {w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], "".join(draw.permutation(list(w)))}
    words |= {"a" * 500, "a" * 501, "a" * 250 + "b" + "a" * 250, "ab", "ba", "a", "b"}
    n = {w: int(10 ** draw.uniform(0, 4)) for w in sorted(words)}
    got = found_variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(7))
    assert got == brute_variants(n)
    assert any(v[0] and v[0] != v[1] for v in got.values())


def test_every_edit_shares_an_offer():
    for w in ("abcdefg", "aaaaaaaa", "été", "ab", "a"):
        mine = {o[:2]: o[2] for o in spelling.offers(w)}
        edits = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "aezÿ"} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "aezÿ"} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        for v in edits - {w, ""}:
            assert any(o[:2] in mine and (o[2] or mine[o[:2]]) for o in spelling.offers(v)), (w, v)


def test_counts_and_damage_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = Counter()
    for r in docs.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        runs = "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in low).split(" ")
        for run in filter(None, runs):
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            want[word] += len(word) >= 7
    want = {w: n for w, n in want.items() if n >= 2}
    counted = spelling.count_words(docs.repartition(3), damage=spelling.drop_letter)
    assert {r.word: r.n for r in counted.collect()} == want
    some = dict(sorted(want.items())[:400])
    assert found_variants(spark.createDataFrame(list(some.items()), "word string, n long")) == brute_variants(some)


def test_spelling_broadcasts_no_table_of_words(spark, monkeypatch):
    plans = []

    def settled(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return common.settle(df)

    monkeypatch.setattr(spelling, "settle", settled)
    words = spark.createDataFrame([("kettles", 40), ("kettle", 400), ("kettlex", 4), ("kottlex", 2), ("mittens", 9)], "word string, n long")
    found = spelling.variants(words)
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_spelling_awkward(spark):
    rows = [(1, None, 1, "x"), (2, "", 1, "x"), (None, "Abcdefgh abcdefgh", 1, "x"), (3, "ÀBCDEFGH àbcdefgh àbcdefgh", 1, "x"), (3, "ÀBCDEFGH àbcdefgh àbcdefgh", 1, "x"), (4, "1234567 中文中文中文中文", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, word string")
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == {"abcdefgh": 2, "Àbcdefgh": 2, "àbcdefgh": 4}
    assert found_variants(spelling.count_words(df)) == {"abcdefgh": (None, "abcdefgh", 2, 2, None), "Àbcdefgh": (None, "Àbcdefgh", 2, 2, None), "àbcdefgh": (None, "àbcdefgh", 4, 2, None)}
    assert spelling.variants(spelling.count_words(df.limit(0))).count() == 0


# Conversation repair


def every_way(rows):
    """(cost, audit, lines) of the best repair, by trying everything with at most one insertion pair a place."""
    legal = {""} | {s + "ua" * k for s in ("", "s") for k in range(1, 8)}
    best = None
    for choice in itertools.product("DKua", repeat=len(rows)):
        if any(c != "D" and f in (1, 2) for c, (_, f, _) in zip(choice, rows, strict=True)):
            continue
        cost = sum({"D": 2, "K": 0}.get(c, 1) + (5 if c != "D" and f == 3 else 0) for c, (_, f, _) in zip(choice, rows, strict=True))
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            total = cost + 5 * sum(map(len, gaps))
            if best and total > best[0]:
                continue
            initials, audit, lines = "", "", []
            for k, gap in enumerate(gaps):
                initials += gap
                audit += "I" * len(gap)
                lines += [{"u": "user:", "a": "assistant:"}[g] for g in gap]
                if k < len(rows) and choice[k] != "D":
                    role, _, text = rows[k]
                    role = {"u": "user", "a": "assistant"}.get(choice[k], role)
                    initials += role[:1] or "?"
                    lines.append(f"{role}:{text}")
                if k < len(rows):
                    audit += "R" if choice[k] in "ua" else choice[k]
            if initials in legal and (best is None or (total, audit) < best[:2]):
                best = (total, audit, lines)
    return best


def test_repair_equals_every_way():
    draw = np.random.default_rng(2)
    for _ in range(60):
        rows = [(str(draw.choice(["system", "user", "assistant", "tool", ""])), int(draw.choice([0, 0, 1, 2, 3])), f"t{i}") for i in range(int(draw.integers(0, 5)))]
        cost, audit, lines = every_way(rows)
        known = [(role[:1] if role[:1] in ("s", "u", "a") and role else "?", fault) for role, fault, _ in rows]
        got_cost, got_audit, steps, tail = conversation_repair.repair_rows(known)
        got = []
        for (role, _, text), (label, new, inserted) in zip(rows, steps, strict=True):
            got += [f"{r}:" for r in inserted] + ([f"{new or role}:{text}"] if label != "D" else [])
        assert (got_cost, got_audit, got + [f"{r}:" for r in tail]) == (cost, audit, lines), rows


def plain_repair(turns):
    """The contract in plain Python, conversation by conversation."""
    out = {}
    for conv in {t[0] for t in turns}:
        mine = [(t[1], t[2] if t[2] is not None else " ", t[3] if t[3] is not None else " ") for t in turns if t[0] == conv]
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, rows = set(), []
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            rows.append((role[:1] if role[:1] in ("s", "u", "a") and role else "?", fault))
        cost, audit, steps, tail = conversation_repair.repair_rows(rows)
        lines = []
        for (_, role, text), (label, new, inserted) in zip(mine, steps, strict=True):
            lines += [f"{r}:" for r in inserted] + ([f"{new or role}:{text}"] if label != "D" else [])
        lines += [f"{r}:" for r in tail]
        known = [t for t, *_ in mine if t is not None]
        n = Counter(f for _, f in rows)
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(rows))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, n[1], n[2], n[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_repairs(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def random_turns(seed, n, hot=0.4):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        conv = 3 if draw.random() < hot else int(draw.integers(10, 60))
        role = str(draw.choice(["user", "assistant", "user", "assistant", "system", "tool"]))
        rows.append((conv, int(draw.integers(0, n)), role, str(draw.choice([f"Text {i}.", f"cut {i}", "Same.", "", " \n"], p=[0.6, 0.15, 0.1, 0.1, 0.05])), 1, "x", 2))
    return rows


@pytest.mark.parametrize(("parts", "hot"), [(1, 0.4), (9, 0.4), (23, 1.0)])
def test_conversations_over_many_partitions(spark, parts, hot):
    rows = random_turns(parts, 800, hot)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found_repairs(conversation_repair.repair(spark.createDataFrame(rows, TURNS).repartition(4)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_repair([r[:4] for r in rows])


def test_repair_awkward(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "user", None), (1, None, "assistant", "x."), (2, 5, "", "a!"), (2, 9, "überuser", "b?"), (4, 0, "user", "z" * 200_000 + "."), (4, 2, "assistant", "日本。"), (5, None, "user", ""), (6, 1, "system", "S."), (7, 1, "user", "line\nnext."), (7, 2, "assistant", "\nb.\n")]
    got = found_repairs(conversation_repair.repair(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS).repartition(3)))
    assert got == plain_repair(rows)
    assert conversation_repair.repair_damaged(spark.createDataFrame([], TURNS)).count() == 0


def test_every_conversation_comes_back(spark):
    rows = [(c, t, "user", "A.") for c in range(60) for t in range(2)]
    got = found_repairs(conversation_repair.repair_damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    gone = [c for c in range(60) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in range(2))]
    assert set(got) == set(range(60))
    only = [(c, 0, "user", "A.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    lost = found_repairs(conversation_repair.repair_damaged(spark.createDataFrame(only, "conv_id long, turn long, role string, text string")))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(lost.values()) == {nothing} and all(got[c] == nothing for c in gone)
