"""The text operators against brute force, exact round trips and held-out labels, and on awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oddlens.llm import decontaminate, language_id, mixing, ngram_join, quality_ranker, quality_rules, queries, sharding, suffix_dedup, toxicity, url_filter
from oddlens.llm.common import connected_components, membership_map, settle

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(1, None, "en", None, 1), (2, "", None, "a", 0), (3, " \n\t ", "en", "a", 3), (4, long, "en", "b", 9), (4, long, "en", "b", 9), (5, "one", "en", "b", 3), (None, "one", "en", "b", 3), (6, "One", None, "b", 3), (7, "été 日本語 naïve", "fr", "c", 5)]
    return spark.createDataFrame([(*r, 7, 8, "x") for r in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def jaccard_components(texts, n, threshold):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for d, s in sets.items():
        for e in {e for g in s for e in where[g] if e < d}:
            common = len(s & sets[e])
            if 100 * common >= threshold * (len(s) + len(sets[e]) - common):
                links.add((e, d))
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}, links, sets


@pytest.mark.parametrize(("n", "threshold"), [(3, 90), (5, 80), (1, 60)])
def test_ngram_components_equal_brute_force(spark, docs, n, threshold):
    some = docs.where("length(text) < 3000") if n == 1 else docs
    want, _, _ = jaccard_components(texts(some), n, threshold)
    got = ngram_join.components(some, n, threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize(("block", "grams", "rounds"), [(5, 300, 1), (25, 10_000, 3), (2048, 500_000, 3)])
def test_ngram_blocks_and_all_links(spark, monkeypatch, block, grams, rounds):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "GRAMS", grams)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    draw = np.random.default_rng(1)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(int(draw.integers(0, 4))):
            w[int(draw.integers(0, 40))] = f"x{draw.integers(0, 99)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, links, sets = jaccard_components(dict(rows), 2, 80)
    assert {r.doc_id: r.component_id for r in ngram_join.components(df, 2, 80).collect()} == {d: c for d, (_, c) in want.items()}
    pairs, members = ngram_join.links(df, 2, 80)
    rep = {r.doc_id: r.rep for r in members.collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got == {tuple(sorted((rep[a], rep[b]))) for a, b in links if sets[a] != sets[b]}


def test_blocks_of_a_list_lose_no_partners():
    draw, n = np.random.default_rng(3), 300
    sets = [np.unique(draw.integers(0, 400, int(draw.integers(20, 60))).astype(np.uint64)) for _ in range(n)]
    sets = [np.union1d(sets[i // 2], sets[i][:2]) if i % 3 else sets[i] for i in range(n)]
    columns = {"group": np.sort(draw.integers(0, 3, n)), "id": np.arange(n), "n": np.array([len(x) for x in sets]), "at": draw.integers(0, 4, n), "counts": [None] * n}
    maps = np.stack([np.bincount(x.astype(int), minlength=512).astype(np.uint8) for x in sets])
    maps = np.packbits(maps, axis=1).view(np.int64)
    batch = pa.RecordBatch.from_pydict(columns | {f"m{k}": maps[:, k].copy() for k in range(8)}, schema=pa.schema([("group", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("counts", pa.binary()), *((f"m{k}", pa.int64()) for k in range(8))]))

    def parts(steps):
        edges = [e for b in ngram_join._candidates(iter([batch]), 80, steps) for e in zip(*(b.column(c).to_pylist() for c in "ab"), strict=True)]
        label = list(range(n))
        for a, b in edges * 8:
            label = [min(label[a], label[b]) if i in (a, b) else x for i, x in enumerate(label)]
        return label

    assert parts(2) == parts(1000) and len(set(parts(2))) < n


def test_ngram_awkward(awkward, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.components(awkward, 3, 90).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[6, 1] == 5 and got[None, 1] == 5
    assert ngram_join.components(empty).count() == 0
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id = 4").count() == 2


@pytest.mark.parametrize("parts", [1, 2, 3, 4])
def test_ngram_texts_that_share_a_doc_id(spark, parts):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(2, a), (5, a + " end"), (2, b), (2, b), (4, b + " end"), (1, c), (5, c), (5, "quite another text"), (5, None), (7, "last of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(df, 3, 90).collect()}
    assert got == {(2, 58, 2), (5, 59, 2), (4, 59, 2), (1, 58, 1), (5, 58, 1), (5, 1, 5), (5, 0, 5), (7, 1, 7)}
    pairs, _ = ngram_join.links(df, 3, 90)
    assert {(r.a, r.b) for r in pairs.collect()} == {(2, 5), (2, 4)}
    kept = {(r.doc_id, r.text) for r in ngram_join.keep_one(df, 3, 90).collect()}
    assert kept == {(2, a), (2, b), (1, c), (5, "quite another text"), (5, None), (7, "last of all")}


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (9, 8), (8, 7), (3, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7}


def test_membership_map_never_misses(spark):
    keys = settle(spark.range(0, 5000, 7).select(F.col("id")))
    there = membership_map(keys)
    assert there.has(np.arange(0, 5000, 7)).all() and there.has(np.arange(10**6, 10**6 + 2000)).mean() < 0.2


def test_knapsack_is_exact():
    for seed in range(30):
        draw = np.random.default_rng(seed)
        lengths = np.unique(draw.integers(1, 40, 6))
        counts = draw.integers(0, 4, len(lengths))
        budget = int(draw.integers(0, 120))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        take = mixing._knapsack(lengths, counts, budget) if budget else np.zeros(len(lengths), int)
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_mix_meets_targets(docs):
    got = mixing.mix(docs, (3, 1, 2), 1.5).toPandas()
    size = {r.doc_id: len((r.text or "").split()) for r in docs.toPandas().itertuples()}
    total = sum(size.values())
    assert len(got) == len(size) and got.groupby("source").target.first().sum() == pytest.approx(1.5 * total)
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), whole=("source_size", "first"))
    assert (by.target <= 2 * by.whole + 1e-6).all() and (abs(by.target - by.taken) <= 0.05 * by.target + 1).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = mixing.mix(docs.repartition(7), (3, 1, 2), 1.5).toPandas()
    assert got.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())


def test_targets_share_out_excess():
    assert mixing.targets({"a": 10, "b": 100}, {"a": 3, "b": 1}, 100, 0, 2) == {"a": 20, "b": 80}
    assert mixing.targets({"a": 10, "b": 100}, {"a": 0, "b": 1}, 120, 1, 2) == {"a": 10, "b": 110}


def test_mix_awkward(awkward, empty):
    got = mixing.mix(awkward, (3, 1, 2), 1.5).toPandas()
    assert len(got) == 9 and got[got["size"] == 0].taken.sum() == 0
    assert mixing.mix(empty, (3, 1, 2), 1.5).count() == 0


def check_shards(rows, shards, n):
    assert len(rows) == n
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert rows["shard"].between(0, shards - 1).all()


def test_shards_are_balanced_and_gapless(docs):
    got = sharding.shard(docs, 8).toPandas()
    check_shards(got, 8, docs.count())
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.15 * sizes.mean()
    text = texts(docs)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples())


def test_shards_split_a_hot_group(spark):
    rows = [(i, "same text " * 20 if i % 2 else f"text {i} " * 20) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    check_shards(got, 8, 2000)
    assert sizes.max() <= 1.05 * sizes.mean()


def test_shards_of_rows_without_ids(spark):
    rows = [(None, "the same text again " * 9)] * 1000 + [(i, f"text {i} " * 20) for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.01 * sizes.mean() and sizes.min() >= 0.99 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_shards_awkward(awkward, empty):
    check_shards(sharding.shard(awkward, 4).toPandas(), 4, 9)
    assert sharding.shard(empty, 4).count() == 0


def test_rules_are_ordered_by_rejection_per_cost():
    rules = [quality_rules.Rule(n, F.lit(True)) for n in "abc"]
    assert [r.name for r in quality_rules.order(rules, {"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (1.0, 0.0)})] == ["b", "a", "c"]


def test_an_empty_rule_costs_about_nothing(docs):
    rules = [quality_rules.Rule("empty", F.lit(True)), *quality_rules.default_rules()]
    got = quality_rules.measure(quality_rules.figures(docs).persist(), rules)
    assert got["empty"][0] < got["upper_case"][0] / 4 and got["empty"][0] < got["letters"][0] / 4 and got["empty"][1] == 0


def test_rules_awkward(spark, awkward, empty):
    got = quality_rules.cascade(awkward).toPandas()
    assert len(got) == 9 and not got.kept[got.n_words < 50].any() and got.n_words.max() == 60_000
    assert quality_rules.cascade(empty).count() == 0
    row = quality_rules.figures(spark.createDataFrame([(1, "a b c a b c d\nx\n\nx\n#y")], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words, row.n_dup_lines, row.n_symbols, row.n_lines) == (10, 6, 1, 1, 4)


def test_repeat_words_equal_brute_force(docs):
    for r in quality_rules.figures(docs).collect():
        w = r.text.encode().split()
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        assert r.n_words == len(w) and r.n_repeat_words == len({i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)})


def test_url_collisions_are_confirmed(tmp_path):
    array, strings, lengths = url_filter.build([("a.com/", False), ("b.com/", True), ("com/x", False)], hash64=lambda b: len(b) % 2)
    (tmp_path / "a").write_bytes(array), (tmp_path / "s").write_bytes(strings)
    rules = url_filter.Rules(str(tmp_path / "a"), str(tmp_path / "s"), lengths, hash64=lambda b: len(b) % 2)
    urls = [url_filter.parts(u) for u in (b"http://A.com/q", b"https://www.b.com/x?y", b"http://c.com/xy#z", b"http://acom/", b"no", None, b"http://a.com?q=/")]
    assert [x and x[0] for x in rules.find(urls)] == [b"a.com/", b"b.com/", b"com/x", None, None, None, None]


def test_url_awkward(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "x", "h"), (None, "http://m.x.COM/en/1?a", "h")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, [("x.com/en/", "block"), ("com/", "allow")]).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), None: ("m.x.com", "/en/1", "x.com/en/", "block")}
    assert url_filter.judge(pages, []).where("verdict = 'allow'").count() == 3
    assert url_filter.judge(pages.where("false"), [("com/", "allow")]).count() == 0
    long = "http://m.x.com/en/" + "a" * 200_000
    again = spark.createDataFrame([(1, long), (1, long), (2, "http://ab.com/q")], "page_id long, url string")
    got = [(r.page_id, len(r.path), r.rule) for r in url_filter.judge(again, [("ab.com/", "block"), ("x.com/e", "block"), ("com/en/", "allow")]).collect()]
    assert sorted(got) == [(1, 200_004, "com/en/"), (1, 200_004, "com/en/"), (2, 2, "ab.com/")]


def repeated_words(rows, least):
    """(doc_id, text) -> words in windows that stand at two places or more."""
    seen, out = {}, {}
    split = [(d, t, t.encode().split()) for d, t in rows if t]
    for _, _, w in split:
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])] = seen.get(tuple(w[k : k + least]), 0) + 1
    for d, t, w in split:
        found = {x for k in range(len(w) - least + 1) if seen[tuple(w[k : k + least])] > 1 for x in range(k, k + least)}
        if found:
            out[d, t] = found
    return out


def found_words(df, least):
    return sorted((str(r.doc_id), sorted({w for p in r.passages for w in range(p.start, p.end)})) for r in suffix_dedup.repeats(df, least).collect())


def test_repeats_equal_brute_force(docs):
    want = repeated_words([(r.doc_id, r.text) for r in docs.collect()], 30)
    assert found_words(docs, 30) == sorted((str(d), sorted(w)) for (d, _), w in want.items())


@pytest.mark.parametrize("parts", [1, 5])
def test_repeats_of_variants_of_one_passage(spark, parts):
    """One passage in many variants (an anchor with hundreds of classes), repeats inside a text, rows that share a doc_id."""
    draw = np.random.default_rng(5)
    base, rows = [f"b{i}" for i in range(70)], []
    for i in range(300):
        w = list(base)
        for _ in range(int(draw.integers(1, 4))):
            w[int(draw.integers(0, 70))] = f"x{draw.integers(0, 30)}"
        rows.append((i, " ".join([f"p{i}", *w, f"q{i % 7}"])))
    own = " ".join(f"o{i}" for i in range(40))
    rows += [(900, f"{own} and {own}"), (901, "a " * 60), (902, "one " + own), (902, "two " + own), (None, own), (903, "short")]
    want = sorted((str(d), sorted(w)) for (d, _), w in repeated_words(rows, 30).items())
    assert found_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 30) == want


def test_anchors_over_many_partitions_equal_brute_force(spark):
    rows = [(str(i), " ".join([f"p{i}", *(f"b{k}" if (k * 7 + i) % 31 else f"x{i % 5}" for k in range(60))])) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are put together
    try:
        got = found_words(spark.createDataFrame(rows, "doc_id string, text string"), 25)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == sorted((d, sorted(w)) for (d, _), w in repeated_words(rows, 25).items())


def test_repeats_are_left_at_one_place(spark):
    own, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "op")
    rows = [(1, f"start {own}\nend", "k"), (2, f"{own} {other}", None), (3, f"x {other} y {other} z", "k"), (4, "a " * 60, "k"), (5, None, "k"), (6, "", "k"), (None, "left alone", "k")]
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, key string"), 30).collect()}
    assert got == {1: rows[0][1], 2: other, 3: "x y z", 4: "a " * 30, 5: None, 6: "", None: "left alone"}


def test_repeats_awkward(awkward, empty):
    assert [(r.doc_id, r.n_words_repeated) for r in suffix_dedup.repeats(awkward).collect()] == [(4, 60_000)]  # its row is there twice
    assert suffix_dedup.repeats(empty).count() == 0
    assert suffix_dedup.without_repeats(awkward).count() == 9 and suffix_dedup.without_repeats(empty).count() == 0
    assert suffix_dedup.without_repeats(awkward).columns == awkward.columns


def labelled(spark, name):
    return spark.read.parquet(f"/root/testdata/{name}/documents.parquet"), spark.read.parquet(f"/root/testdata/{name}/labels.parquet")


def test_quality_on_held_out_labels(spark):
    got = queries.op7_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labelled(spark, "sf0.01")[1], "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95 and got.score.between(0, 1).all()


def test_quality_learns_from_all_labels(spark):
    draw = np.random.default_rng(5)
    said = [" ".join(draw.choice(["one", "two", "THREE", "4", "| five", "six!"], 1 + k % 23)) for k in range(11_000)]
    bad = [int(draw.random() < 0.02 + 0.5 * ("|" in t)) for t in said]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "doc_id long, text string")
    ranker = quality_ranker.learn(rows, spark.createDataFrame([(k, 1 - b) for k, b in enumerate(bad)], "doc_id long, quality int"))
    x, bad = np.array([quality_ranker.features(t.encode()) for t in said]), np.array(bad)
    assert np.allclose(ranker.centre, np.median(x, 0), atol=1e-12) and np.allclose(ranker.scale, x.std(0) + 1e-6, atol=1e-12)
    raw = np.sort(ranker.raw(x))
    assert ranker.threshold == pytest.approx((raw[bad.sum()] + raw[bad.sum() - 1]) / 2) and ranker.spread == pytest.approx(raw.std() / 2)


def test_quality_pairs(spark, monkeypatch):
    """In one bucket the weights are those of all pairs; in more, every row takes part and none meets more rivals than one."""
    draw = np.random.default_rng(6)
    said = [" ".join(draw.choice(["one", "TWO", "4", "|", "six!"], 5)) for _ in range(90)]
    label = np.array([k % 3 == 0 for k in range(90)], int)
    docs, labels = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), spark.createDataFrame([(k, int(v)) for k, v in enumerate(label)], "doc_id long, quality int")
    rows = quality_ranker.labelled(docs, labels)
    got = quality_ranker.blocks(rows, 30, 60)
    different = {(int(v), tuple(quality_ranker.features(t.encode()))) for v, t in zip(label, said, strict=True)}
    seen = {(0, tuple(v)) for r in got.collect() for v in r.x} | {(1, tuple(v)) for r in got.collect() for v in r.rivals}
    assert seen == different and sum(sum(r.n) for r in got.collect()) == 60 and all(len(r.rivals) <= quality_ranker.RIVALS for r in got.collect())
    monkeypatch.setattr(quality_ranker, "RIVALS", 1000)
    ranker = quality_ranker.learn(docs, labels)
    z = np.clip((np.array([quality_ranker.features(t.encode()) for t in said]) - ranker.centre) / ranker.scale, -8, 8)
    difference = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, z.shape[1])
    assert np.allclose(difference.T @ (1 / (1 + np.exp(difference @ ranker.weight))) / len(difference), 1e-3 * ranker.weight, atol=1e-7)


def test_toxicity_on_held_out_labels(spark):
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labelled(spark, "sf0.1")[1], "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() >= 0.95 and got[got.toxic == 1].predicted.mean() >= 0.9


def test_toxic_clauses():
    grammar = toxicity.Grammar({"idiot": 0.9, "worthless": 0.9, "lost*": 0.5})
    assert grammar.score("You are a worthless idiot.") > 0.9
    assert grammar.score("He is not an idiot.") < 0.3 and grammar.score("They said that he is an idiot.") < 0.3
    assert grammar.score("I will kill you.") >= 0.3 > grammar.score("Bacteria kill yeast.")
    assert grammar.score("Not bad, but you idiot") >= 0.3 and grammar.score("LOSTER") >= 0.3
    assert grammar.score(None) == grammar.score("") == grammar.score("a" * 200_000) == 0


def test_the_composed_machine_equals_all_paths():
    """The best path against an enumeration of every path through the six transducers one after another."""
    machines = [toxicity._said_of(), toxicity._insults(), toxicity._threats(), toxicity._negation(), toxicity._reported(), toxicity._target()]
    draw = np.random.default_rng(2)
    words = ["idiot", "mild", "kill", "burn", "you", "him", "their", "they", "i", "we'll", "you'll", "will", "up", "not", "but", "said", '"', ",", "house"]
    grammar = toxicity.Grammar({"idiot": 0.9, "mild": 0.2})

    def through(read, k):
        if k == len(machines):
            yield read, 1.0
            return
        todo = [(machines[k].start, (), 1.0)]
        for symbol in read:
            todo = [(to, (*out, x), w * v) for state, out, w in todo for to, x, v in machines[k](state, symbol)]
        for state, out, w in todo:
            if state not in machines[k].owing:
                yield from ((found, w * v) for found, v in through(out, k + 1))

    for _ in range(60):
        text = " ".join(draw.choice(words, int(draw.integers(1, 6))))
        read = grammar.read(text)
        kinds = {tuple(x for x in out if x in toxicity.MATCHES) for out, _ in through(tuple(x for _, x, _ in read), 0)}
        found = tuple(x for _, x, _, _ in grammar.clause(text))
        assert found in kinds, text
        chance = {"AIMED": lambda p: 1 - (1 - p) ** 1.5, "LONE": lambda p: 0.0, "BARE": lambda p: 0.0}

        def evidence(out):
            # One match: its own weight is the path's, so the best is seen directly.
            return max((1 - chance.get(x, lambda p: p)(p) * w for (_, _, p), x in zip(read, out[0], strict=True) if x in toxicity.MATCHES for w in [out[1]]), default=1.0)

        if sum(x in toxicity.MATCHES for _, x, _ in read) == 1:
            best = max(1 - evidence(out) for out in through(tuple(x for _, x, _ in read), 0))
            (_, x, p, _), = grammar.clause(text)
            assert (0.0 if x in toxicity.ONCE else p) == pytest.approx(best), text


def test_clauses_are_read_whole():
    grammar = toxicity.Grammar({"idiot": 0.9})
    assert grammar.score("she said that " + "word " * 100 + "he is an idiot") < 0.3 <= grammar.score("word " * 100 + "he is an idiot")
    assert grammar.score("you are not exactly what i would ever call an idiot") < 0.3 <= grammar.score("No, you idiot")
    aimed = [x for _, x, _, _ in grammar.clause("idiot, you are")]
    assert aimed == ["AIMED"] and [x for _, x, _, _ in grammar.clause("idiot but you are")] == ["INSULT"]


def test_ends_alike_looks_at_the_whole_text():
    at = quality_ranker.FEATURES.index("ends_alike")
    text = " ".join([f"w{chr(97 + k)}{chr(98 + k)}" for k in range(20)] + [f"{k}zz" for k in range(500)]).encode()
    assert quality_ranker.features(text)[at] > 0.9 and quality_ranker.features(b"")[at] == 0


def test_threats_need_an_object():
    grammar = toxicity.Grammar({"trash": 0.6})
    for text in ("They beat the record.", "This will hang in his office with that picture", "He said that they burn wood", "She beat her rival", "I will beat the record", "the people burn wood", "they burn their waste"):
        assert grammar.score(text) < 0.3, text
    for text in ("I will kill you.", "I'll kill all of you", "You will burn", "you're going to hang", "We'll burn down their house", "Kill them!", "I am going to hurt her"):
        assert grammar.score(text) >= 0.3, text
    assert grammar.score("I will not kill you") < 0.3
    assert grammar.score("Bacteria kill yeast. " * 500) < 0.03
    again = toxicity.Grammar(toxicity.lexicon_of(toxicity.Grammar({"!kill": 0.1})))
    assert again.score("I will kill you") == pytest.approx(0.1) and again.score("I will hurt you") == pytest.approx(0.7)


def test_threat_weights_are_learned(spark):
    rows = [(i, f"text {i}, I beat him again" if i % 2 else f"you idiot {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, toxic int")
    grammar = toxicity.learn(docs, labels)
    assert grammar.threats["beat"] < 0.1 and grammar.threats["kill"] == pytest.approx(0.7)
    assert grammar.score("they beat him again") < 0.3 and grammar.score("I beat him again") < 0.3


def test_classifiers_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(awkward, toxicity.learn(awkward, labels)).count() == 9
    assert quality_ranker.score(awkward, quality_ranker.learn(awkward, labels)).where("score between 0 and 1").count() == 9
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0
    assert toxicity.reject(awkward, toxicity.Grammar({"one": 0.9})).columns == awkward.columns
    model = language_id.learn(awkward, most=10, rounds=1)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(awkward, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[7] == "fr"
    assert language_id.predict(empty, language_id.learn(empty)).count() == 0


def test_language_on_held_out_documents(spark):
    got = queries.op10_language_id(spark, SF).where("held_out").join(labelled(spark, "sf0.001")[0].select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.95


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces({b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aba": 4})
    p = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.3], [0.2, 0.1], [0.2, 0.3]])

    def brute(word, k):
        return 1.0 if not word else sum(p[i, k] * brute(word[len(x) :], k) for x, i in pieces.items() if word.startswith(x))

    words = [b"aba", b"a", b"abab", b"bbaab"]
    got = np.exp(language_id.Lattice(pieces, words).log_p(p))
    assert np.allclose(got, [[brute(w, k) for k in range(2)] for w in words])
    uses = language_id.Lattice(pieces, [b"ab"]).expected(p, np.ones((1, 2)))
    assert np.allclose(uses[2], p[2] / (p[2] + p[0] * p[1])) and np.allclose(uses[0], uses[1])


def test_only_letters_are_words():
    assert [language_id.words_of(t) for t in ("²", "½ Ⅷ 12", "été² Ab", None)] == [[], [], ["été", "ab"], []]
    pieces = language_id.Pieces({b"a": 0, b"b": 1, b" ": 2, b" aaaaaaaaaaaaaaa": 3})
    p = np.array([[0.5], [0.3], [0.1], [0.1]])
    got = language_id.Lattice(pieces, [b" " + b"a" * 15, b" " + b"ab" * 5000]).log_p(p)[:, 0]
    assert np.allclose(got, [np.log(0.1 * 0.5**15 + 0.1), np.log(0.1) + 5000 * np.log(0.15)])
    assert {x for x in language_id.read_vocabulary() if len(x) > 12}


QUESTION = "Then we see that John has 12 apples and Mary gives John 5 apples, so how many apples does John have?"


@pytest.mark.parametrize(("text", "found"), [
    (f"Well. {QUESTION} And so on.", True),
    ("Well. Then we see that Peter has 7 apples and Anna gives Peter 9 apples, so how many apples does Peter have?", True),
    ("Well. Then we see that Peter has 7 apples and Anna gives Robert 9 apples, so how many apples does Carl have?", False),
    ("Then we see that John has a dog.", False),
    ("", False),
])
def test_templates(spark, text, found):
    docs = spark.createDataFrame([(1, text, 2)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(9, QUESTION), (8, None), (7, "of the"), (None, "x y z w v")], "item_id long, text string")
    got = decontaminate.matches(docs, items).collect()
    assert [r.item_id for r in got] == ([9] if found else [])
    assert decontaminate.remove(docs, items).count() == (0 if found else 1)


def contains(item, text):
    return bool(decontaminate.Index([(1, item.encode())]).contained(decontaminate.Template(text.encode(), decontaminate._Kinds())))


def test_items_dense_in_slots_are_found():
    item = "What is the sum of 12, 15, 18, 21, 24, 27 and 30?"
    assert contains(item, f"Some text before it. {item} And some after it.")
    assert contains(item, "Some text. What is the sum of 5, 6, 7, 8, 9, 10 and 11? And some after it.")
    assert not contains(item, "The sums of 12, 15, 18, 21, 24, 27 or 33 were lower.")
    numbers = "7 9 12 15 18 21 24 27 30 31"
    assert contains(numbers, f"they wrote {numbers} down") and not contains(numbers, "they wrote 7 9 12 15 18 1 2 3 4 5 down")
    shop = "John has 12 apples, Mary 15 apples, Bob 7 pears, Ann 3 plums"
    assert contains(shop, f"so {shop}.") and contains(shop, "so Tom has 2 apples, Sue 4 apples, Max 5 pears, Pat 6 plums.")
    table = "see the table " + " ".join(str(k) for k in range(40))
    assert not contains(table, "see the table " + " ".join(str(k) for k in range(100, 140)))


def test_short_sentences_that_begin_with_names_are_found():
    item = "Tom has 3 dogs. Anna has 5 cats. Bob has 7 birds. How many animals do they have?"
    assert contains(item, "Well. Mary has 4 dogs. Peter has 6 cats. Carl has 9 birds. How many animals do they have?")
    assert not contains(item, "Mary has 4 dogs. Mary has 6 cats. Mary has 6 birds. They are happy with them.")


def test_repeated_windows_do_not_conflict():
    words = " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(40))
    item = f"{words} 40 percent of the students walk 25 percent of the students cycle home"
    assert contains(item, f"some text. {item} more text")
    assert contains(item, f"some text. {item.replace('25', '30')} more text")
    passage = " ".join(f"about {k % 7} percent of the people {'like' if k % 2 else 'see'} {k} birds there" for k in range(25))
    assert contains(passage, f"some text. {passage} more text")


def test_contained_items_are_found(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: " ".join(r.text.split()) for r in bench.collect()}
    want = {(d, i) for d, t in texts(docs).items() for i, x in items.items() if x in " ".join(t.split())}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert want <= got and len(got - want) <= 3
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == got


def test_decontamination_awkward(awkward, empty):
    bench = awkward.select(F.col("doc_id").alias("item_id"), "text").where("doc_id <> 4")
    assert decontaminate.remove(awkward, bench).count() == 9
    assert decontaminate.matches(awkward, empty.select(F.col("n").alias("item_id"), "text")).count() == 0
    assert decontaminate.matches(empty, bench).count() == 0


def test_pipeline(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = settle(stage(spark, at, SF))
        seen[name] = at
        if name != "sharding":
            assert at.columns == docs.columns
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in seen["toxicity"].collect()}
    assert len(lost & bad) <= 1
    want, _, _ = jaccard_components(texts(seen["toxicity"]), 5, 80)
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {d for d, (n, c) in want.items() if c == d or not n}
    assert set(texts(seen["mixing"])) == set(texts(seen["decontamination"]))
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert words(seen["mixing"]) == pytest.approx(1.5 * words(seen["decontamination"]), rel=0.02)
    check_shards(seen["sharding"].toPandas(), 40, seen["mixing"].count())


def test_pipeline_awkward(spark, awkward, empty):
    for at in (awkward, empty):
        n = at.count()
        for name, stage in corpus_pipeline.STAGES:
            columns, at = at.columns, settle(stage(spark, at, SF))
            assert name == "sharding" or at.columns == columns
        assert at.count() >= n


def test_mixing_repeats_no_more_rows_of_a_shared_id_than_are_due(spark):
    rows = [(1, f"word{i} " * (10 + i % 3), "a") for i in range(60)] + [(2, "other text here", "b")]
    docs = settle(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = corpus_pipeline.mix_sources(spark, docs, SF)
    words = F.size(F.split(F.trim("text"), " "))
    total, most = docs.agg(F.sum(words)).first()[0], got.agg(F.sum(words)).first()[0]
    assert abs(most - 1.5 * total) <= 5 and got.subtract(docs).count() == 0
