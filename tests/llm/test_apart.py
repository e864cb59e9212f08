"""Rows that stay are told from rows that may go without a shuffle of what they carry."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oddlens.llm import common, language_id, mixing, ngram_join, toxicity, url_filter


@pytest.mark.parametrize("bits", [15, 28])
def test_apart_misses_no_key(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "MOST_BITS", bits)
    keys = common.settle(spark.range(0, 9000, 3).select(F.col("id").cast("long").alias("doc_id"), F.lit("k").alias("bitmap")))
    rows = spark.range(9000).select(F.col("id").cast("int").alias("doc_id"), F.lit("x").alias("bitmap"), F.lit(1).alias("__other"))
    maybe, rest = common.apart(rows, keys, "doc_id")
    there, gone = ({r.doc_id for r in x.collect()} for x in (maybe, rest))
    assert there | gone == set(range(9000)) and not there & gone and set(range(0, 9000, 3)) <= there
    assert maybe.columns == rows.columns and len(there) < (9000 if bits == 15 else 3700)
    maybe, rest = common.apart(rows, common.settle(keys.limit(0)), "doc_id")
    assert maybe.isEmpty() and rest.count() == 9000


def test_keep_one_and_mix_repeat_what_they_should(spark):
    rows = [(i, f"{'abcdefgh'[i % 8]} word " * (i % 7 + 1) + f" tail {i % 40} and some more {i % 40} words here", f"s{i % 3}") for i in range(400)]
    rows += [(5, "wholly other words that share an id with five", "s2"), (None, "no id", None), (7, None, "s1"), (7, "", "s1"), (8, rows[8][1], "s2"), (8, rows[8][1], "s2")]
    docs = common.settle(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size long").repartition(3))
    kept = ngram_join.keep_one(docs)
    placed = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.components(docs).collect()}
    want = sum(1 for r in ngram_join.components(docs).collect() if r.doc_id is None or not r.n_shingles or r.doc_id == r.component_id)
    assert kept.count() == want and placed
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    have = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    due = Counter()
    for r in mixing.mix(docs, weights=(3, 1, 2), budget=1.5, least=1, most=2).collect():
        due[r.doc_id, r.source, r.size] += 1 + (r.taken > r.size)
    assert have == due


CLEAN = """the garbage truck|pig farmers feed the rat|retarded growth of the crystal|the circus clown|the people kill them with kindness|he was going to hang them on the wall
they shoot him a mail|you will burn the toast|You are an idiot, he said|you are not stupid|she said: "idiot"|nobody called him a fool|this garbage collector works in a parallel heap|his lazy evaluation of their trash
kill the process|they trash the room|a rat and a pig and a clown and garbage and trash in one text""".replace("\n", "|").split("|")
TOXIC = """you are an idiot|You stupid clown!|idiot!|you are such a pathetic loser|I will kill you|I will burn down their house|kill them all|you will burn in hell|he is a moron|you're worthless
clown, you know nothing|shut up, moron|we should hang them|somebody should shoot him|I'll destroy him|they are scum|you trash""".replace("\n", "|").split("|")


def test_clauses_not_words_are_scored():
    plain = toxicity.Grammar({w: toxicity.WEAK if w in toxicity.MILD else toxicity.PLAIN for w in toxicity.INSULTS})
    assert [t for t in CLEAN if plain.score(t) >= toxicity.THRESHOLD] == []
    assert [t for t in TOXIC if plain.score(t) < toxicity.THRESHOLD] == []


def test_clean_sentences_stay_clean_after_learning(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = toxicity.learn(docs, labels)
    shown = {w for w in learned.free}
    assert shown  # the labelled texts hold some words of the list by themselves
    rest = [t for t in CLEAN if not shown & set(t.lower().replace(",", "").split()) and learned.score(t) >= toxicity.THRESHOLD]
    assert rest == [] and [t for t in TOXIC if learned.score(t) < toxicity.THRESHOLD] == []


def test_url_probes_follow_the_hosts_lengths(tmp_path, monkeypatch):
    draw = np.random.default_rng(0)
    letters = "ab/"
    rules = {(f"h{k % 5}.com/" + "".join(draw.choice(list(letters), k)), bool(draw.integers(0, 2))) for k in range(400)}
    rules |= {("com/", False), ("x.h1.com/a", True)}
    array, strings, hosts = url_filter.build(sorted(rules))
    (tmp_path / "a").write_bytes(array)
    (tmp_path / "s").write_bytes(strings)
    monkeypatch.setattr(url_filter, "PROBES", 500)
    found = url_filter.Rules(str(tmp_path / "a"), str(tmp_path / "s"), hosts)
    names = [r for r, _ in sorted(rules)]
    urls = []
    for i in range(300):
        host, _, path = names[i].partition("/")
        urls.append((f"{'www.' if i % 2 else ''}{host}".encode(), ("/" + path + "".join(draw.choice(list(letters), 300))).encode()))
    urls += [(b"h1.com", b"/"), (b"x.h1.com", b"/a"), (b"h1.org", b"/a"), (b"", b""), (b"com", b"")]
    verdicts = {}
    for rule, allow in rules:
        verdicts[rule] = allow and verdicts.get(rule, True)

    def brute(host, path):
        fits = []
        for rule in verdicts:
            h, slash, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append(rule)
        best = min(fits, key=lambda r: (-len(r), r), default=None)
        return best and (best.encode(), verdicts[best])

    tracemalloc.start()
    got = found.find(urls)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [brute(h.decode(), p.decode()) for h, p in urls]
    assert peak < 2 << 20


def test_marks_stay_in_words():
    hindi = "हिन्दी में लिखा है"
    assert language_id.words_of(hindi) == hindi.split()
    assert language_id.words_of("été x²y ́ 3 naïve") == ["été", "x", "y", "naïve"]
