"""Spelling variants by anagram hashing: a word's key is the sum of its letters' fifth powers.

One inserted, deleted or replaced letter changes the key by a letter's value or by the difference of two. Instead of
trying every value, each word offers its key less each of its letters: two words that differ by a replaced letter have
such a *reduced* key in common, two that differ by an inserted one share the key of the shorter. Equal keys only say
that the letters are the same; as many words are anagrams of each other, the join also asks for an equal first or last
half of the letters that are in common: wherever the edit lies, one of these halves is the same in both words. Letter
order is then verified by the edit distance, so the pairs are exact. Of the rows of a key no pairs are made but those
with an equal half, and none of two whole keys (anagrams are no near words).

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, only A-Z lower-cased. Tasks count the words of their documents
before anything is shuffled. Null text has no words; a null doc_id is written as nothing where it is part of a hash.
A row that repeats counts again. Extra columns are ignored. No words give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import Batches, discard, settle, slices

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
COUNTED = 100_000  # words that a task counts before it sends its counts on
VALUES = {chr(c): (i + 1) ** 5 for i, c in enumerate([*range(0x61, 0x7B), *range(0xC0, 0x100)])}

Damage = Callable[[object, str], str]


def drop_letter(doc_id: object, run: str, every: int = 31) -> str:
    """The run without one letter where ``every`` divides the CRC-32 of ``doc_id:run``; which one, the CRC says too."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Batches, least: int, damage: Damage | None) -> Batches:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return made

    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for run, n in Counter(RUN.findall((text or b"").lower().decode())).items():
                if len(run) >= least:
                    word = damage(doc_id, run) if damage else run
                    if len(word) >= least:
                        counts[word] += n
                        if len(counts) >= COUNTED:
                            yield out()
    if counts:
        yield out()


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: Damage | None = None) -> DataFrame:
    """(word, n) of the words with so many letters that occur so often."""
    counts = docs.select("doc_id", "text").mapInArrow(partial(_counted, least=least_letters, damage=damage), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def offers(word: str) -> list[tuple[int, int, bool, int]]:
    """(key, hash of a half, whether the key is reduced, letters in the half) of a word.

    A key stands for some letters in common; half of their number, rounded down, come first or last in both words.
    A first half is only offered for letters that can be removed behind it, a last half before it.
    """
    n, out = len(word), []
    whole = sum(map(VALUES.__getitem__, word))

    def halves(length: int) -> tuple[int, int, int]:
        h = length // 2
        return h, xxhash.xxh64_intdigest("<" + word[:h]) >> 1, xxhash.xxh64_intdigest(">" + word[n - h :]) >> 1

    h, first, last = halves(n)
    out += [(whole, first, False, h), (whole, last, False, h)]
    h, first, last = halves(n - 1)
    out += [(whole - VALUES[c], first, True, h) for c in dict.fromkeys(word[h:])]
    return out + [(whole - VALUES[c], last, True, h) for c in dict.fromkeys(word[: n - h])]


def _offered(batches: Batches) -> Batches:
    names = ["key", "half", "reduced", "h", "word"]
    for batch in slices(batches, 1 << 18):
        rows = [(*offer, word) for word in batch.column("word").to_pylist() for offer in offers(word)]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()), strict=True)], names)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) with a < b: the pairs of distinct words that one inserted, deleted or replaced letter tells apart, each once."""
    rows = words.select("word").mapInArrow(_offered, "key long, half long, reduced boolean, h int, word string")
    a, b = rows.select("key", "half", *(F.col(c).alias(f"{c}_a") for c in ("reduced", "h", "word"))), rows.select("key", "half", *(F.col(c).alias(f"{c}_b") for c in ("reduced", "h", "word")))
    pairs = a.join(b.hint("merge"), ["key", "half"]).where("(reduced_a OR reduced_b) AND word_a < word_b")
    pairs = pairs.where("abs(length(word_a) - length(word_b)) <= 1").where(F.levenshtein("word_a", "word_b", 1) == 1)
    return pairs.select(F.col("word_a").alias("a"), F.col("word_b").alias("b")).distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n; words are distinct).

    A word's form is its near word of largest n (ties: smallest by code points), if that is ``ratio`` times the word's
    n at least. The root is the last word on the way along forms; each step multiplies n, so the ways are short.
    All joins are merges: tables of words grow with the texts and, as compressed files, look small enough to be broadcast.
    """
    words = settle(words)
    pairs = settle(near_pairs(words))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")).hint("merge"), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b"))).alias("best"))
    found = words.join(best.hint("merge"), "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    found = settle(found.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
    step = settle(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps that a row stands for
        further = settle(step.join(step.toDF("root", "next").hint("merge"), "root", "left").select("word", "root", "next"))
        discard(step)
        if further.where("next IS NOT NULL").isEmpty():
            break
        step = settle(further.select("word", F.coalesce("next", "root").alias("root")))
        discard(further)
    roots = further.select("word", "root")
    discard(pairs, words)
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
