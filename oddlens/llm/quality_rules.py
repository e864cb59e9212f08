"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that a text must meet. Its cost (seconds for each row) and selectivity (rows it rejects)
are measured on a sample, and the rules are put in the order of rejection per cost; a CASE then stops at the first
rule that rejects a text, so dear rules only see what cheap ones leave. The order never changes which texts are
kept, only what they cost; ``failed_rule`` names the first rule of that order that rejects a text.

Null text is like the empty one: no words, no lines, rejected by the base. Rows with equal ids are rows of their
own. All figures are of whole texts; the sort of a text's 3-word windows is the largest thing held for a row.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 300  # rows that costs are measured on, about
EVALUATIONS, MORE, MOST = 1000, 16, 1_000_000  # of each rule for its cost: at first, times as many again, at most
CLEAR = 0.02  # seconds that a rule must take beyond the empty one
SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window which is found twice or more."""

    def marked(s: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.sort_array(grams), lambda s: let(marked(s), covered)))


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base figures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce("text", F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("rep")))
    bare = F.length(F.translate(text, SPACE, ""))
    out = docs.select("doc_id", text.alias("text"), of_words.alias("w"), lines.alias("l"), bare.alias("chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("symbols"))
    as_long = {"n_words": "w.n", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "l.dup", "n_repeat_words": "w.rep", "n_lines": "l.n"}
    return out.select("doc_id", "text", *(F.col(c).cast("long").alias(name) for name, c in as_long.items()))


@dataclass(frozen=True)
class Rule:
    """``passes``: what a text that stays meets, over the columns of ``figures``."""

    name: str
    passes: Column


def _share(pattern: str) -> Column:
    """Part of a text's characters outside white space that match."""
    return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))) / F.greatest(F.col("word_chars"), F.lit(1))


def default_rules() -> list[Rule]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("word_length", (F.col("word_chars") >= 2 * n) & (F.col("word_chars") <= 15 * n)),
        Rule("symbols", 10 * F.col("n_symbols") <= n),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") <= 3 * F.col("n_lines")),
        Rule("upper_case", _share(r"\p{Lu}") <= 0.4),
        Rule("letters", _share(r"\p{L}") >= 0.6),
        Rule("digits", _share(r"\p{Nd}") <= 0.25),
        Rule("exclamations", _share("!") <= 0.05),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def order(rules: list[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """``measured``: rule -> (cost, part rejected). Most rejection per cost first; ties by cost, then by name."""
    return sorted(rules, key=lambda r: (-measured[r.name][1] / max(measured[r.name][0], 1e-12), measured[r.name][0], r.name))


def measure(sample: DataFrame, rules: list[Rule]) -> dict[str, tuple[float, float]]:
    """Seconds and part rejected of each rule over ``sample``, which holds ``figures`` and is best kept in memory.

    A row judges itself so many times within one expression, so nothing is copied. The time of the same job with an
    empty rule is taken off; a rule that isn't CLEAR of it, and of how much the empty one varies, is judged MORE times
    as often, up to MOST evaluations, so that cheap rules have a cost too. Costs are rounded to powers of two, as they
    vary from run to run. Selectivity is of the rows that pass the base.
    """
    n = max(1, sample.count())
    able = sample.where(~base_failed())
    held = max(1, able.count())
    idle: dict[int, tuple[float, float]] = {}

    def run(passes: Column, times: int, runs: int) -> tuple[list[float], int]:
        often = F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.lit(0).cast("long"), lambda a, i: a + F.when(passes & (i > 0), 0).otherwise(1))
        job = able.agg(F.sum(often).alias("x"))
        rejected = job.first()[0] or 0  # compiles
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return took, rejected

    def empty(times: int) -> tuple[float, float]:
        if times not in idle:
            took, _ = run(F.col("n_words") >= 0, times, 3)
            idle[times] = min(took), max(took) - min(took)
        return idle[times]

    out = {}
    for rule in rules:
        times = max(1, EVALUATIONS // held)
        while True:
            (took,), rejected = run(rule.passes, times, 1)
            rest, noise = empty(times)
            if took - rest > max(CLEAR, 2 * noise) or times * held * MORE > MOST:
                break
            times *= MORE
        cost = max(took - rest, rest / 100, 1e-6) / times / n
        out[rule.name] = (2.0 ** round(math.log2(cost)), rejected / times / n)
    return out


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, failed_rule (null if kept) for each row of ``docs`` (doc_id, text)."""
    rules = rules or default_rules()
    part = min(1.0, sample / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("cost")), F.lit(1_000_000)) < F.lit(part * 1_000_000)
    some = figures(docs.where(chosen)).persist()
    try:
        ordered = order(rules, measure(some, rules))
    finally:
        some.unpersist()
    failed = F.when(base_failed(), F.lit("base"))
    for rule in ordered:
        failed = failed.when(~F.coalesce(rule.passes, F.lit(True)), F.lit(rule.name))
    out = figures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), failed.alias("failed_rule"))
    return out.withColumn("kept", F.col("failed_rule").isNull())
