"""Quality classifier by Bradley-Terry pairwise ranking.

Every labelled document takes part in preference pairs (a document labelled 1 is preferred to one labelled 0): rows of
the rarer label are dealt to buckets of ``RIVALS``, each row of the other label meets all of one bucket. So pairs grow
with the labels. The score is linear in a document's features and learned by logistic loss on feature differences, in
Newton steps whose sums the tasks make; the threshold is the exact quantile of all labelled documents' scores at the
part of them that are labelled 0.

Features come from whole texts: case, symbols, marks, repetition, lines. Null text is like the empty one and gets a
score as any other. Rows with equal ids are rows of their own; other columns are never inputs.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.functions.ranks import quantiles_by, running_counts
from oddlens.llm.common import Batches, apart, byte_rows, settle

RIVALS = 16  # different rows of the rarer label that a row of the other label is compared with
BLOCK = 256  # rows of the other label that meet a bucket at once, about
CUT = 0.3  # the score at the threshold

FEATURES = ("upper", "symbols", "bars", "marks", "digits", "other", "repeated_next", "distinct", "distinct_3", "word_length", "log_words", "same_lines", "ends_alike", "wide_words")


def features(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n, bytes_ = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = max(1, int(bytes_.sum() - bytes_[[9, 10, 11, 12, 13, 32]].sum()))
    upper, lower = int(bytes_[65:91].sum()), int(bytes_[97:123].sum())
    symbols = int(bytes_[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 126]].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = [w[-2:] for w in words]
    return [
        upper / max(1, upper + lower),
        symbols / max(1, n),
        int(bytes_[124]) / max(1, n),
        int(bytes_[33]) / max(1, n),
        int(bytes_[48:58].sum()) / solid,
        (solid - upper - lower - symbols - int(bytes_[128:].sum())) / solid,
        sum(map(eq, words, words[1:])) / max(1, n - 1),
        len(set(words)) / max(1, n) ** 0.8,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2),
        min(solid / max(1, n), 30) / 10,
        float(np.log1p(n)) / 10,
        1 - len(set(lines)) / max(1, len(lines)),
        max(Counter(last).values(), default=0) / max(1, n),
        sum(len(w) > 24 for w in words) / max(1, n),
    ]


def _features(batches: Batches) -> Batches:
    for batch in batches:
        x = pa.array([features(t) for t in byte_rows(batch, "text")], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])


class Ranker:
    def __init__(self, centre: np.ndarray, scale: np.ndarray, weight: np.ndarray, threshold: float, spread: float):
        self.centre, self.scale, self.weight, self.threshold, self.spread = centre, scale, weight, threshold, spread

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, CUT at the threshold."""
        z = (self.raw(x) - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, x): the features of every labelled document, a settled table. Texts stay where they are; only features meet the labels."""
    labels = settle(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")))
    some, _ = apart(docs.select("doc_id", "text"), labels.select("doc_id"), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return settle(some.mapInArrow(_features, f"doc_id {kind}, x array<double>").join(labels, "doc_id").select("label", "x"))


def _matrix(column: pa.ListScalar) -> np.ndarray:
    return column.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def blocks(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(x, n, rivals, m): rows of the commoner label with the bucket of the rarer one that they meet, a settled table. ``n`` and ``m`` say how often a row is there."""
    rare, many = (1, 0) if good < bad else (0, 1)
    each = settle(rows.where(F.col("label").isin(0, 1)).groupBy("label", "x").agg(F.count("*").alias("n")).withColumn("v", F.xxhash64("x")))
    place = running_counts(each.where(F.col("label") == rare).select(F.lit(0).alias("j"), "v").groupBy("j", "v").agg(F.count("*").alias("n"))).select("v", F.expr(f"(upto - 1) div {RIVALS}").alias("bucket"))
    sizes = {r.label: r.n for r in each.groupBy("label").agg(F.count("*").alias("n")).collect()}
    buckets = -(-sizes[rare] // RIVALS)
    split = max(1, -(-sizes[many] // (buckets * BLOCK)))
    rivals = each.where(F.col("label") == rare).join(place, "v").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("r")).select("bucket", F.col("r.x").alias("rivals"), F.col("r.n").alias("m"))
    dealt = each.where(F.col("label") == many).select("x", "n", F.pmod("v", F.lit(buckets)).alias("bucket"), F.pmod(F.xxhash64("v"), F.lit(split)).alias("part"))
    mine = dealt.groupBy("bucket", "part").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("r"))
    return settle(mine.join(rivals, "bucket").select(F.col("r.x").alias("x"), F.col("r.n").alias("n"), "rivals", "m"))


def _sums(batches: Batches, centre: np.ndarray, scale: np.ndarray, weight: np.ndarray, sign: int) -> Batches:
    """A task's number of pairs, and its sums of the logistic loss's gradient and curve at ``weight``."""
    pairs, gradient, curve = 0.0, np.zeros(len(weight)), np.zeros((len(weight), len(weight)))
    for batch in batches:
        for i in range(batch.num_rows):
            a, b = (np.clip((_matrix(batch.column(c)[i]) - centre) / scale, -8, 8) for c in ("x", "rivals"))
            n, m = (batch.column(c)[i].values.to_numpy() for c in ("n", "m"))
            for k in range(0, len(a), BLOCK):
                difference = (sign * (a[k : k + BLOCK, None] - b[None])).reshape(-1, len(weight))
                often = np.outer(n[k : k + BLOCK], m).ravel()
                p = 1 / (1 + np.exp(np.clip(difference @ weight, -40, 40)))
                pairs += float(often.sum())
                gradient += difference.T @ (often * p)
                curve += (difference * (often * p * (1 - p))[:, None]).T @ difference
    yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([np.concatenate([gradient, curve.ravel()])], pa.list_(pa.float64()))], ["pairs", "sums"])


def _raws(batches: Batches, ranker: Ranker) -> Batches:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array(ranker.raw(x))], ["raw"])


def learn(docs: DataFrame, labels: DataFrame) -> Ranker:
    """From all of ``labels`` (doc_id, quality 0/1) that ``docs`` have; the driver gets sums only."""
    rows, d = labelled(docs, labels), len(FEATURES)
    total, bad, good = rows.agg(F.count("*"), F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    if not total:
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    each = rows.select(F.posexplode("x").alias("j", "v"))
    middle, spread = quantiles_by(each, [0.5]), {r.j: r.sd for r in each.groupBy("j").agg(F.stddev_pop("v").alias("sd")).collect()}
    centre, scale = np.array([middle[j][0] for j in range(d)]), np.array([spread[j] for j in range(d)]) + 1e-6
    weight = np.zeros(d)
    if good and bad:
        pairs = blocks(rows, good, bad)
        for _ in range(25):  # Newton steps on the logistic loss with a ridge
            made = pairs.mapInArrow(partial(_sums, centre=centre, scale=scale, weight=weight, sign=-1 if good < bad else 1), "pairs double, sums array<double>").collect()
            sums = np.sum([r.sums for r in made], 0) / sum(r.pairs for r in made)
            gradient, curve = sums[:d] - 1e-3 * weight, sums[d:].reshape(d, d) + 1e-3 * np.eye(d)
            step = np.linalg.solve(curve, gradient)
            weight = weight + step
            if np.abs(step).max() < 1e-8:
                break
    raws = settle(rows.mapInArrow(partial(_raws, ranker=Ranker(centre, scale, weight, 0.0, 1.0)), "raw double"))
    counts = running_counts(raws.select(F.lit(0).alias("j"), F.col("raw").alias("v")).groupBy("j", "v").agg(F.count("*").alias("n")))
    k = min(bad, total - 1)
    above, below = counts.agg(F.min(F.when(F.col("upto") > k, F.col("v"))), F.min(F.when(F.col("upto") >= max(1, k), F.col("v")))).first()
    return Ranker(centre, scale, weight, (above + below) / 2, max(raws.agg(F.stddev_pop("raw")).first()[0], 1e-6) / 2)


def _scored(batches: Batches, ranker: Ranker) -> Batches:
    for batch in batches:
        x = np.array([features(t) for t in byte_rows(batch, "text")], float).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranker.score(x))], ["doc_id", "score"])


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score (0 to 1) for each row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_scored, ranker=ranker), f"doc_id {kind}, score double")
