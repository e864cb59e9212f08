"""Detectors with seeded randomness: forests, projections, random subsets and banks.

Trees, projections and subsets are drawn from a numpy generator with the given seed over a sample that is chosen by
a seeded hash of the id, so reruns agree however the rows are partitioned. Trees are small arrays that travel with
the scoring function; leaf counts over all rows are aggregations.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.functions.ranks import smallest
from oddlens.operators.base import Detector
from oddlens.operators.linear import mapped, moments, sample
from oddlens.operators.neighbours import KNN, nearest
from oddlens.operators.registry import register_model
from oddlens.sources.scratch import settle


class Tree:
    """Splits as arrays: feature (-1 for a leaf), threshold, left, right, and each node's depth and size."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.depth, self.size = [], [], [], [], [], []

    def add(self, depth: int, size: int) -> int:
        for column, value in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.depth, depth), (self.size, size)):
            column.append(value)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, left: int, right: int) -> None:
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, left, right

    def frozen(self) -> Tree:
        for name in ("feature", "threshold", "left", "right", "depth", "size"):
            setattr(self, name, np.array(getattr(self, name)))
        return self

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            r, n = rows[inner], at[inner]
            at[inner] = np.where(x[r, self.feature[n]] <= self.threshold[n], self.left[n], self.right[n])
        return at


def grow(x: np.ndarray, draw: np.random.Generator, deepest: int, choose) -> Tree:
    """``choose(rows, draw)`` gives (feature, threshold), or None for a leaf."""
    tree = Tree()

    def node(rows: np.ndarray, depth: int) -> int:
        me = tree.add(depth, len(rows))
        cut = choose(rows, draw) if depth < deepest and len(rows) > 1 else None
        if cut is not None:
            below = rows[:, cut[0]] <= cut[1]
            tree.split(me, *cut, node(rows[below], depth + 1), node(rows[~below], depth + 1))
        return me

    node(x, 0)
    return tree.frozen()


def any_feature(rows, draw):
    lo, hi = rows.min(0), rows.max(0)
    open_ = np.flatnonzero(hi > lo)
    if not len(open_):
        return None
    j = int(draw.choice(open_))
    return j, float(draw.uniform(lo[j], hi[j]))


def by_range(rows, draw):
    lo, hi = rows.min(0), rows.max(0)
    span = hi - lo
    if span.sum() <= 0:
        return None
    j = int(draw.choice(len(span), p=span / span.sum()))
    return j, float(draw.uniform(lo[j], hi[j]))


def path_norm(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _isolation(x, trees, norm):
    depth = np.zeros(len(x))
    for t in trees:
        at = t.leaves(x)
        depth += t.depth[at] + np.array([path_norm(n) for n in t.size])[at]
    return 2 ** (-depth / len(trees) / norm)


class _Forest(Detector):
    def _sampled(self, train, most: int) -> tuple[np.ndarray, np.random.Generator]:
        return sample(train, most, self.random_state or 0)[1], np.random.default_rng(self.random_state or 0)


@register_model("core_iforest", "classical", "core")
class IForest(_Forest):
    """Isolation forest: 2 to the minus mean path length over its expectation."""

    @classmethod
    def defaults(cls):
        return {"n_estimators": 100, "max_samples": "auto", "max_features": 1.0, "bootstrap": False, "random_state": 0}

    def _fit(self, train):
        n = 256 if self.max_samples == "auto" else int(self.max_samples)
        x, draw = self._sampled(train, max(n * 16, 4096))
        n = min(n, len(x))
        self.trees = [grow(x[draw.choice(len(x), n, replace=self.bootstrap)], draw, max(1, int(np.ceil(np.log2(max(n, 2))))), any_feature) for _ in range(self.n_estimators)]
        self.norm = max(path_norm(n), 1e-12)

    def _score(self, rows):
        return mapped(rows, partial(_isolation, trees=self.trees, norm=self.norm))


def _shallow(x, trees):
    return sum(1 / (t.depth[t.leaves(x)] + 1) for t in trees) / len(trees)


@register_model("core_rrcf", "classical", "core")
class RRCF(_Forest):
    """Random cut trees, cut in proportion to a feature's range: mean 1 / (depth + 1)."""

    @classmethod
    def defaults(cls):
        return {"n_trees": 50, "max_samples": 256, "max_depth": None, "random_state": 0}

    def _fit(self, train):
        x, draw = self._sampled(train, max(self.max_samples * 16, 4096))
        n = min(self.max_samples, len(x))
        self.trees = [grow(x[draw.choice(len(x), n, replace=False)], draw, self.max_depth or 64, by_range) for _ in range(self.n_trees)]

    def _score(self, rows):
        return mapped(rows, partial(_shallow, trees=self.trees))


def _leaf_rows(batches, trees):
    for pdf in batches:
        if len(pdf):
            x = np.array(pdf["features"].tolist(), float)
            for k, t in enumerate(trees):
                leaf, n = np.unique(t.leaves(x), return_counts=True)
                yield pd.DataFrame({"tree": k, "leaf": leaf, "n": n})


def leaf_counts(rows: DataFrame, trees: list[Tree]) -> list[np.ndarray]:
    out = [np.zeros(len(t.feature)) for t in trees]
    for r in rows.mapInPandas(partial(_leaf_rows, trees=trees), "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        out[r.tree][r.leaf] = r.n
    return out


def _by_leaf(x, trees, costs):
    return sum(c[t.leaves(x)] for t, c in zip(trees, costs, strict=True)) / len(trees)


@register_model("core_extra_trees_density", "classical", "core")
class ExtraTreesDensity(_Forest):
    """Mean minus log density of a row's leaves; leaves that no training row reaches count one."""

    @classmethod
    def defaults(cls):
        return {"n_estimators": 50, "max_depth": 5, "min_samples_leaf": 1, "random_state": 0, "eps": 1e-12}

    def _fit(self, train):
        x, draw = self._sampled(train, 4096)
        self.trees = [grow(x, draw, self.max_depth, any_feature) for _ in range(self.n_estimators)]
        self.counts = leaf_counts(train, self.trees)

    def _score(self, rows):
        n = max(1, rows.count())
        return mapped(rows, partial(_by_leaf, trees=self.trees, costs=[-np.log(np.maximum(np.maximum(c, 1) / n, self.eps)) for c in self.counts]))


@register_model("core_hst", "classical", "core")
class HST(_Forest):
    """Half-space trees over the bounding box: mean 1 / (rows in the leaf + 1). ``merge`` adds rows as they come."""

    @classmethod
    def defaults(cls):
        return {"n_trees": 25, "max_depth": 10, "random_state": 0}

    def _fit(self, train):
        box = train.select(F.posexplode("features").alias("j", "v")).groupBy("j").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("j").collect()
        draw = np.random.default_rng(self.random_state or 0)
        self.trees = [self._halved(np.array([r.lo for r in box]), np.array([r.hi for r in box]), draw) for _ in range(self.n_trees)]
        self.counts = leaf_counts(train, self.trees)

    def _halved(self, lo, hi, draw) -> Tree:
        tree = Tree()

        def node(lo, hi, depth) -> int:
            me = tree.add(depth, 0)
            if depth < self.max_depth and (hi > lo).any():
                j = int(draw.choice(np.flatnonzero(hi > lo)))
                middle, up, down = (lo[j] + hi[j]) / 2, lo.copy(), hi.copy()
                down[j], up[j] = middle, middle
                tree.split(me, j, middle, node(lo, down, depth + 1), node(up, hi, depth + 1))
            return me

        node(lo, hi, 0)
        return tree.frozen()

    def merge(self, rows: DataFrame) -> None:
        self.counts = [a + b for a, b in zip(self.counts, leaf_counts(rows, self.trees), strict=True)]

    def _score(self, rows):
        return mapped(rows, partial(_by_leaf, trees=self.trees, costs=[1 / (c + 1) for c in self.counts]))


def _cut_counts(batches, cuts, lo, hi, bins):
    out = np.zeros((cuts.shape[1], bins))
    for pdf in batches:
        if len(pdf):
            at = _cut_bins(np.array(pdf["features"].tolist(), float), cuts, lo, hi, bins)
            for k in range(cuts.shape[1]):
                out[k] += np.bincount(at[:, k], minlength=bins)
    yield pd.DataFrame({"n": [out.ravel().tolist()]})


def _cut_bins(x, cuts, lo, hi, bins):
    return np.clip(np.floor((x @ cuts - lo) / np.maximum(hi - lo, 1e-300) * bins), 0, bins - 1).astype(int)


def _cut_cost(x, cuts, lo, hi, bins, cost):
    at = _cut_bins(x, cuts, lo, hi, bins)
    return cost[np.arange(cuts.shape[1]), at].mean(1) / cuts.shape[1]


def _cut_range(batches, cuts):
    lo = hi = None
    for pdf in batches:
        if len(pdf):
            y = np.array(pdf["features"].tolist(), float) @ cuts
            lo, hi = (y.min(0), y.max(0)) if lo is None else (np.minimum(lo, y.min(0)), np.maximum(hi, y.max(0)))
    if lo is not None:
        yield pd.DataFrame({"lo": [lo.tolist()], "hi": [hi.tolist()]})


@register_model("core_loda", "classical", "core")
class LODA(Detector):
    """Histograms of sparse random projections, each of about sqrt(d) features."""

    @classmethod
    def defaults(cls):
        return {"n_bins": 10, "n_random_cuts": 100, "random_state": 0}

    def _fit(self, train):
        draw, d = np.random.default_rng(self.random_state or 0), self.n_features
        cuts = draw.normal(size=(d, self.n_random_cuts))
        for k in range(self.n_random_cuts):
            cuts[draw.permutation(d)[max(1, int(np.sqrt(d))) :], k] = 0
        ends = train.mapInPandas(partial(_cut_range, cuts=cuts), "lo array<double>, hi array<double>").collect()  # one row a task
        lo, hi = np.min([r.lo for r in ends], 0), np.max([r.hi for r in ends], 0)
        counts = sum(np.array(r.n) for r in train.mapInPandas(partial(_cut_counts, cuts=cuts, lo=lo, hi=hi, bins=self.n_bins), "n array<double>").toLocalIterator()).reshape(-1, self.n_bins) + 1e-12
        self.how = {"cuts": cuts, "lo": lo, "hi": hi, "bins": self.n_bins, "cost": -np.log(counts / counts.sum(1, keepdims=True))}

    def _score(self, rows):
        return mapped(rows, partial(_cut_cost, **self.how))


def _project(batches, axes):
    for pdf in batches:
        x = np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1)
        yield pd.DataFrame({"id": pdf["id"], "features": list(x @ axes) if len(x) else []})


@register_model("core_random_projection_knn", "classical", "core", "neighbors")
class RandomProjectionKNN(KNN):
    """KNN after a Gaussian random projection."""

    @classmethod
    def defaults(cls):
        return {"n_components": 0.5, "random_state": 0, "n_neighbors": 5, "method": "largest", "metric": "minkowski", "p": 2}

    @property
    def width(self) -> int:
        return max(1, int(round(self.n_components * self.n_features)) if self.n_components < 1 else int(self.n_components))

    def _prepare(self, rows):
        axes = np.random.default_rng(self.random_state or 0).normal(size=(self.n_features, self.width)) / np.sqrt(self.width)
        return rows.mapInPandas(partial(_project, axes=axes), f"id {rows.schema['id'].dataType.simpleString()}, features array<double>")


class _Bank(Detector):
    """Distance to the nearest row of a bank chosen by a seeded hash; a training row that is in the bank takes its second nearest."""

    metric, p = "minkowski", 2

    def _keep(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, train):
        self.bank = settle(self._keep(train))

    def _train_scores(self, train):
        edges = nearest(train, self.bank, 1, self.n_features, True, self.metric, self.p)
        return train.select("id").join(edges.select("id", F.col("d").alias("score")), "id", "left").fillna(0.0, ["score"])

    def _score(self, rows):
        return nearest(rows, self.bank, 1, self.n_features, False, self.metric, self.p).select("id", F.col("d").alias("score"))


def _by_hash(rows: DataFrame, most: int, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)


@register_model("core_sampling", "classical", "core")
class Sampling(_Bank):
    """Distance to the nearest of a small random subset."""

    @classmethod
    def defaults(cls):
        return {"subset_size": 20, "metric": "minkowski", "p": 2, "random_state": 0}

    def _keep(self, rows):
        return _by_hash(rows, self.subset_size, self.random_state or 0)

    def _train_scores(self, train):
        return self._score(train)


@register_model("core_patchcore_lite", "classical", "core", "neighbors")
class PatchCoreLite(_Bank):
    """A random coreset as memory bank."""

    @classmethod
    def defaults(cls):
        return {"coreset_ratio": 0.2, "metric": "minkowski", "p": 2, "random_state": 0}

    def _keep(self, rows):
        order = F.xxhash64("id", F.lit(self.random_state or 0))
        return rows.where(order <= F.lit(smallest(rows, order, max(1, int(np.ceil(self.coreset_ratio * rows.count()))))))


@register_model("core_patchcore_online", "classical", "core", "neighbors")
class PatchCoreOnline(_Bank):
    """All rows up to max_bank_size as memory bank; ``partial_fit`` adds rows and cuts it again."""

    @classmethod
    def defaults(cls):
        return {"metric": "minkowski", "p": 2, "max_bank_size": 10000, "random_state": 0}

    def _keep(self, rows):
        return _by_hash(rows, self.max_bank_size, self.random_state or 0)

    def partial_fit(self, rows: DataFrame) -> PatchCoreOnline:
        self.bank = settle(self._keep(self.bank.union(rows.select("id", "features"))))
        return self


def _hyperspheres(x, centres, radii, next_to):
    out = np.zeros(len(x))
    for c, r, nn in zip(centres, radii, next_to, strict=True):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        inside = np.where(d <= r[None], r[None], np.inf)
        best = inside.argmin(1)
        out += np.where(np.isfinite(inside.min(1)), 1 - r[nn[best]] / np.maximum(r[best], 1e-300), 1.0)
    return out / len(centres)


@register_model("core_inne", "classical", "core")
class INNE(_Forest):
    """Isolation by nearest-neighbour hyperspheres."""

    @classmethod
    def defaults(cls):
        return {"n_estimators": 200, "max_samples": "auto", "random_state": 0}

    def _fit(self, train):
        x, draw = self._sampled(train, 8192)
        size = min(len(x), 8 if self.max_samples == "auto" else int(self.max_samples))
        self.centres, self.radii, self.next_to = [], [], []
        for _ in range(self.n_estimators):
            c = x[draw.choice(len(x), size, replace=False)]
            d = ((c[:, None] - c[None]) ** 2).sum(-1) + np.where(np.eye(size, dtype=bool), np.inf, 0)
            self.centres.append(c)
            self.radii.append(d.min(1) if size > 1 else np.ones(1))
            self.next_to.append(d.argmin(1))

    def _score(self, rows):
        return mapped(rows, partial(_hyperspheres, centres=self.centres, radii=self.radii, next_to=self.next_to))


def _network(x, centre, scale, layers):
    a = (x - centre) / scale
    for k, (w, b) in enumerate(layers):
        a = a @ w + b
        if k < len(layers) - 1:
            a = np.maximum(a, 0)
    return a


def _network_error(x, centre, scale, layers):
    return (((x - centre) / scale - _network(x, centre, scale, layers)) ** 2).mean(1)


def _to_centre(x, centre, scale, layers, target):
    return ((_network(x, centre, scale, layers) - target) ** 2).sum(1)


def train_network(x, goal, widths, epochs, rate, batch, draw, bias=True):
    """Plain numpy Adam on a ReLU network with squared error; ``goal`` None: outputs are drawn to their first mean."""
    layers = [[draw.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(widths[:-1], widths[1:], strict=True)]
    one = [[np.zeros_like(p) for p in layer] for layer in layers]
    two, step, target = [[np.zeros_like(p) for p in layer] for layer in layers], 0, None
    for _ in range(epochs):
        for at in np.array_split(draw.permutation(len(x)), max(1, len(x) // batch)):
            acts = [x[at]]
            for k, (w, b) in enumerate(layers):
                z = acts[-1] @ w + b
                acts.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
            if goal is None and target is None:
                target = acts[-1].mean(0)
                target = np.where(np.abs(target) < 0.1, np.where(target < 0, -0.1, 0.1), target)
            grad = 2 * (acts[-1] - (goal[at] if goal is not None else target)) / len(at)
            step += 1
            for k in range(len(layers) - 1, -1, -1):
                grads = [acts[k].T @ grad, grad.sum(0) * bias]
                grad = (grad @ layers[k][0].T) * (acts[k] > 0)
                for p, g in enumerate(grads):
                    one[k][p] = 0.9 * one[k][p] + 0.1 * g
                    two[k][p] = 0.999 * two[k][p] + 0.001 * g * g
                    layers[k][p] -= rate * (one[k][p] / (1 - 0.9**step)) / (np.sqrt(two[k][p] / (1 - 0.999**step)) + 1e-8)
    return [tuple(layer) for layer in layers], target


@register_model("core_torch_autoencoder", "classical", "core")
class Autoencoder(_Forest):
    """Mean squared error of a small autoencoder, learned in numpy on a seeded sample."""

    @classmethod
    def defaults(cls):
        return {"hidden_dims": (64, 32), "epochs": 30, "batch_size": 64, "lr": 1e-3, "preprocessing": True, "random_state": 0}

    def _scaled(self, train):
        _, mean, cov = moments(train)
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        return (mean, np.where(sd > 0, sd, 1.0)) if self.preprocessing else (np.zeros_like(mean), np.ones_like(mean))

    def _fit(self, train):
        x, draw = self._sampled(train, 4096)
        centre, scale = self._scaled(train)
        hidden = list(self.hidden_dims)
        z = (x - centre) / scale
        layers, _ = train_network(z, z, [x.shape[1], *hidden, *hidden[-2::-1], x.shape[1]], self.epochs, self.lr, self.batch_size, draw)
        self.how = {"centre": centre, "scale": scale, "layers": layers}

    def _score(self, rows):
        return mapped(rows, partial(_network_error, **self.how))


@register_model("core_deep_svdd", "classical", "core")
class DeepSVDD(Autoencoder):
    """Squared distance to the centre of a network's outputs, learned in numpy on a seeded sample."""

    @classmethod
    def defaults(cls):
        return {"hidden_neurons": (64, 32), "epochs": 30, "batch_size": 32, "lr": 1e-3, "preprocessing": True, "random_state": 0}

    def _fit(self, train):
        x, draw = self._sampled(train, 4096)
        centre, scale = self._scaled(train)
        layers, target = train_network((x - centre) / scale, None, [x.shape[1], *self.hidden_neurons], self.epochs, self.lr, self.batch_size, draw, bias=False)
        self.how = {"centre": centre, "scale": scale, "layers": layers, "target": target}

    def _score(self, rows):
        return mapped(rows, partial(_to_centre, **self.how))
