"""Detectors from moments: covariance, principal components, Gaussian mixtures, one-class kernels.

Means and second moments are summed by the tasks (one Arrow pass, one small matrix for each task); the driver only
does the linear algebra of n_features x n_features matrices. Scoring is an Arrow map with the fitted arrays.
Robust covariance and the one-class SVM start from a seeded hash sample of at most SAMPLE rows and go on over all rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.functions.ranks import quantile, smallest
from oddlens.functions.vectors import unit
from oddlens.operators.base import Detector, matrix
from oddlens.operators.metric_join import in_steps
from oddlens.operators.registry import register_model
from oddlens.sources.scratch import discard, settle

SAMPLE = 4000


def vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The features of a batch as a matrix."""
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _sums(batches, origin: np.ndarray, keep=None):
    n, s, q = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            x = vectors(batch)
            x = (x if keep is None else x[keep(x)]) - origin
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], ["n", "s", "q"])


GATHERED = 64 << 20  # bytes of tasks' sums that the driver holds at once


def one_a_task(sums: DataFrame, numbers: int):
    """Rows of sums, one of so many numbers for each task: all at once where they are small (iterating runs the tasks one after another)."""
    return sums.collect() if sums.rdd.getNumPartitions() * numbers * 8 <= GATHERED else sums.toLocalIterator(prefetchPartitions=True)


def moments(rows: DataFrame, origin: np.ndarray | None = None, keep=None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean, and population covariance of those that ``keep`` (of a matrix of rows) leaves; ``origin`` (the first row) is taken off first, for precision."""
    origin = np.array(rows.first().features, float) if origin is None else origin
    n, s, q = 0, 0.0, 0.0
    for r in one_a_task(rows.select("features").mapInArrow(partial(_sums, origin=origin, keep=keep), "n long, s array<double>, q array<double>"), len(origin) * (len(origin) + 1) + 1):
        n, s, q = n + r.n, s + np.array(r.s), q + np.array(r.q).reshape(len(r.s), -1)
    mean = s / n
    return n, origin + mean, q / n - np.outer(mean, mean)


def sample(rows: DataFrame, most: int = SAMPLE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, features) of all rows, or of the ``most`` with the smallest seeded hash."""
    hashed, n = F.xxhash64("id", F.lit(seed)), rows.count()
    if n > 4 * most:  # about twice as many as are wanted reach the sort; some more, should that ever be too few
        part = rows.where(F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * 2 * most / n) + 1)
        rows = part if part.count() >= most else rows
    got = rows.orderBy(hashed, "id").limit(most)
    return matrix(got, most)


def _apply(batches, score):
    for batch in batches:
        found = np.asarray(score(vectors(batch)), float) if batch.num_rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], ["id", "score"])


def mapped(rows: DataFrame, score) -> DataFrame:
    """(id, score) by ``score``, a function of a matrix of rows."""
    return rows.select("id", "features").mapInArrow(partial(_apply, score=score), f"id {rows.schema['id'].dataType.simpleString()}, score double")


def quadratic(x, mean, precision):
    d = x - mean
    return ((d @ precision) * d).sum(1)


def _within(x, mean, precision, cut):
    return quadratic(x, mean, precision) <= cut


class _Gaussian(Detector):
    def _set(self, mean: np.ndarray, covariance: np.ndarray) -> None:
        self.mean_vector, self.precision = mean, np.linalg.pinv(covariance)

    def _score(self, rows):
        return mapped(rows, partial(quadratic, mean=self.mean_vector, precision=self.precision))


@register_model("core_mahalanobis", "classical", "core")
class Mahalanobis(_Gaussian):
    """Squared Mahalanobis distance; sample covariance with ``reg`` on the diagonal."""

    @classmethod
    def defaults(cls):
        return {"reg": 1e-6, "max_features": 4096}

    def _fit(self, train):
        if self.n_features > self.max_features:
            raise ValueError("too many features")
        n, mean, cov = moments(train)
        self._set(mean, cov * n / max(1, n - 1) + self.reg * np.eye(len(mean)))


def _fourth(batches, mean):
    total = 0.0
    for pdf in batches:
        if len(pdf):
            x = np.array(pdf["features"].tolist(), float) - mean
            total += float(((x * x).sum(1) ** 2).sum())
    yield pd.DataFrame({"t": [total]})


def shrunk(train: DataFrame, centred: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mean and Ledoit-Wolf covariance. The mean sum of fourth powers takes a second pass."""
    n, mean, cov = moments(train)
    if centred:
        cov, mean = cov + np.outer(mean, mean), np.zeros_like(mean)
    fourth = train.mapInPandas(partial(_fourth, mean=mean), "t double").agg(F.sum("t")).first()[0]
    d = len(mean)
    mu = np.trace(cov) / d
    spread = (cov**2).sum()
    beta = (fourth / n - spread) / (d * n)
    delta = (spread - 2 * mu * np.trace(cov) + d * mu**2) / d
    part = 0.0 if delta == 0 else min(beta, delta) / delta
    return mean, (1 - part) * cov + part * mu * np.eye(d)


@register_model("core_mahalanobis_shrinkage", "classical", "core")
class MahalanobisShrinkage(_Gaussian):
    """Squared Mahalanobis distance under the Ledoit-Wolf covariance."""

    @classmethod
    def defaults(cls):
        return {"assume_centered": False}

    def _fit(self, train):
        self._set(*shrunk(train, self.assume_centered))


@register_model("core_cosine_mahalanobis", "classical", "core")
class CosineMahalanobis(MahalanobisShrinkage):
    """The same over rows scaled to length 1."""

    @classmethod
    def defaults(cls):
        return {"assume_centered": False, "normalize": True, "eps": 1e-12}

    def _unit(self, rows):
        return rows.select("id", unit(F.col("features"), self.eps).alias("features")) if self.normalize else rows

    def _fit(self, train):
        super()._fit(settle(self._unit(train)))

    def _score(self, rows):
        return super()._score(self._unit(rows))


def _covariance(x: np.ndarray, centred: bool) -> tuple[np.ndarray, np.ndarray]:
    mean = np.zeros(x.shape[1]) if centred else x.mean(0)
    return mean, (x - mean).T @ (x - mean) / len(x)


def concentrated(x: np.ndarray, h: int, centred: bool, seed: int, starts: int = 30, kept: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, covariance) of the ``kept`` subsets of ``h`` rows with the least determinants, by concentration steps from random subsets."""
    (n, d), found = x.shape, []
    draw = np.random.default_rng(seed)
    for _ in range(starts):
        mean, cov = _covariance(x[draw.choice(n, min(n, d + 1), replace=False)], centred)
        size = np.inf
        for _ in range(20):
            at = np.argsort(quadratic(x, mean, np.linalg.pinv(cov + RIDGE * np.eye(d))), kind="stable")[:h]
            mean, cov = _covariance(x[at], centred)
            last, size = size, np.linalg.slogdet(cov + RIDGE * np.eye(d))[1]
            if size >= last - 1e-12:
                break
        found.append((size, len(found), mean, cov))
    return [f[2:] for f in sorted(found, key=lambda f: f[:2])[:kept]]


RIDGE = 1e-9
HELD = 1 << 16  # values about a quantile that the driver sorts; more are counted by the tasks


def _placed(scores: DataFrame, h: int, n: int) -> float:
    """The h-th smallest of n scores: a sketch says between which two it lies, then it is found exactly among those."""
    low, high = scores.approxQuantile("score", [max(0.0, h / n - 2e-3), min(1.0, h / n + 2e-3)], 1e-3)
    s = F.col("score")
    below, between = scores.agg(F.count(F.when(s < low, 1)), F.count(F.when((s >= low) & (s <= high), 1))).first()
    if not below < h <= below + between or between > HELD:
        return smallest(scores, "score", h)
    some = scores.where((s >= low) & (s <= high)).toPandas()["score"].to_numpy()
    return float(np.partition(some, h - below - 1)[h - below - 1])


STEPS = 30  # concentration steps over all rows, at most


def robust_covariance(rows: DataFrame, support: float | None = None, centred: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Minimum covariance determinant over all rows, then one reweighting; also the log determinants of its steps.

    Random starts are concentrated on a seeded sample of at most SAMPLE rows, as a start needs few; the best three
    take a step over all rows and the best of these steps on until its determinant stays. A step is three jobs:
    distances by the covariance there is, their h-th smallest by running counts, moments of the rows up to it. A row at
    that very distance beyond the h-th also counts.
    """
    _, x = sample(rows, SAMPLE, seed)
    n, d = rows.count(), x.shape[1]
    h = min(n, int(np.ceil((support if support else (n + d + 1) / (2 * n)) * n)))

    inverse = lambda cov: np.linalg.pinv(cov + RIDGE * np.eye(d))

    def scored(mean, cov):
        return mapped(rows, partial(quadratic, mean=mean, precision=inverse(cov)))

    def upto(mean, cov, cut):
        _, m, c = moments(rows, mean, partial(_within, mean=mean, precision=inverse(cov), cut=float(cut)))
        return (np.zeros(d), c + np.outer(m, m)) if centred else (m, c)

    def step(mean, cov):
        held = settle(scored(mean, cov).select("score"))
        mean, cov = upto(mean, cov, _placed(held, h, n))
        discard(held)
        return np.linalg.slogdet(cov + RIDGE * np.eye(d))[1], mean, cov

    size, mean, cov = min((step(*start) for start in concentrated(x, min(len(x), int(np.ceil(h * len(x) / n))), centred, seed)), key=lambda s: s[0])
    sizes = [float(size)]
    for _ in range(STEPS):
        new, *moved = step(mean, cov)
        if new >= sizes[-1] - 1e-10:
            break
        (mean, cov), sizes = moved, [*sizes, float(new)]
    middle = d * (1 - 2 / (9 * d)) ** 3  # median of chi-squared
    cov = cov * quantile(scored(mean, cov), "score", 0.5) / middle + RIDGE * np.eye(d)
    cut = d * (1 - 2 / (9 * d) + 1.96 * np.sqrt(2 / (9 * d))) ** 3  # its 97.5 % quantile
    if scored(mean, cov).where(F.col("score") <= float(cut)).count() > d:
        mean, cov = upto(mean, cov, cut)
    return mean, cov, sizes


@register_model("core_mcd", "classical", "core")
class MCD(_Gaussian):
    """Squared Mahalanobis distance under the minimum-covariance-determinant estimate of all rows."""

    @classmethod
    def defaults(cls):
        return {"support_fraction": None, "random_state": 0, "assume_centered": False, "max_features": 4096}

    def _fit(self, train):
        mean, cov, self.log_determinants = robust_covariance(train, self.support_fraction, self.assume_centered, self.random_state or 0)
        self._set(mean, cov)


@register_model("core_elliptic_envelope", "classical", "core")
@register_model("core_padim_lite", "classical", "core")
class EllipticEnvelope(_Gaussian):
    """Robust covariance of all rows, or the plain one where ``robust`` is off or the robust fit fails."""

    @classmethod
    def defaults(cls):
        return {"robust": True, "support_fraction": None, "assume_centered": False, "random_state": 0}

    def _fit(self, train):
        if self.robust:
            try:
                self._set(*robust_covariance(train, self.support_fraction, self.assume_centered, self.random_state or 0)[:2])
                return
            except np.linalg.LinAlgError:
                pass
        _, mean, cov = moments(train)
        self._set(mean, cov)


class _Components(Detector):
    """Standardises, then keeps principal components; ``n_components`` may be a part of the variance."""

    def _components(self, train, standardise: bool, wanted):
        n, mean, cov = moments(train)
        self.centre = mean
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        self.scale = np.where(sd > 0, sd, 1.0) if standardise else np.ones(len(mean))
        values, vectors = np.linalg.eigh(cov / np.outer(self.scale, self.scale))
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        if wanted is None:
            k = min(n, len(values))
        elif 0 < wanted < 1:
            k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), wanted) + 1)
        else:
            k = int(wanted)
        self.values, self.axes, self.n_rows = values[: min(k, len(values))], vectors[:, : min(k, len(values))], n

    def _project(self, x):
        z = (x - self.centre) / self.scale
        return z, z @ self.axes


def _reconstruction(x, centre, scale, axes):
    z = (x - centre) / scale
    return ((z - z @ axes @ axes.T) ** 2).sum(1)


@register_model("core_pca", "classical", "core")
class PCA(_Components):
    """Squared reconstruction error."""

    @classmethod
    def defaults(cls):
        return {"n_components": None, "n_selected_components": None, "whiten": False, "weighted": True, "standardization": True, "random_state": None}

    def _fit(self, train):
        self._components(train, self.standardization, self.n_components)
        if self.n_selected_components:
            self.axes = self.axes[:, : self.n_selected_components]

    def _score(self, rows):
        return mapped(rows, partial(_reconstruction, centre=self.centre, scale=self.scale, axes=self.axes))


def _component_distance(x, centre, axes, spread):
    t = (x - centre) @ axes
    return (t * t / spread).sum(1)


@register_model("core_pca_md", "classical", "core")
class PCAMahalanobis(_Components):
    """Squared Mahalanobis distance among the leading components."""

    @classmethod
    def defaults(cls):
        return {"n_components": 0.95, "whiten": False, "reg": 1e-6, "random_state": None}

    def _fit(self, train):
        self._components(train, False, self.n_components)

    def _score(self, rows):
        spread = self.values * self.n_rows / max(1, self.n_rows - 1)
        spread = (np.ones_like(spread) if self.whiten else spread) + self.reg
        axes = self.axes / np.sqrt(np.maximum(self.values, 1e-300)) if self.whiten else self.axes
        return mapped(rows, partial(_component_distance, centre=self.centre, axes=axes, spread=spread))


def _residual(x, centre, scale, axes):
    return np.sqrt(_reconstruction(x, centre, scale, axes))


@register_model("core_studentized_residual", "classical", "core")
class StudentizedResidual(_Components):
    """Robust z-score of the residual's length."""

    @classmethod
    def defaults(cls):
        return {"n_components": 0.95, "eps": 1e-12, "clamp_zero": True, "random_state": None}

    def _fit(self, train):
        self._components(train, True, self.n_components)
        lengths = settle(self._lengths(train))
        self.med = quantile(lengths, "score", 0.5)
        self.mad = max(quantile(lengths, F.abs(F.col("score") - self.med), 0.5), self.eps)

    def _lengths(self, rows):
        return mapped(rows, partial(_residual, centre=self.centre, scale=self.scale, axes=self.axes))

    def _score(self, rows):
        z = 0.6745 * (F.col("score") - self.med) / self.mad
        return self._lengths(rows).select("id", (F.greatest(z, F.lit(0.0)) if self.clamp_zero else z).alias("score"))


def _cook(x, centre, scale, axes, inverse, eps):
    z = (x - centre) / scale
    t = z @ axes
    h = np.clip(np.einsum("ij,jk,ik->i", t, inverse, t), 0, 1 - 1e-9)
    return ((z - t @ axes.T) ** 2).sum(1) * h / np.maximum((1 - h) ** 2, eps)


@register_model("core_cook_distance", "classical", "core")
class CookDistance(_Components):
    """Residual squared times leverage / (1 - leverage) squared; the leverage is that of the batch being scored."""

    @classmethod
    def defaults(cls):
        return {"n_components": 0.95, "ridge": 1e-6, "eps": 1e-12, "random_state": None}

    def _fit(self, train):
        self._components(train, True, self.n_components)

    def _score(self, rows):
        rows = settle(rows)
        n, mean, cov = moments(rows)
        whole = n * (cov + np.outer(mean - self.centre, mean - self.centre)) / np.outer(self.scale, self.scale)
        inverse = np.linalg.inv(self.axes.T @ whole @ self.axes + self.ridge * np.eye(self.axes.shape[1]))
        return mapped(rows, partial(_cook, centre=self.centre, scale=self.scale, axes=self.axes, inverse=inverse, eps=self.eps))


def _log_mixture(x, weights, means, precisions, logdets):
    parts = [np.log(w) - 0.5 * (quadratic(x, m, p) + ld + x.shape[1] * np.log(2 * np.pi)) for w, m, p, ld in zip(weights, means, precisions, logdets, strict=True)]
    return np.logaddexp.reduce(parts, 0), parts


def _minus_log_mixture(x, **model):
    return -_log_mixture(x, **model)[0]


def _responsible(batches, model):
    k, out = len(model["weights"]), None
    for pdf in batches:
        if len(pdf):
            x = np.array(pdf["features"].tolist(), float)
            whole, parts = _log_mixture(x, **model)
            r = np.exp(np.array(parts) - whole)
            new = [whole.sum(), r.sum(1), r @ x, np.stack([(x * r[i][:, None]).T @ x for i in range(k)])]
            out = new if out is None else [a + b for a, b in zip(out, new, strict=True)]
    if out is not None:
        yield pd.DataFrame({"ll": [out[0]], "r": [out[1].tolist()], "s": [out[2].ravel().tolist()], "q": [out[3].ravel().tolist()]})


@register_model("core_gmm", "classical", "core")
class GMM(Detector):
    """Minus the log-likelihood of a Gaussian mixture with full covariances; each EM step is a pass over the rows."""

    @classmethod
    def defaults(cls):
        return {"n_components": 1, "covariance_type": "full", "tol": 1e-3, "reg_covar": 1e-6, "max_iter": 100, "random_state": 0}

    def _fit(self, train):
        n, mean, cov = moments(train)
        d, k = len(mean), self.n_components
        eye = self.reg_covar * np.eye(d)
        means = mean[None] if k == 1 else lloyd(sample(train, seed=self.random_state or 0)[1], k, self.random_state or 0)
        self._set(np.full(k, 1 / k), means, [cov + eye] * k)
        before = -np.inf
        for _ in range(0 if k == 1 else self.max_iter):
            ll, r, s, q = 0.0, 0.0, 0.0, 0.0
            for row in train.select("features").mapInPandas(partial(_responsible, model=self.model), "ll double, r array<double>, s array<double>, q array<double>").toLocalIterator():
                ll, r, s, q = ll + row.ll, r + np.array(row.r), s + np.array(row.s).reshape(k, d), q + np.array(row.q).reshape(k, d, d)
            r = np.maximum(r, 1e-10)
            means = s / r[:, None]
            self._set(r / r.sum(), means, [q[i] / r[i] - np.outer(means[i], means[i]) + eye for i in range(k)])
            if abs(ll / n - before) < self.tol:
                break
            before = ll / n

    def _set(self, weights, means, covariances):
        self.model = {"weights": weights, "means": means, "precisions": [np.linalg.pinv(c) for c in covariances], "logdets": [np.linalg.slogdet(c)[1] for c in covariances]}

    def _score(self, rows):
        return mapped(rows, partial(_minus_log_mixture, **self.model))


def lloyd(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, rounds: int = 300, tol: float = 1e-4) -> np.ndarray:
    """k-means centres of a sample: the best of some k-means++ starts."""
    draw, best = np.random.default_rng(seed), (np.inf, None)
    k = min(k, len(np.unique(x, axis=0)))
    for _ in range(starts):
        centres = x[[draw.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            centres = np.concatenate([centres, x[[draw.choice(len(x), p=d / d.sum())]]])
        for _ in range(rounds):
            at = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[at == i].mean(0) if (at == i).any() else centres[i] for i in range(k)])
            moved = ((new - centres) ** 2).sum()
            centres = new
            if moved <= tol * x.var(0).mean():
                break
        inertia = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1).sum()
        if inertia < best[0]:
            best = (inertia, centres)
    return best[1]


def _assigned(batches, centres):
    k, out = len(centres), None
    for pdf in batches:
        if len(pdf):
            x = np.array(pdf["features"].tolist(), float)
            at = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            hot = np.eye(k)[at]
            out = [hot.sum(0), hot.T @ x] if out is None else [out[0] + hot.sum(0), out[1] + hot.T @ x]
    if out is not None:
        yield pd.DataFrame({"n": [out[0].tolist()], "s": [out[1].ravel().tolist()]})


def k_means(train: DataFrame, k: int, seed: int, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and sizes: started on a seeded sample, then Lloyd passes over all rows until they stay."""
    centres = lloyd(sample(train, seed=seed)[1], k, seed)
    for _ in range(rounds):
        n, s = np.zeros(len(centres)), np.zeros_like(centres)
        for r in train.select("features").mapInPandas(partial(_assigned, centres=centres), "n array<double>, s array<double>").toLocalIterator():
            n, s = n + np.array(r.n), s + np.array(r.s).reshape(centres.shape)
        new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres)
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= tol:
            break
    return centres, n


def _to_nearest(x, centres):
    return np.sqrt(((x[:, None] - centres[None]) ** 2).sum(-1).min(1))


@register_model("core_kmeans", "classical", "core")
class KMeans(Detector):
    """Distance to the nearest centre."""

    @classmethod
    def defaults(cls):
        return {"n_clusters": 8, "n_init": 10, "max_iter": 300, "tol": 1e-4, "random_state": 0}

    def _fit(self, train):
        self.centres, self.sizes = k_means(train, self.n_clusters, self.random_state or 0, self.max_iter, self.tol)

    def _score(self, rows):
        return mapped(rows, partial(_to_nearest, centres=self.centres))


@register_model("core_crossmad", "classical", "core")
class CrossMAD(KMeans):
    """Distance to the nearest of some prototypes of rows scaled to length 1."""

    @classmethod
    def defaults(cls):
        return {"num_prototypes": 10, "metric": "euclidean", "normalize": True, "random_state": 0, "n_init": 10, "max_iter": 300, "tol": 1e-4}

    def _unit(self, rows):
        return rows.select("id", unit(F.col("features")).alias("features")) if self.normalize else rows

    def _fit(self, train):
        self.n_clusters = self.num_prototypes
        super()._fit(settle(self._unit(train)))

    def _score(self, rows):
        return super()._score(self._unit(rows))


def _cluster_based(x, centres, large, sizes, use_weights):
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(-1))
    at = d.argmin(1)
    own = d[np.arange(len(x)), at]
    out = np.where(large[at], own, d[:, large].min(1))
    return out * sizes[at] if use_weights else out


@register_model("core_cblof", "classical", "core")
class CBLOF(Detector):
    """Distance to the own centre for rows of large clusters, to the nearest large centre for the others."""

    @classmethod
    def defaults(cls):
        return {"n_clusters": 8, "alpha": 0.9, "beta": 5, "use_weights": False, "random_state": 0, "max_iter": 300, "tol": 1e-4}

    def _fit(self, train):
        self.centres, self.sizes = k_means(train, self.n_clusters, self.random_state or 0, self.max_iter, self.tol)
        order = np.argsort(-self.sizes, kind="stable")
        by_size = self.sizes[order]
        mass = np.cumsum(by_size) >= self.alpha * by_size.sum()
        drop = np.append(by_size[:-1] >= self.beta * np.maximum(by_size[1:], 1e-300), False)
        some = [np.flatnonzero(x)[0] + 1 for x in (mass & drop, mass, drop) if x.any()]
        self.large = np.zeros(len(self.sizes), bool)
        self.large[order[: some[0] if some else 1]] = True

    def _score(self, rows):
        return mapped(rows, partial(_cluster_based, centres=self.centres, large=self.large, sizes=self.sizes, use_weights=self.use_weights))


def _kernel(x, bank, kernel, gamma, degree, coef0):
    if kernel == "linear":
        return x @ bank.T
    if kernel == "poly":
        return (gamma * x @ bank.T + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * x @ bank.T + coef0)
    out = np.empty((len(x), len(bank)))
    for part, k in in_steps(x, bank.size, lambda y: np.exp(-gamma * ((y[:, None] - bank[None]) ** 2).sum(-1))):
        out[part] = k
    return out


def _landmark_features(batches, bank, how, root):
    for pdf in batches:
        x = np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1)
        yield pdf.assign(features=list(_kernel(x, bank, **how) @ root) if len(x) else [])


def _potential(x, bank, how, root, mean, axes):
    """Squared length in feature space of what the leading components leave of each row."""
    k = _kernel(x, bank, **how)
    own = np.ones(len(x)) if how["kernel"] == "rbf" else np.array([_kernel(r[None], r[None], **how)[0, 0] for r in x])
    f = k @ root
    moved = f - mean
    return (own - (f * f).sum(1)) + (moved * moved).sum(1) - ((moved @ axes) ** 2).sum(1)


@register_model("core_kpca", "classical", "core")
class KPCA(Detector):
    """Kernel-PCA novelty: the part of a row, in feature space, that the leading kernel components of all rows leave.

    Feature space is spanned by at most ``subset_size`` landmarks, a seeded sample (the Nystrom features K^-1/2 k(x));
    mean and covariance there are summed over all rows, none is dropped. With as many landmarks as rows this is exact
    kernel PCA. With fewer, a row's part outside the span counts as left over, so the score errs by what the landmarks
    miss of the training rows: for the rbf kernel at 1,000 rows and 250 landmarks the tests allow 0.05 of 1.
    """

    @classmethod
    def defaults(cls):
        return {"n_components": None, "n_selected_components": None, "kernel": "rbf", "gamma": None, "degree": 3, "coef0": 1, "sampling": False, "subset_size": 1000, "random_state": 0}

    def _fit(self, train):
        _, self.bank = sample(train, self.subset_size, self.random_state or 0)
        self.how = {"kernel": self.kernel, "gamma": self.gamma or 1 / self.n_features, "degree": self.degree, "coef0": self.coef0}
        values, vectors = np.linalg.eigh(_kernel(self.bank, self.bank, **self.how))
        real = values > 1e-10 * max(values.max(), 1e-300)
        self.root = vectors[:, real] / np.sqrt(values[real])
        _, self.origin, cov = moments(train.mapInPandas(partial(_landmark_features, bank=self.bank, how=self.how, root=self.root), train.schema))
        spread, axes = np.linalg.eigh(cov)
        keep = np.flatnonzero(spread[::-1] > 1e-9 / max(1, len(self.bank)))[: self.n_selected_components or self.n_components or max(1, len(self.bank) // 4)]
        self.axes = axes[:, ::-1][:, keep]

    def _score(self, rows):
        return mapped(rows, partial(_potential, bank=self.bank, how=self.how, root=self.root, mean=self.origin, axes=self.axes))


def _margins(batches, spaced, w):
    """The margin of each row, and its hinge part: features of rows below ``rho`` summed by the tasks."""
    for pdf in batches:
        x = np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1)
        yield pd.DataFrame({"id": pdf["id"], "score": spaced(x) @ w if len(x) else np.empty(0)})


def _below(batches, spaced, w, rho):
    n, total = 0, np.zeros(len(w))
    for pdf in batches:
        f = spaced(np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1)) if len(pdf) else np.zeros((0, len(w)))
        under = f @ w <= rho
        n, total = n + int(under.sum()), total + f[under].sum(0)
    yield pd.DataFrame({"n": [n], "s": [total.tolist()]})


def _fourier(x, centre, scale, frequencies, phases):
    return np.sqrt(2 / len(phases)) * np.cos((x - centre) / scale @ frequencies + phases)


def _one_class(x, centre, scale, frequencies, phases, w, rho):
    z = (x - centre) / scale
    return rho - np.sqrt(2 / len(phases)) * np.cos(z @ frequencies + phases) @ w


@register_model("core_ocsvm", "classical", "core")
class OCSVM(Detector):
    """One-class SVM with an RBF kernel, by random Fourier features and subgradient steps.

    Steps start on a seeded sample of at most SAMPLE rows; where there are more rows, ``rounds`` steps over all of them
    follow, each a pass that sums the features of the rows below the offset, and an exact quantile for the offset. With
    D features the kernel errs by more than e with a chance of at most 2 exp(-D e^2 / 4) at a pair of rows: for the
    512 here, 0.15 at 0.3 %.
    """

    rounds = 8

    @classmethod
    def defaults(cls):
        return {"kernel": "rbf", "nu": None, "gamma": "scale", "preprocessing": True, "random_state": 0, "n_features_map": 512}

    def _fit(self, train):
        n, mean, cov = moments(train)
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        self.centre, self.spread = (mean, np.where(sd > 0, sd, 1)) if self.preprocessing else (np.zeros(len(mean)), np.ones(len(mean)))
        moved = (mean - self.centre) / self.spread
        variance = ((sd / self.spread) ** 2 + moved**2).mean() - moved.mean() ** 2  # of all values of the scaled rows
        gamma = 1 / (len(mean) * max(variance, 1e-12)) if self.gamma == "scale" else self.gamma
        draw = np.random.default_rng(self.random_state or 0)
        self.frequencies, self.phases = draw.normal(0, np.sqrt(2 * gamma), (len(mean), self.n_features_map)), draw.uniform(0, 2 * np.pi, self.n_features_map)
        spaced = partial(_fourier, centre=self.centre, scale=self.spread, frequencies=self.frequencies, phases=self.phases)
        f = spaced(sample(train, seed=self.random_state or 0)[1])
        nu = self.nu or self.contamination
        w, self.w = f.mean(0), np.zeros(f.shape[1])
        for step in range(1, 301):
            rho = np.quantile(f @ w, nu)
            w = w - (w - f[f @ w <= rho].sum(0) / (nu * len(f))) / (step + 1)
            self.w += (w - self.w) / step
        if n > len(f):
            w = self.w
            for step in range(1, self.rounds + 1):
                rho = quantile(self._margin(train, spaced, w), "score", nu)
                parts = train.mapInPandas(partial(_below, spaced=spaced, w=w, rho=rho), "n long, s array<double>").collect()  # one small row a task
                w = w - (w - np.sum([p.s for p in parts], 0) / (nu * n)) / (step + 10)
            self.w = w
        self.rho = float(quantile(self._margin(train, spaced, self.w), "score", nu))

    def _margin(self, rows, spaced, w):
        return rows.mapInPandas(partial(_margins, spaced=spaced, w=w), f"id {rows.schema['id'].dataType.simpleString()}, score double")

    def _score(self, rows):
        return mapped(rows, partial(_one_class, centre=self.centre, scale=self.spread, frequencies=self.frequencies, phases=self.phases, w=self.w, rho=self.rho))
