"""LSCP against its plain definition."""

from collections import Counter

import numpy as np
import pytest

from oddlens.operators import ensembles, metric_join, neighbours
from oddlens.operators.registry import create_model


def table(spark, x, first=0):
    return spark.createDataFrame([(i + first, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")


def by_id(frame, n, first=0):
    got = {r.id - first: r.score for r in frame.collect()}
    return np.array([got[i] for i in range(n)])


def plain(x, y, z, own, parts, k, iterations, n_bins, alone):
    """Scores of rows ``x`` with z-scores ``own``; ``y`` and ``z``: the training rows and theirs."""
    truth, out = z.max(1), []
    corr = lambda at: [np.corrcoef(z[at, m], truth[at])[0, 1] if z[at, m].std() > 0 and truth[at].std() > 0 else 0.0 for m in range(z.shape[1])]
    for i, row in enumerate(x):
        votes = Counter()
        for part, times in parts.items():
            d = np.sqrt(((y[:, part] - row[list(part)]) ** 2).sum(1))
            order = [j for j in np.lexsort((np.arange(len(y)), d)) if not (alone and j == i)][:k]
            votes.update({j: times for j in order})
        most = iterations // 2
        region = [j for j, c in votes.items() if c > most]
        while len(region) < 2 and most > 0:
            most -= 1
            region = [j for j, c in votes.items() if c > most]
        r = np.array(corr(region))
        if np.allclose(r, r[0], rtol=1e-12, atol=1e-12):
            chosen = [int(r.argmax())]
        else:
            held, borders = np.histogram(r, bins=min(n_bins, len(r)))
            chosen = np.flatnonzero((r >= borders[held.argmax()]) & (r <= borders[held.argmax() + 1]))
        out.append(own[i, chosen].mean())
    return np.array(out)


@pytest.mark.parametrize("blocks", [False, True])
def test_regions_are_voted_for_by_random_subsets(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(neighbours, "BANK_BYTES", 256)
        monkeypatch.setattr(metric_join, "BLOCK_ROWS", 16)
    draw = np.random.default_rng(5)
    x, more = draw.normal(size=(70, 5)) * [1, 4, 1, 2, 1], draw.normal(size=(9, 5)) * 2
    model = create_model("core_lscp", local_region_size=6, local_region_iterations=4 if blocks else 20, detector_specs=("core_knn", "core_hbos", "core_mad")).fit(table(spark, x))
    spread = [(m.mean, m.sd + 1e-12) for m in model.members]
    z = np.stack([(by_id(m.train_scores, 70) - mean) / sd for m, (mean, sd) in zip(model.members, spread, strict=True)], 1)
    rows = table(spark, more, 100)
    own = np.stack([(by_id(m.decision_function(rows), 9, 100) - mean) / sd for m, (mean, sd) in zip(model.members, spread, strict=True)], 1)
    how = model.parts, 6, model.local_region_iterations, 10
    assert len(model.parts) > 2 and sum(model.parts.values()) == model.local_region_iterations
    assert np.allclose(by_id(model.train_scores, 70), plain(x, x, z, z, *how, True))
    assert np.allclose(by_id(model.decision_function(rows), 9, 100), plain(more, x, z, own, *how, False))


def test_the_fullest_bin_of_correlations_is_averaged():
    assert ensembles.competent(np.array([0.3, 0.3, 0.3]), 10).tolist() == [0]
    assert ensembles.competent(np.array([0.9, 0.1, 0.85, 0.88]), 10).tolist() == [0, 2, 3]
    assert ensembles.competent(np.array([0.9, 0.1]), 10).tolist() == [1]  # of equally full bins the lowest
    assert ensembles.drawn_parts(64, 20, 0.5, 1.0, 0) == ensembles.drawn_parts(64, 20, 0.5, 1.0, 0)
