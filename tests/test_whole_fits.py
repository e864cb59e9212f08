"""Fits over all rows against their plain definitions."""

import numpy as np
import pytest

from oddlens.operators import distance_covariance, graph_scores, kernels, linear, metric_join, randomised  # noqa: F401
from oddlens.operators.metric_join import Space, distances
from oddlens.operators.registry import create_model


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>").repartition(3)


def scores(df):
    return np.array([r.score for r in sorted(df.collect())])


def prim(d):
    inside, edges = {0}, []
    while len(inside) < len(d):
        out = [j for j in range(len(d)) if j not in inside]
        i, j = min(((i, j) for i in inside for j in out), key=lambda e: d[e])
        edges.append((i, j, d[i, j]))
        inside.add(j)
    return edges


def test_spanning_tree_equals_prim(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 12)
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(size=(45, 3)), 8 + draw.normal(size=(25, 3)), [[30.0, 0, 0]]])
    d = distances(x, x)
    want = prim(d)
    edges = graph_scores.spanning_edges(table(spark, x), len(x), Space(3)).collect()
    assert {(e.a, e.b) for e in edges} == {tuple(sorted(e[:2])) for e in want}
    own = np.zeros(len(x))
    for i, j, length in want:
        own[i], own[j] = max(own[i], length), max(own[j], length)
    model = create_model("core_mst_outlier").fit(table(spark, x))
    assert np.allclose(scores(model.train_scores), own)
    new = draw.normal(size=(5, 3)) * 4
    near = distances(new, x)
    assert np.allclose(scores(model.decision_function(table(spark, new, 100))), np.maximum(near.min(1), own[near.argmin(1)]))
    assert scores(create_model("core_mst_outlier").fit(table(spark, x[:1])).train_scores).tolist() == [0]


def test_spanning_tree_searches_only_where_lists_end(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(70, 3))
    x = np.concatenate([x[:30], x[30:50] + 40, x[50:] - 40, x[:20]])
    d = distances(x, x)
    asked, search = [], graph_scores._searched
    monkeypatch.setattr(graph_scores, "LISTED", 4)
    monkeypatch.setattr(graph_scores, "_searched", lambda rows, *how: asked.append(rows.count()) or search(rows, *how))
    edges = graph_scores.spanning_edges(table(spark, x), len(x), Space(3)).collect()
    assert len(edges) == len(x) - 1
    assert np.isclose(sum(e.d for e in edges), sum(e[2] for e in prim(d)))
    assert asked
    assert max(asked) <= 70


def plain_sos(x, perplexity):
    d = distances(x, x)
    p = np.zeros_like(d)
    for i in range(len(x)):
        others = np.arange(len(x)) != i
        low, high = -40.0, 40.0
        for _ in range(200):
            e = np.exp(-np.exp(low / 2 + high / 2) * (d[i, others] - d[i, others].min()))
            q = e / e.sum()
            low, high = ((low + high) / 2, high) if -(q * np.log(np.maximum(q, 1e-300))).sum() > np.log(perplexity) else (low, (low + high) / 2)
        p[i, others] = q
    return np.exp(np.log(1 - p).sum(0))


def test_sos_equals_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 16)
    x = np.concatenate([np.random.default_rng(5).normal(size=(60, 2)), [[9, 9]]])
    assert np.allclose(scores(create_model("core_sos").fit(table(spark, x)).train_scores), plain_sos(x, 4.5), atol=1e-7)
    ties = np.concatenate([np.zeros((8, 2)), x[:10]])
    assert np.isfinite(scores(create_model("core_sos").fit(table(spark, ties)).train_scores)).all()
    assert np.allclose(scores(create_model("core_sos").fit(table(spark, x[:3])).train_scores), 0.25)


def test_sos_compares_different_rows_once_and_far_ones_never(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 16)
    x = np.concatenate([np.random.default_rng(6).normal(size=(50, 2)), 1000 + np.random.default_rng(7).normal(size=(50, 2)), [[9, 9]]])
    x = np.concatenate([x, x[:40], x[:20], np.zeros((9, 2))])
    held, sent = [], []
    blocks, pairs = graph_scores.in_blocks, graph_scores.meet
    monkeypatch.setattr(graph_scores, "in_blocks", lambda rows, *how: held.append(blocks(rows, *how)) or held[-1])
    monkeypatch.setattr(graph_scores, "meet", lambda asked, *how: sent.append(asked.selectExpr("sum(size(ids))").first()[0]) or pairs(asked, *how))
    found = scores(create_model("core_sos").fit(table(spark, x)).train_scores)
    assert np.allclose(found, plain_sos(x, 4.5), atol=1e-7)
    assert held[0].layout.rows.sum() == 102
    assert max(sent) < 0.7 * 102 * len(held[0].layout.block)


def plain_parts(u, w, tu, tw):
    """Of rows (u, w) against training rows (tu, tw): doubly centred matrices."""
    a, b = np.abs(tu[:, None] - tu), np.abs(tw[:, None] - tw)
    x, y = np.abs(u[:, None] - tu), np.abs(w[:, None] - tw)
    a_mean, b_mean = a.mean(1), b.mean(1)
    return np.abs(((x - x.mean(1, keepdims=True) - a_mean + a.mean()) * (y - y.mean(1, keepdims=True) - b_mean + b.mean())).mean(1))


@pytest.mark.parametrize("n", [1, 2, 37, 120])
def test_dcorr_equals_centred_matrices(spark, n):
    draw = np.random.default_rng(n)
    x = np.round(draw.normal(size=(n, 3)), 1)  # with ties
    new = np.concatenate([draw.normal(size=(6, 3)) * 3, x[:1]])
    model = create_model("core_dcorr", n_projections=3).fit(table(spark, x))
    u, w = x @ model.axes[:, :3], x @ model.axes[:, 3:]
    want = np.mean([plain_parts(u[:, k], w[:, k], u[:, k], w[:, k]) for k in range(3)], 0)
    assert np.allclose(scores(model.train_scores), want, atol=1e-9)
    p, q = new @ model.axes[:, :3], new @ model.axes[:, 3:]
    want = np.mean([plain_parts(p[:, k], q[:, k], u[:, k], w[:, k]) for k in range(3)], 0)
    assert np.allclose(scores(model.decision_function(table(spark, new, 1000))), want, atol=1e-9)


def test_mcd_takes_all_rows_and_never_grows(spark, monkeypatch):
    monkeypatch.setattr(linear, "SAMPLE", 60)
    draw = np.random.default_rng(1)
    mix = np.array([[2.0, 0.5, 0], [0, 1, 0.3], [0, 0, 0.5]])
    x = np.concatenate([draw.normal(size=(500, 3)) @ mix, 12 + draw.normal(size=(120, 3)) * 0.2])
    model = create_model("core_mcd").fit(table(spark, x))
    assert all(b <= a for a, b in zip(model.log_determinants, model.log_determinants[1:], strict=False))
    clean = np.cov(x[:500].T)
    assert np.abs(np.linalg.inv(model.precision) - clean).max() < 0.8 and np.abs(model.mean_vector).max() < 0.3
    got = scores(model.train_scores)
    assert got[500:].min() > np.quantile(got[:500], 0.99)
    same = linear.robust_covariance(table(spark, x[:80]), None, True)
    assert (same[0] == 0).all()


def test_rod_medians_and_scores_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BANK", 20)
    x = np.concatenate([np.random.default_rng(2).normal(size=(150, 4)), [[7.0, -7, 7, 7]]])
    model = create_model("core_rod").fit(table(spark, x))
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    z = (x - q[1]) / (q[2] - q[0])
    total = np.zeros(len(x))
    for columns, median, med, mad in model.spaces:
        part, m = z[:, columns], z[:, columns].mean(0)
        for _ in range(3000):
            far = np.maximum(np.linalg.norm(part - m, axis=1), 1e-12)
            m = (part / far[:, None]).sum(0) / (1 / far).sum()
        assert np.allclose(median, m, atol=1e-6)
        cost = kernels._rod_costs(part, median, median)
        assert np.isclose(med, np.median(cost)) and np.isclose(mad, np.median(np.abs(cost - np.median(cost))))
        total += 1 / (1 + np.exp(-0.6745 * np.abs(cost - med) / mad))
    assert np.allclose(scores(model.train_scores), total / len(model.spaces))


def plain_kpca(x, new, gamma, keep):
    k = lambda a, b: np.exp(-gamma * ((a[:, None] - b) ** 2).sum(-1))
    whole = k(x, x)
    values, vectors = np.linalg.eigh(whole - whole.mean(0) - whole.mean(1, keepdims=True) + whole.mean())
    values, vectors = values[::-1][:keep], vectors[:, ::-1][:, :keep]
    row = k(new, x)
    centred = row - row.mean(1, keepdims=True) - whole.mean(0) + whole.mean()
    return 1 - 2 * row.mean(1) + whole.mean() - ((centred @ vectors) ** 2 / values).sum(1)


def test_kpca_is_exact_with_all_landmarks_and_near_with_fewer(spark):
    draw = np.random.default_rng(6)
    x, new = draw.normal(size=(1000, 2)), draw.normal(size=(40, 2)) * 2
    few = create_model("core_kpca", n_components=5).fit(table(spark, x[:80]))
    assert np.allclose(scores(few.decision_function(table(spark, new, 5000))), plain_kpca(x[:80], new, 0.5, 5), atol=1e-6)
    some = create_model("core_kpca", n_components=5, subset_size=250).fit(table(spark, x))
    assert np.abs(scores(some.decision_function(table(spark, new, 5000))) - plain_kpca(x, new, 0.5, 5)).max() < 0.05


def test_ocsvm_takes_all_rows(spark, monkeypatch):
    draw = np.random.default_rng(9)
    x = np.concatenate([draw.normal(size=(380, 3)), 6 + draw.normal(size=(20, 3))])
    whole = create_model("core_ocsvm", nu=0.1).fit(table(spark, x))
    monkeypatch.setattr(linear, "SAMPLE", 100)
    monkeypatch.setattr(linear.sample, "__defaults__", (100, 0))
    part = create_model("core_ocsvm", nu=0.1).fit(table(spark, x))
    a, b = scores(whole.train_scores), scores(part.train_scores)
    assert np.corrcoef(a, b)[0, 1] > 0.95
    assert abs((b > 0).mean() - 0.1) < 0.02 and b[380:].mean() > np.quantile(b[:380], 0.9)
    z = (x - whole.centre) / whole.spread
    f = linear._fourier(x, whole.centre, whole.spread, whole.frequencies, whole.phases)
    gamma = 1 / (3 * z.var())
    exact = np.exp(-gamma * ((z[:, None] - z) ** 2).sum(-1))
    assert np.quantile(np.abs(f @ f.T - exact), 0.997) < 0.15


def test_patchcore_keeps_its_part_by_hash(spark):
    model = create_model("core_patchcore_lite").fit(table(spark, np.random.default_rng(0).normal(size=(101, 2))))
    assert model.bank.count() == 21


@pytest.mark.parametrize("how", ["aad", "var"])
def test_sequential_exceptions_of_many_rows(spark, monkeypatch, how):
    """Over BANK rows the factors are those of the plain search through each order, also where the best row stands late."""
    monkeypatch.setattr(kernels, "BANK", 50)
    monkeypatch.setattr(kernels, "FIRST", 20)
    draw = np.random.default_rng(7)
    late = np.round(draw.normal(size=(160, 2)), 1) * 0.01
    late[draw.choice(160, 3, replace=False)] += [[90, 0], [0, 80], [70, 70]]
    for x in (draw.normal(size=(300, 3)) * [1, 50, 3], late, np.ones((60, 2))):
        rows = table(spark, x, 5)
        model = create_model("core_imdd", n_iter=6, dis_measure=how).fit(rows)
        keys = {r.id: r["keys"] for r in model._keyed(rows).collect()}
        factor, rest = np.zeros(len(x)), np.zeros(len(x))
        for t in range(7):
            order = np.array(sorted(range(len(x)), key=lambda i, t=t: (keys[i + 5][t], i)))
            found = np.zeros(len(x))
            found[order] = kernels.smoothing_factors(x[order], how)
            better = found > factor
            factor[better], rest[better] = found[better], len(x) - np.count_nonzero(found)
        got = {r.id - 5: r.score for r in model.train_scores.collect()}
        assert np.allclose([got[i] for i in range(len(x))], factor * rest, rtol=1e-9, atol=1e-9) and len(got) == len(x)


def test_dissimilarities_of_long_prefixes():
    x = np.random.default_rng(8).normal(size=(900, 40)) + 1000
    for how in ("aad", "var"):
        assert np.allclose(kernels.grown(x, how), [kernels.dissimilarity(x[: i + 1], how) for i in range(len(x))])
        assert np.allclose(kernels._with_rows(x[:200].ravel(), x[200:300], how), [kernels.dissimilarity(np.vstack([x[:200], x[k : k + 1]]), how) for k in range(200, 300)])


def test_loci_takes_copies_of_rows(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BANK", 50)
    x = np.concatenate([np.random.default_rng(2).normal(size=(45, 2)), [[9, 9]]])
    x = np.concatenate([x, x[:20], x[:5]])
    d = distances(x, x)
    want = [kernels.deviation(i, d, d, 0.5, 3.0) for i in range(len(x))]
    assert np.allclose(scores(create_model("core_loci").fit(table(spark, x)).train_scores), want)
    with pytest.raises(ValueError, match="different"):
        create_model("core_loci").fit(table(spark, np.random.default_rng(2).normal(size=(51, 2))))


def test_moments_run_tasks_at_once_and_places_are_exact(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(90, 3))
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *how, **named: pytest.fail("one task after another"))
    n, mean, cov = linear.moments(table(spark, x))
    assert n == 90 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    values = spark.createDataFrame([(float(v),) for v in np.round(x.ravel(), 1)], "score double")
    assert [linear._placed(values, h, 270) for h in (1, 135, 270)] == np.sort(np.round(x.ravel(), 1))[[0, 134, 269]].tolist()


@pytest.mark.parametrize("k", [3.0, 1.0])
def test_loci_of_many_rows_is_whole(spark, monkeypatch, k):
    """Over BANK different rows used to be refused; most radii are ruled out by bounds, and the scores are those of all radii."""
    monkeypatch.setattr(kernels, "BANK", 50)
    draw = np.random.default_rng(12)
    flat = np.stack([np.round(draw.uniform(-1000, 10000, 130), 2), draw.integers(0, 25, 130)], 1)
    groups = np.concatenate([draw.normal(size=(90, 2)), draw.normal(size=(60, 2)) * 0.1 + 5, [[9, 9], [-8, 3]]])
    for x in (flat, groups, np.concatenate([groups, groups[:30], groups[:7]]), np.ones((60, 2)), draw.normal(size=(25, 3))):
        d = distances(x, x)
        want = [kernels.deviation(i, d, d, 0.5, k) for i in range(len(x))]
        assert np.allclose(scores(create_model("core_loci", k=k, many=True).fit(table(spark, x)).train_scores), want)
