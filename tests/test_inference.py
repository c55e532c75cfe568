"""Fits, draws, linkages and label paths against plain forms, beyond what SQL holds them to."""

import itertools
import math
import random

import numpy as np
import pytest

from tidegraph.operators import draws, labelling, linkage, maximum, ordered
from tidegraph.sources import loaders


def average_linkage(distance: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of the groups below a height of the average-linkage tree, numbered by their first members."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    groups, sizes = {i: [i] for i in range(n)}, np.ones(n)
    while len(groups) > 1:
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        if d[a, b] > threshold:
            break
        merged = (sizes[a] * d[a] + sizes[b] * d[b]) / (sizes[a] + sizes[b])
        d[a] = d[:, a] = merged
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
        sizes[a] += sizes[b]
        groups[a] += groups.pop(b)
    labels = np.zeros(n, int)
    for k, members in enumerate(sorted(groups.values(), key=min)):
        labels[members] = k
    return labels


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", k, rng.randrange(-5, 9)) for k in rng.sample(range(10**6), 4000)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r.g, r.o): r.total for r in ordered.running(df, ["g"], ["o"], df.v, "total").collect()}
    want, sums = {}, {}
    for g, o, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        want[g, o] = sums[g]
    assert got == want
    places = {r.o: r.place for r in ordered.placed(df, [], ["o"]).collect()}
    assert places == {o: k for k, o in enumerate(sorted(r[1] for r in rows))}
    assert ordered.running(df.limit(0), ["g"], ["o"], df.v, "total").collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linkage_with_ties(spark, seed):
    rng = random.Random(seed)
    n, samples = 17, 8
    draws_ = [[rng.randrange(5) for _ in range(n)] for _ in range(samples)]
    counts = {(i, j): sum(d[i] == d[j] for d in draws_) for i, j in itertools.combinations(range(n), 2)}
    together = [(t, i, j, c / samples) for (i, j), c in counts.items() for t in (0, 4) if c] + [(0, 3, 3, 1.0)]
    nodes = spark.createDataFrame([(t, i) for t in (0, 4) for i in range(n)] + [(9, 5)], "t int, node int")
    merges = linkage.average_linkage(nodes, spark.createDataFrame(together, "t int, i int, j int, p double"))
    assert {r.t for r in merges.collect()} == {0, 4} and merges.count() == 2 * (n - 1)
    far = np.ones((n, n))
    for (i, j), c in counts.items():
        far[i, j] = far[j, i] = 1 - c / samples
    for threshold in (0.3, 0.5, 0.76, 0.9, 1.0):
        want = average_linkage(far, threshold + 1e-9).tolist()
        got = linkage.flat_clusters(nodes, merges, threshold + 1e-9).collect()
        for t in (0, 4):
            assert [r.z for r in sorted(got, key=lambda r: r.node) if r.t == t] == want
    order = linkage.leaf_order(nodes, merges).collect()
    for t in (0, 4):
        leaves = [r.node for r in sorted(order, key=lambda r: r.place) if r.t == t]
        assert sorted(leaves) == list(range(n))
        for r in merges.where(f"t = {t}").collect():  # every cluster's leaves stand together
            at = leaves.index(r.a)
            assert leaves[at + r.offset] == r.b
    assert [(r.node, r.place) for r in order if r.t == 9] == [(5, 0)]


def test_linkage_without_pairs(spark):
    nodes = spark.createDataFrame([(0, 7), (0, 3), (0, 5)], "t int, node int")
    none = spark.createDataFrame([], "t int, i int, j int, p double")
    merges = linkage.average_linkage(nodes, none)
    assert sorted(map(tuple, merges.collect())) == [(0, 3, 5, 1.0, 1, 2), (0, 3, 7, 1.0, 2, 3)]
    assert sorted(r.z for r in linkage.flat_clusters(nodes, merges).collect()) == [0, 1, 2]
    assert linkage.average_linkage(nodes.limit(0), none).collect() == []


def test_exact_controls(spark):
    rng = random.Random(4)
    names = sorted(rng.sample(range(1000), 30))
    steps = 60
    edges = [(t, a, b) for t in range(steps) for a, b in itertools.permutations(names, 2) if a == names[0] and b != names[5] or a == names[7] and b < names[20]]
    nodes = spark.createDataFrame([(t, i) for t in range(steps) for i in names], "t int, node int")
    got = draws.exact_controls(nodes, spark.createDataFrame(edges + edges[:9], "t int, src int, dst int"), 6).collect()
    taken = {}
    for r in got:
        taken.setdefault((r.t, r.src), []).append(r.dst)
    linked = set(edges)
    for t in range(steps):
        for a in names:
            free = [b for b in names if b != a and (t, a, b) not in linked]
            mine = taken.get((t, a), [])
            assert len(mine) == len(set(mine)) == min(6, len(free)) and set(mine) <= set(free)
    hits = [sum(b in taken[t, names[7]] for t in range(steps)) / steps for b in names[20:]]
    assert all(abs(h - 0.6) < 0.3 for h in hits) and abs(np.mean(hits) - 0.6) < 1e-9  # six of ten, evenly


def test_stratified_controls(spark):
    nodes = spark.createDataFrame([(i,) for i in range(20)], "node int")
    edges = spark.createDataFrame([(t, 0, b) for t in range(2) for b in range(1, 16)] + [(0, 3, 3)], "t int, src int, dst int")
    got = draws.stratified_controls(nodes, edges, 6).collect()
    of = lambda i, c: {r.dst for r in got if r.src == i and r.connected == c}
    assert len(of(0, 1)) == 4 and of(0, 1) <= set(range(1, 16)) and len(of(0, 0)) == 2 and of(0, 0) <= set(range(16, 20))
    assert of(4, 1) == {0} and len(of(4, 0)) == 5 and 4 not in of(4, 0)
    assert of(19, 1) == set() and len(of(19, 0)) == 6


def _plain_newton(y, z, theta, rounds=200):
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ theta))
        theta = theta + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p)) * 0.5
    return theta


def test_maximum_likelihood(spark):
    rng = np.random.default_rng(6)
    n, steps = 24, 3
    x = rng.normal(0, 1, (steps, n, 2))
    d = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(axis=3))
    y = rng.random((steps, n, n)) < 1 / (1 + np.exp(-(0.5 - 1.5 * d)))
    positions = spark.createDataFrame([(t, i, x[t, i].tolist()) for t in range(steps) for i in range(n)], "t int, node int, x array<double>")
    up = [(t, i, j) for t in range(steps) for i, j in itertools.combinations(range(n), 2)]
    edges = spark.createDataFrame([(t, j, i) if (i + j) % 2 else (t, i, j) for t, i, j in up if y[t, i, j]] + [(0, 1, 1)], "t int, src int, dst int")
    gone = [p for k, p in enumerate(up) if k % 7 == 0]
    missing = spark.createDataFrame(gone, "t int, src int, dst int")
    for absent, df in ((set(), None), (set(gone), missing)):
        kept = [p for p in up if p not in absent]
        z = np.array([(-d[p], 1.0) for p in kept])
        want = _plain_newton(np.array([y[p] for p in kept], float), z, np.array([1.0, 1.0]))
        fit = maximum.scale_and_intercept(positions, edges, df)
        assert fit.converged and np.allclose((math.exp(fit.values[0]), fit.values[1]), want, atol=1e-6)
    r = rng.random(n) + 0.5
    both = [(t, i, j) for t in range(steps) for i, j in itertools.permutations(range(n), 2)]
    z = np.array([(1 - d[p] / r[p[2]], 1 - d[p] / r[p[1]]) for p in both])
    fit = maximum.directed_intercepts(positions, spark.createDataFrame([p for p in both if y[p]], "t int, src int, dst int"), spark.createDataFrame(list(enumerate(r.tolist())), "node int, r double"))
    assert fit.converged and np.allclose(fit.values, _plain_newton(np.array([y[p] for p in both], float), z, np.zeros(2)), atol=1e-6)


def test_maximum_without_a_maximum(spark):
    positions = spark.createDataFrame([(0, i, [float(i)]) for i in range(5)], "t int, node int, x array<double>")
    none = spark.createDataFrame([], "t int, src int, dst int")
    fit = maximum.scale_and_intercept(positions, none)  # no links: the intercept falls for ever
    assert not fit.converged and math.isfinite(fit.loglik) and fit.loglik < 0 and fit.rounds <= 60


def test_labels_far_from_every_cluster(spark):
    rng = np.random.default_rng(3)
    x = {(t, i): (rng.normal(0, 1, 2) * (1 if i else 400)).tolist() for i in range(4) for t in range(i == 3 and 1 or 5)}
    positions = spark.createDataFrame([(t, i, v) for (t, i), v in x.items()], "t int, node int, x array<double>")
    mus, sigmas = [[0.0, 1.0], [1.0, 0.0], [-1.0, -1.0]], [0.02, 0.5, 1.0]
    clusters = spark.createDataFrame([(10 * k, m, s) for k, (m, s) in enumerate(zip(mus, sigmas))], "k int, mu array<double>, sigma double")
    w0 = [0.2, 0.0, 0.8]
    init = spark.createDataFrame([(10 * k, w) for k, w in enumerate(w0)], "k int, w double")
    w = {t: rng.dirichlet([1, 1, 1], 3) for t in range(1, 5)}
    w[2][0] = [0.0, 1.0, 0.0]
    trans = spark.createDataFrame([(t, 10 * a, 10 * b, float(m[a, b])) for t, m in w.items() for a in range(3) for b in range(3)], "t int, k_from int, k_to int, w double")
    lmbda = 0.6
    got = {(r.t, r.node, r.k): r.p for r in labelling.marginals(positions, init, trans, clusters, lmbda).collect()}
    best = {(r.t, r.node): r.z for r in labelling.best_path(positions, init, trans, clusters, lmbda).collect()}
    for i in range(4):
        ts = sorted(t for t, j in x if j == i)

        def density(t, k):
            mean = np.array(mus[k]) if t == 0 else lmbda * np.array(mus[k]) + (1 - lmbda) * np.array(x[t - 1, i])
            return -math.log(2 * math.pi * sigmas[k]) - ((np.array(x[t, i]) - mean) ** 2).sum() / (2 * sigmas[k])

        log = lambda v: math.log(v) if v > 0 else -math.inf
        paths = {p: log(w0[p[0]]) + density(0, p[0]) + sum(log(w[t][p[t - 1], p[t]]) + density(t, p[t]) for t in ts[1:]) for p in itertools.product(range(3), repeat=len(ts))}
        top = max(paths.values())
        total = sum(math.exp(v - top) for v in paths.values())
        for t in ts:
            for k in range(3):
                assert abs(got[t, i, 10 * k] - sum(math.exp(v - top) for p, v in paths.items() if p[t] == k) / total) < 1e-9
        assert [best[t, i] // 10 for t in ts] == list(max(paths, key=paths.get))


def test_monastery_folder(spark, tmp_path):
    for name, text in {"sampson_0.npy": "0 1 0\n0 0 1\n0 0 0\n", "sampson_1.npy": "0 0 0\n1 0 0\n0 0 0\n", "sampson_2.npy": "0 0 0\n0 0 0\n1 1 0\n", "sampson.npy": "0 1 1\n0 0 0\n0 0 0\n"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "sampson_names.txt").write_text("A\nB\nC\n")
    (tmp_path / "sampson_groups.txt").write_text("Y\nX\nY\n")
    (tmp_path / "sampson_groups_waverers.txt").write_text("Y\nX\nW\n")
    edges, nodes = loaders.monastery(spark, str(tmp_path))
    assert sorted(map(tuple, edges.collect())) == [(0, 0, 1), (0, 1, 2), (1, 1, 0), (2, 2, 0), (2, 2, 1)]
    assert sorted((r.node, r.name, r.z) for r in nodes.collect()) == [(0, "A", 1), (1, "B", 0), (2, "C", 1)]
    edges, nodes = loaders.monastery(spark, str(tmp_path), dynamic=False, directed=False, waverers=True)
    assert sorted(map(tuple, edges.collect())) == [(0, 0, 1), (0, 0, 2), (0, 1, 0), (0, 2, 0)]
    assert sorted((r.node, r.z) for r in nodes.collect()) == [(0, 2), (1, 1), (2, 0)]
