import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegraph.functions import scalar
from tidegraph.operators import diagnostics, forecast, likelihood, metrics, missing, network, plotdata, posterior
from tidegraph.plans import initial, kernel, simulate
from tidegraph.sources import loaders
from tidegraph.streaming import snapshots


@pytest.fixture(scope="module")
def net(spark):
    """A random directed network of 3 steps and 9 nodes, with its dense form, positions and labels."""
    rng = np.random.default_rng(5)
    y = (rng.random((3, 9, 9)) < 0.25).astype(int)
    y[:, np.arange(9), np.arange(9)] = 0
    x, z, r = rng.normal(size=(3, 9, 2)), rng.integers(0, 3, (3, 9)), rng.dirichlet(np.ones(9))
    t, i, j = map(lambda v: v.tolist(), np.nonzero(y))
    return {
        "y": y, "x": x, "z": z, "r": r,
        "edges": spark.createDataFrame(list(zip(t, i, j)), "t int, src int, dst int"),
        "nodes": spark.createDataFrame([(k, f"n{k}") for k in range(9)], "node int, name string"),
        "positions": spark.createDataFrame([(a, b, x[a, b].tolist()) for a in range(3) for b in range(9)], "t int, node int, x array<double>"),
        "labels": spark.createDataFrame([(a, b, int(z[a, b])) for a in range(3) for b in range(9)], "t int, node int, z int"),
        "radii": spark.createDataFrame([(k, float(v)) for k, v in enumerate(r)], "node int, r double"),
    }


def test_statistics_against_dense_forms(net):
    y, z = net["y"], net["z"]
    s = ((y + y.transpose(0, 2, 1)) > 0).astype(float)
    for directed in (False, True):
        got = {r["t"]: r["modularity"] for r in network.modularity(net["edges"], net["labels"], directed=directed).collect()}
        for t in range(3):
            a = s[t] if not directed else 0.5 * (y[t] + y[t].T)
            m2 = a.sum() if not directed else 2 * y[t].sum()
            d = a.sum(axis=1)
            same = z[t][:, None] == z[t]
            assert got[t] == pytest.approx((same * (a / m2 - np.outer(d, d) / m2**2)).sum())
    lengths = {(r["t"], r["src"], r["dst"]): r["d"] for r in network.shortest_paths(net["edges"], net["nodes"]).collect()}
    for t in range(3):
        want = initial.path_lengths(y[t])
        assert all(lengths[t, i, j] == want[i, j] for i in range(9) for j in range(9))
    core = {(r["t"], r["src"], r["dst"]) for r in network.k_core(net["edges"], 3).collect()}
    for t in range(3):
        a = s[t].copy()
        while True:
            weak = (a.sum(axis=1) < 3) & (a.sum(axis=1) > 0)
            if not weak.any():
                break
            a[weak] = a[:, weak] = 0
        assert {(t, i, j) for i, j in zip(*np.nonzero(np.triu(a)))} == {e for e in core if e[0] == t}
    assert network.is_dynamic(net["edges"]) and not network.is_dynamic(net["edges"].where("t = 0"))


def test_likelihoods_against_dense_forms(net):
    y, x, r = net["y"], net["x"], net["r"]
    d = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(axis=3))
    off = ~np.eye(9, dtype=bool)
    eta = 0.8 * (1 - d / r[None, None]) + 0.3 * (1 - d / r[None, :, None])
    want = (y * eta - np.logaddexp(0, eta))[:, off].sum()
    pairs = likelihood.dyads(net["positions"], net["edges"], True, net["radii"]).cache()
    assert likelihood.loglikelihood(pairs, likelihood.eta_directed(0.8, 0.3)).first()[0] == pytest.approx(want)
    every = likelihood.case_control_loglikelihood(pairs, likelihood.eta_directed(0.8, 0.3), F.lit(True))
    assert every.agg(F.sum("loglik")).first()[0] == pytest.approx(want)  # all non-edges chosen: the exact likelihood
    chain = kernel.Chain(y.astype(float), kernel.Config(kind="lsm", directed=True, tune=0, burn=0, n_control=20), 1)
    chain.x, chain.r, chain.b = x.copy(), r, np.array([0.8, 0.3])
    assert chain.loglik(d, chain.b, r) == pytest.approx(want)
    base = chain.node_loglik(1, 4, x[1, 4])
    new = x[1, 4] + 0.3
    moved = chain.node_loglik(1, 4, new) - base
    chain.x[1, 4] = new
    assert chain.loglik(chain.distances(), chain.b, r) - want == pytest.approx(moved)
    grad = likelihood.directed_gradient(pairs, 0.8, 0.3).first()
    h, ll = 1e-5, lambda a, b: likelihood.loglikelihood(pairs, likelihood.eta_directed(a, b)).first()[0]
    assert grad["grad_in"] == pytest.approx((ll(0.8 + h, 0.3) - ll(0.8 - h, 0.3)) / (2 * h), rel=1e-4)
    big = likelihood.loglikelihood(pairs, F.lit(900.0) - F.col("d")).first()[0]
    assert math.isfinite(big)


def test_auc_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    p, y = rng.integers(0, 6, 60) / 5, rng.integers(0, 2, 60)
    got = metrics.auc(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)] + [(None, 0.5)], "y int, p double")).first()[0]
    one, zero = p[y == 1], p[y == 0]
    assert got == pytest.approx(((one[:, None] > zero).mean() + 0.5 * (one[:, None] == zero).mean()))
    assert metrics.auc(spark.createDataFrame([(1, 0.5)], "y int, p double")).first()[0] is None


def test_auc_of_any_scores(spark):
    """Scores of every size and sign, ties, infinities, NaN and null, by a group that may be null."""
    rng = np.random.default_rng(8)
    nan, inf = math.nan, math.inf
    p = np.concatenate([rng.normal(size=60), 10.0 ** rng.integers(-300, 300, 30), -(10.0 ** rng.integers(-300, 300, 20)), [0.0, -0.0, 5e-324, inf, -inf, nan, nan], rng.integers(-2, 3, 30)])
    y = rng.integers(0, 2, len(p))
    rank = [(2, 0.0) if math.isnan(v) else (1, v) for v in p.tolist()]
    won = [1.0 if a > b else 0.5 if a == b else 0.0 for a, u in zip(rank, y) if u for b, v in zip(rank, y) if not v]
    rows = [(g, int(u), float(v)) for g in ("a", None) for u, v in zip(y, p)]
    got = metrics.auc(spark.createDataFrame(rows, "g string, y int, p double"), ["g"]).collect()
    assert {r["g"] for r in got} == {"a", None} and all(r["auc"] == pytest.approx(sum(won) / len(won)) for r in got)
    low = spark.createDataFrame([(1, None), (0, -inf), (0, 3.0)], "y int, p double")
    assert metrics.auc(low).first()[0] == 0.0


def test_pairs_meet_once(spark):
    nodes = spark.createDataFrame([(s, k, [float(k), float(s)]) for s in range(2) for k in range(20)], "iter int, node int, x array<double>")
    got = [tuple(r) for r in forecast.pairs(nodes, ["iter"]).select("iter", "i", "j", "d").collect()]
    assert sorted(got) == [(s, i, j, float(j - i)) for s in range(2) for i in range(20) for j in range(i + 1, 20)]


@settings(max_examples=5, deadline=None)
@given(a=st.lists(st.integers(0, 3), min_size=4, max_size=12), seed=st.integers(0, 99))
def test_partition_scores(spark, a, seed):
    b = np.random.default_rng(seed).integers(0, 3, len(a)).tolist()
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    vi = lambda x, y: metrics.variation_of_information(df, x, y).first()[0]
    assert vi("a", "b") == pytest.approx(vi("b", "a")) and abs(vi("a", "a")) < 1e-12
    assert metrics.adjusted_rand(df, "a", "a").first()[0] == pytest.approx(1.0)


def test_expected_vi_node_by_node(spark):
    rng = np.random.default_rng(1)
    z = rng.integers(0, 3, (6, 8))
    labels = spark.createDataFrame([(s, 0, i, int(z[s, i])) for s in range(6) for i in range(8)], "iter int, t int, node int, z int")
    together = (z[:, :, None] == z[:, None]).mean(axis=0)
    got = {r["iter"]: r["vi"] for r in posterior.expected_vi(labels, posterior.cooccurrence(labels)).collect()}
    for s in range(6):
        want = 0.0
        for i in range(8):
            same = z[s] == z[s, i]
            want += math.log2(same.sum()) - 2 * math.log2(together[i, same].sum()) + math.log2(together[i].sum())
        assert got[s] == pytest.approx(want / 8)
    best = posterior.select_min_vi(labels, posterior.cooccurrence(labels)).first()
    assert best["vi"] == pytest.approx(min(got.values()))


def test_forward_pass_against_all_paths(spark):
    rng = np.random.default_rng(3)
    x, w0, w = rng.normal(size=(3, 2)), rng.dirichlet([1, 1]), rng.dirichlet([1, 1], (3, 2))
    mu, sigma, lam = rng.normal(size=(2, 2)), np.array([0.5, 1.5]), 0.6
    total = 0.0
    for path in itertools.product(range(2), repeat=3):
        p = w0[path[0]]
        for t, k in enumerate(path):
            mean = mu[k] if t == 0 else lam * mu[k] + (1 - lam) * x[t - 1]
            p *= math.exp(-((x[t] - mean) ** 2).sum() / (2 * sigma[k])) / (2 * math.pi * sigma[k]) * (w[t, path[t - 1], k] if t else 1)
        total += p
    got = posterior.forward_loglik(
        spark.createDataFrame([(t, 0, x[t].tolist()) for t in range(3)], "t int, node int, x array<double>"),
        spark.createDataFrame([(k, float(w0[k])) for k in range(2)], "k int, w double"),
        spark.createDataFrame([(t, a, b, float(w[t, a, b])) for t in (1, 2) for a in range(2) for b in range(2)], "t int, k_from int, k_to int, w double"),
        spark.createDataFrame([(k, mu[k].tolist(), float(sigma[k])) for k in range(2)], "k int, mu array<double>, sigma double"),
        lam,
    ).first()["loglik"]
    assert got == pytest.approx(math.log(total))


def test_labels_are_drawn_by_their_posterior():
    """Forward-filter backward-sample frequencies against all label paths of a tiny model."""
    rng = np.random.default_rng(4)
    c = kernel.Config(kind="lpcm", n_components=2, tune=0, burn=0, n_iter=1)
    chain = kernel.Chain.__new__(kernel.Chain)
    chain.c, chain.rng, chain.T, chain.n = c, rng, 3, 1
    chain.x, chain.mu, chain.sigma, chain.lmbda = rng.normal(size=(3, 1, 2)), rng.normal(size=(2, 2)), np.array([0.8, 1.2]), 0.7
    chain.w0, chain.w = rng.dirichlet([2, 2]), rng.dirichlet([2, 2], (3, 2))
    ld = chain.log_densities()[:, 0]
    paths = list(itertools.product(range(2), repeat=3))
    p = np.array([math.exp(sum(ld[t, k] for t, k in enumerate(q))) * chain.w0[q[0]] * chain.w[1, q[0], q[1]] * chain.w[2, q[1], q[2]] for q in paths])
    p /= p.sum()
    chain.z, seen = np.zeros((3, 1), int), dict.fromkeys(paths, 0)
    for _ in range(6000):
        chain.update_labels()
        seen[tuple(chain.z[:, 0].tolist())] += 1
    assert np.abs(np.array([seen[q] for q in paths]) / 6000 - p).max() < 0.03


def test_truncated_normal_and_concentration():
    rng = np.random.default_rng(0)
    for mean, var in ((0.9, 0.01), (-3.0, 0.1), (40.0, 0.01), (-40.0, 0.01)):
        x = [kernel.truncated_normal(rng, mean, var) for _ in range(200)]
        assert all(0 <= v <= 1 for v in x)
    assert np.mean(x) < 0.01
    assert 0 < kernel.concentration(rng, 1.0, 3, 50) < 50


def test_rotation_never_lengthens_the_difference():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 7, 2))
    angle = 1.1
    turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    r = initial.procrustes(x, x @ turn)
    assert np.allclose(x @ turn @ r, x) and np.allclose(r @ r.T, np.eye(2))


def test_intercepts_of_a_simulated_network():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 60, 2))
    y, _ = simulate.links(rng, x, 1.0, None)
    b, scale = initial.intercept_mle(y.astype(float), x, None)
    assert abs(b[0] - 1) < 0.25 and abs(scale - 1) < 0.2


@pytest.mark.parametrize("name", list(simulate.SCENARIOS))
def test_scenarios(spark, name):
    sim = simulate.simulate(spark, name, [1, 2], n=30).cache()
    steps = {"splitting": 10, "merging": 5, "merging_blocks": 6, "static_communities": 5, "homogeneous": 7, "inhomogeneous": 10, "splitting_and_merging": 10, "detection_limit": 4}[name]
    z = simulate.labels_of(sim, 1)
    assert z.count() == steps * 30
    e = simulate.edges_of(sim, 1)
    assert e.where("src = dst").count() == 0 and e.select("t", F.col("dst").alias("src"), F.col("src").alias("dst")).exceptAll(e).count() == 0
    again = simulate.simulate(spark, name, [1], n=30)
    assert simulate.edges_of(again, 1).exceptAll(e).count() == 0
    if name == "static_communities":
        assert z.groupBy("node").agg(F.countDistinct("z").alias("n")).where("n > 1").count() == 0


def test_directed_scenarios():
    for f in (simulate.splitting, simulate.splitting_and_merging):
        s = f(np.random.default_rng(1), n=25, directed=True)
        assert (s["y"] != s["y"].transpose(0, 2, 1)).any()


def test_loaders(spark, tmp_path):
    (tmp_path / "a-edges.csv").write_text("Source,Target,Weight,Season\nANN,BOB,7,1\nANN,BOB,5,1\nBOB,CAT,3,1\n")
    (tmp_path / "b-edges.csv").write_text("Source,Target,Weight,Season\nDAN,ANN,20,2\nBOB,ANN,20,3\n")
    edges, nodes = loaders.interactions(spark, str(tmp_path / "*-edges.csv"), [1, 2], 10)
    assert {r["name"]: r["node"] for r in nodes.collect()} == {"ANN": 0, "BOB": 1, "DAN": 2}
    assert sorted(map(tuple, edges.collect())) == [(1, 0, 1), (1, 1, 0), (2, 0, 2), (2, 2, 0)]
    for t, m in enumerate(("0 1 0\n0 0 1\n0 0 0\n", " 0 0 2\n0 0 0 \n1 0 0")):
        (tmp_path / f"m{t}.txt").write_text(m)
    (tmp_path / "names.txt").write_text("x\ny\nz\n")
    (tmp_path / "groups.txt").write_text("B\nA\nB\n")
    paths = [str(tmp_path / f"m{t}.txt") for t in range(2)]
    edges, nodes = loaders.labelled_matrices(spark, paths, str(tmp_path / "names.txt"), str(tmp_path / "groups.txt"))
    assert sorted(map(tuple, edges.collect())) == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 2, 0)]
    assert [tuple(r) for r in nodes.orderBy("node").collect()] == [(0, "x", "B", 1), (1, "y", "A", 0), (2, "z", "B", 1)]
    n = 6
    full = "\n".join(" ".join("1" if (i < 4 and j < 4 and i != j) or (i, j) == (4, 0) else "0" for j in range(n)) for i in range(n))
    (tmp_path / "k.txt").write_text(full)
    (tmp_path / "c.csv").write_text("name\n" + "\n".join("ABCDEF"))
    edges, nodes = loaders.alliances(spark, [str(tmp_path / "k.txt")], str(tmp_path / "c.csv"))
    assert edges.count() == 12 and [r["name"] for r in nodes.orderBy("node").collect()] == list("ABCD")
    edges, nodes = loaders.alliances(spark, [str(tmp_path / "k.txt")], str(tmp_path / "c.csv"), remove_periphery=False)
    assert edges.count() == 14 and nodes.count() == 5
    for form in ("csv", "parquet"):
        loaders.write_results(edges, str(tmp_path / form), form)
        assert spark.read.format(form).option("header", True).load(str(tmp_path / form)).count() == 14


def test_imputation_and_splits(spark):
    rows = [(t, i, j, (i + j + t) % 3 == 0) for t in range(2) for i in range(10) for j in range(i + 1, 10)]
    dyads = spark.createDataFrame([(t, i, j, int(y)) for t, i, j, y in rows], "t int, src int, dst int, y int")
    split = missing.train_test_split(dyads, 0.1).cache()
    assert [r["n"] for r in split.where("held_out").groupBy("t").agg(F.count("*").alias("n")).collect()] == [5, 5]
    assert split.repartition(7).where("held_out").exceptAll(missing.train_test_split(dyads.repartition(3), 0.1).where("held_out")).count() == 0
    assert missing.train_test_split(dyads, 7).where("held_out").count() == 14
    gone = missing.masked(split)
    for how in ("most_frequent", "random"):
        full = missing.imputed(gone, how)
        assert full.where("y IS NULL").count() == 0
        assert full.where("NOT held_out").select("t", "src", "dst", "y").exceptAll(dyads).count() == 0


def test_diagnostics(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(2000)
    for k in range(1, 2000):
        x[k] = 0.7 * x[k - 1] + rng.normal()
    trace = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "iter long, x double")
    x0 = x - x.mean()
    rho = {r["lag"]: r["rho"] for r in diagnostics.acf(trace, 5).collect()}
    assert all(rho[k] == pytest.approx((x0[k:] * x0[: len(x) - k]).sum() / (x0**2).sum()) for k in range(6))
    assert 200 < diagnostics.ess(trace, 30).first()[0] < 700
    spread = diagnostics.spectrum0_ar(trace)
    assert spread == pytest.approx(1 / 0.3**2 / 2000, rel=0.35)
    z, p = diagnostics.geweke(trace)
    assert abs(z) < 4 and 0 <= p <= 1
    flat = spark.createDataFrame([(k, 1.0) for k in range(50)], "iter long, x double")
    assert diagnostics.spectrum0_ar(flat) == 0.0 and diagnostics.geweke(flat) == (0.0, 1.0)


def test_densities(spark):
    row = spark.range(1).select(
        scalar.dirichlet_logpdf(F.array(F.lit(0.2), F.lit(0.8)), F.array(F.lit(2.0), F.lit(3.0))).alias("d"),
        scalar.multivariate_t_logpdf(F.array(F.lit(1.0)), F.lit(1.0), F.array(F.lit(0.0)), F.lit(1.0)).alias("t"),
        scalar.truncated_normal_logpdf(F.lit(0.5), F.lit(0.5), F.lit(1e6), F.lit(0.0), F.lit(1.0)).alias("u"),
        scalar.softplus(F.lit(800.0)).alias("s"), scalar.expit(F.lit(-800.0)).alias("e"),
    ).first()
    assert row["d"] == pytest.approx(math.log(12 * 0.2 * 0.64)) and row["t"] == pytest.approx(math.log(1 / (2 * math.pi)))
    assert row["u"] == pytest.approx(0.0, abs=1e-4) and row["s"] == 800.0 and row["e"] == 0.0


def test_average_linkage():
    from .test_inference import average_linkage

    far = np.array([[0, 0.1, 0.9, 0.9], [0.1, 0, 0.8, 0.9], [0.9, 0.8, 0, 0.2], [0.9, 0.9, 0.2, 0]])
    assert average_linkage(far, 0.5).tolist() == [0, 0, 1, 1]
    assert average_linkage(far, 1.0).tolist() == [0, 0, 0, 0]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = snapshots.snapshot_stream(stream).writeStream.outputMode("update").format("memory").queryName("snaps").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT start, event_type, max(n) AS n FROM snaps GROUP BY start, event_type")
    want = network.window_snapshots(events.withColumn("ts", F.col("ts").cast("timestamp")), "5 days").groupBy("start", "event_type").agg(F.count("*").alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_plot_data(net):
    pairs = likelihood.probabilities(likelihood.distances(net["positions"]), likelihood.eta_undirected(1.0))
    m = plotdata.ordered_matrix(pairs, net["labels"])
    assert m.count() == 3 * 36 and m.agg(F.max("column")).first()[0] == 8
    ends = {(r["t"], r["z"]): r["upto"] for r in plotdata.group_boundaries(net["labels"]).collect()}
    assert all(ends[t, z] == (net["z"][t] <= z).sum() for t, z in ends)
    box = plotdata.latent_panels(net["positions"], net["labels"]).first()
    assert box["max0"] == net["x"][:, :, 0].max()
    assert plotdata.network_view(net["edges"], net["nodes"]).count() == net["edges"].count()


def test_drawn_controls_against_dense_forms(net):
    y, x, r = net["y"], net["x"], net["r"]
    drawn = likelihood.drawn_controls(net["positions"], net["edges"], 6).cache()
    rows = [tuple(c) for c in drawn.select("t", "src", "dst").collect()]
    assert len(set(rows)) == len(rows) and rows and all(i != j and not y[t, i, j] for t, i, j in rows)
    again = likelihood.drawn_controls(net["positions"].repartition(5), net["edges"], 6)
    assert drawn.exceptAll(again).count() == again.exceptAll(drawn).count() == 0
    eta = likelihood.eta_directed(0.8, 0.3)
    d = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(axis=3))
    e = 0.8 * (1 - d / r[None, None]) + 0.3 * (1 - d / r[None, :, None])
    value = y * e - np.logaddexp(0, e)
    want = np.zeros(3)
    for t in range(3):
        for i in range(9):
            own = [j for a, b, j in rows if (a, b) == (t, i)]
            want[t] += value[t, i, y[t, i] == 1].sum() + (8 - y[t, i].sum()) * (value[t, i, own].mean() if own else 0)
    got = {c["t"]: c["loglik"] for c in likelihood.sampled_loglikelihood(net["positions"], net["edges"], drawn, eta, net["radii"]).collect()}
    assert all(got[t] == pytest.approx(want[t]) for t in range(3))
    whole = likelihood.dyads(net["positions"], net["edges"], True).where("y = 0").select("t", "src", "dst")
    full = likelihood.sampled_loglikelihood(net["positions"], net["edges"], whole, eta, net["radii"]).agg(F.sum("loglik")).first()[0]
    assert full == pytest.approx(value[:, ~np.eye(9, dtype=bool)].sum())


def test_predictive_draws_follow_their_model(spark):
    """Shares of the groups drawn, and means and spreads of their places, over many samples of one node."""
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    n = 4000
    iters = spark.range(n).selectExpr("cast(id AS int) AS iter")
    last = iters.selectExpr("iter", "7 AS node", "array(2.0D, 0.0D) AS x", "0 AS z", "0.5D AS lmbda")
    trans = iters.join(one([(0, 0, 0.2), (0, 1, 0.5), (0, 2, 0.3), (1, 0, 1.0)], "k_from int, k_to int, w double"), how="cross")
    clusters = iters.join(one([(0, [0.0, 0.0], 1.0), (1, [10.0, 0.0], 4.0), (2, [0.0, 10.0], 0.25)], "k int, mu array<double>, sigma double"), how="cross")
    drawn = forecast.drawn_positions(last, trans, clusters).toPandas()
    assert len(drawn) == n
    for k, w, mu, var in ((0, 0.2, (1, 0), 1.0), (1, 0.5, (6, 0), 4.0), (2, 0.3, (1, 5), 0.25)):
        x = np.stack(drawn["x"][drawn["z"] == k].to_list())
        assert abs(len(x) / n - w) < 0.03
        assert np.abs(x.mean(axis=0) - mu).max() < 5 * math.sqrt(var / len(x)) and x.var(axis=0) == pytest.approx(var, rel=0.2)
    active = forecast.among_active(last.where("iter < 2"), trans, ["iter"]).collect()
    assert [(r["k_from"], r["k_to"], r["w"]) for r in active] == [(0, 0, 1.0)] * 2


def test_running_map(spark):
    trace = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (0, 2, 2.0), (0, 3, 3.0), (1, 0, -5.0), (1, 1, -6.0)], "chain int, iter int, logp double")
    got = sorted((r["chain"], r["iter"], r["best_iter"], r["best"]) for r in posterior.running_map(trace, ["chain"]).collect())
    assert got == [(0, 0, 0, 1.0), (0, 1, 1, 3.0), (0, 2, 1, 3.0), (0, 3, 1, 3.0), (1, 0, 0, -5.0), (1, 1, 0, -5.0)]


def test_lag_sums_send_a_row_to_its_block_and_count_gaps(spark):
    from tidegraph.operators import diagnostics, lags, spectra

    x = {i: (i * 37 % 11) - 4.5 for i in range(-300, 700) if i % 9 != 2 and not 100 < i < 160}
    rows = spark.createDataFrame([("a", i, v) for i, v in x.items()] + [("b", 3, 1.0), ("b", 4, None), ("b", None, 2.0)], "trace string, iter long, x double")
    asked = rows.withColumn("order", F.lit(40))
    assert lags.dealt(asked, ["trace"], 256).count() < 1.3 * len(x)  # not one for each lag
    got = {(r["trace"], r["lag"]): (r["ss"], r["pairs"]) for r in lags.lag_sums(asked, ["trace"], 256).collect()}
    for k in range(41):
        both = [x[i] * x[i - k] for i in x if i - k in x]
        assert got["a", k][1] == len(both) and abs(got["a", k][0] - sum(both)) < 1e-8
    assert got["b", 0] == (1.0, 2) and got["b", 1] == (0.0, 1) and got["b", 2] == (0.0, 0)
    sparse = spark.createDataFrame([("a", 2 * i, float(i % 5)) for i in range(50)], "trace string, iter long, x double")
    r = spectra.autocovariances(sparse, ["trace"]).first()["r"]
    assert len(r) == 17 and r[1] == 0.0  # lags without a pair keep their places
    assert [r["lag"] for r in diagnostics.autocovariances(sparse.drop("trace"), 4).orderBy("lag").collect()] == [0, 2, 4]


def test_views_join_the_large_tables_once(spark, sf_dir, monkeypatch):
    from tidegraph.sources.views import Tables

    made, trades = [], Tables.trades
    monkeypatch.setattr(Tables, "trades", lambda self: made.append(1) or trades(self))
    c = Tables(spark, sf_dir)
    read = [c.net(), c.cells(), c.positions(), c.dynamic_labels(), c.positions()]
    assert len(made) == 1
    assert not any("lineitem" in f for df in read for f in df.inputFiles())
    means = {(r["t"], r["src"]): (r["v"], r["q"]) for r in trades(c).groupBy("t", "src").agg(F.avg("value").alias("v"), F.avg("quantity").alias("q")).collect()}
    first = min(t for t, _ in means)
    v = np.array([means[k][0] for k in sorted(means) if k[0] == first])
    x = [r["x"][0] for r in c.positions().where(F.col("t") == first).orderBy("node").collect()]
    assert np.allclose(x, (v - v.mean()) / v.std())
