import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.operators import metrics
from tidegraph.plans import initial, kernel, models, simulate

SHORT = {"n_iter": 60, "tune": 100, "burn": 60, "tune_interval": 25}


@pytest.fixture(scope="module")
def network(spark):
    sim = simulate.simulate(spark, "homogeneous", [3], n=24, steps=2).cache()
    nodes = spark.createDataFrame([(i,) for i in range(24)], "node int")
    steps = spark.createDataFrame([(t,) for t in range(3)], "t int")
    return simulate.edges_of(sim, 3), nodes, steps, simulate.labels_of(sim, 3)


@pytest.fixture(scope="module")
def fitted(spark, network):
    edges, nodes, steps, _ = network
    gone = spark.createDataFrame([(0, 1, 2), (1, 3, 7), (2, 0, 5)], "t int, src int, dst int")
    return {kind: kind(spark, chains=2, n_components=8, thin=2, **SHORT).fit(edges, nodes, steps, gone) for kind in (models.LSM, models.LPCM, models.HDPLPCM)}


@pytest.mark.parametrize("kind", [models.LSM, models.LPCM, models.HDPLPCM])
def test_samples_and_fit(fitted, kind):
    fit = fitted[kind]
    assert fit.scalars().count() == 2 * 30
    assert fit.positions().count() == 2 * 30 * 3 * 24
    assert fit.auc() > 0.75
    p = fit.probabilities().collect()
    assert len(p) == 3 * 276 and sum(r["y"] is None for r in p) == 3 and all(0 <= r["p"] <= 1 for r in p)
    m = fit.missing_probabilities().collect()
    assert len(m) == 3 and all(0 <= r["y"] <= 1 for r in m)


def test_groups_are_found(fitted, network):
    fit = fitted[models.HDPLPCM]
    truth = network[3].withColumnRenamed("z", "b")
    for by in ("vi", "map"):
        at = fit.select(by)
        labels = fit._at(fit.labels(), at).withColumnRenamed("z", "a").join(truth, ["t", "node"])
        assert metrics.adjusted_rand(labels).first()["ari"] > 0.3
    table = fit.bic_table().collect()
    assert table and all(np.isfinite(r["bic"]) for r in table) and fit.select("bic")[0] == 0
    co = fit.cooccurrence().collect()
    assert all(r["p"] == 1 for r in co if r["i"] == r["j"]) and all(0 < r["p"] <= 1 for r in co)
    assert fit.linkage(0).count() == 24


@pytest.mark.parametrize("kind", ["map", "plugin", "marginal", "monte_carlo", "posterior_predictive"])
def test_forecasts(fitted, kind):
    p = fitted[models.HDPLPCM].forecast(kind, n_samples=200).collect()
    assert len(p) == 276 and all(0 <= r["p"] <= 1 for r in p)


@pytest.mark.parametrize("kind", ["map", "marginal", "monte_carlo", "posterior_predictive"])
def test_forecasts_among_groups_in_use(fitted, kind):
    p = fitted[models.HDPLPCM].forecast(kind, n_samples=50, renormalise=True).collect()
    assert len(p) == 276 and all(0 <= r["p"] <= 1 for r in p)


def test_the_best_model_is_taken(fitted):
    fit = models.Fit(*(getattr(fitted[models.HDPLPCM], n) for n in ("rows", "edges", "missing", "nodes", "steps", "config")))
    at = fit.set_best_model("mode").best
    groups = fit._at(fit.labels(), at).select("z").distinct().count()
    counts = [r["n"] for r in fit.labels().where("chain = 0").groupBy("iter").agg(F.countDistinct("z").alias("n")).collect()]
    assert groups == min(sorted(set(counts)), key=lambda k: (-counts.count(k), k))
    assert fit.auc() == pytest.approx(fit.auc(at)) and fit.forecast("map").count() == 276


def test_traces_are_deleted(spark, network, tmp_path):
    import os

    edges, nodes, steps, _ = network
    fits = [models.LSM(spark, n_iter=3, tune=2, burn=2).fit(edges, nodes, steps) for _ in range(2)]
    folders = [os.path.dirname(f.rows.inputFiles()[0]).replace("file://", "") for f in fits]
    assert all(map(os.path.isdir, folders))
    fits[0].delete_traces()
    assert not os.path.isdir(folders[0]) and os.path.isdir(folders[1])
    assert fits[0].positions().count() == 0 and fits[1].positions().count() == 3 * 3 * 24


def test_a_seed_stands_for_its_chain(spark, network):
    edges, nodes, steps, _ = network
    est = models.LSM(spark, chains=2, seed=5, n_iter=5, tune=5, burn=5)
    a = models.sample(est.jobs(edges.repartition(5), 24, 3)).where("part = 'logp'")
    b = models.sample(est.jobs(edges.coalesce(1), 24, 3).coalesce(1)).where("part = 'logp'")
    rows = lambda df: sorted((r["chain"], r["iter"], r["v"]) for r in df.collect())
    assert rows(a) == rows(b) and len({v for _, _, v in rows(a)}) > 5


def test_directed_with_controls(spark):
    s = simulate.splitting(np.random.default_rng(2), n=20, steps=2, directed=True)
    t, i, j = (v.tolist() for v in np.nonzero(s["y"]))
    edges = spark.createDataFrame(list(zip(t, i, j)), "t int, src int, dst int")
    nodes, steps = spark.range(20).selectExpr("cast(id AS int) AS node"), spark.range(2).selectExpr("cast(id AS int) AS t")
    for config in ({}, {"n_control": 5}, {"n_control": 0.25}):
        fit = models.LSM(spark, directed=True, n_iter=20, tune=20, burn=20, step_x=0.0075, sigma_sq=0.001, **config).fit(edges, nodes, steps)
        assert fit.auc() > 0.6
        r = fit.radii().groupBy("iter").agg(F.sum("r").alias("r")).collect()
        assert all(x["r"] == pytest.approx(1.0) for x in r)
        assert fit.probabilities().count() == 2 * 380


def test_controls_are_for_directed_networks():
    with pytest.raises(ValueError):
        kernel.Chain(np.zeros((1, 4, 4)), kernel.Config(kind="lsm", n_control=2), 1)
    chain = kernel.Chain(np.zeros((1, 8, 8)), kernel.Config(kind="lsm", directed=True, n_control=0.5, tune=0, burn=0), 1)
    assert all(len(j) == 4 and (w == 7 / 4).all() for j, w in chain.out[0])


def test_steps_may_have_their_own_centres():
    x = np.random.default_rng(1).normal(size=(3, 30, 2)) + np.arange(3)[:, None, None]
    fixed = initial.kmeans_labels(x, 4, np.random.default_rng(2))
    own = initial.kmeans_labels(x, 4, np.random.default_rng(2), fixed_clusters=False)
    assert (fixed[0] == own[0]).all() and own[1].shape == (3, 4, 2)
    for k in range(4):
        assert own[1][:, k] == pytest.approx(x[:, own[0] == k].mean(axis=1)) and own[1][:, k].mean(axis=0) == pytest.approx(fixed[1][k])
