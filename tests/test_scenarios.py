import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.operators import likelihood, posterior
from tidegraph.plans import simulate
from tidegraph.sources import loaders


def test_merging_puts_all_nodes_in_one_group_from_the_fourth_step_on():
    z = simulate.merging(np.random.default_rng(1))["z"]
    assert set(z[3]) == set(z[4]) == {2} and set(z[0]) == {0, 1} and len(set(z[2])) > 1


@pytest.mark.parametrize("scenario", [simulate.inhomogeneous, simulate.splitting_and_merging])
def test_four_first_groups_stay_and_nodes_with_them(scenario):
    z = scenario(np.random.default_rng(3), n=400)["z"]
    assert set(z[-1]) <= {0, 1, 2, 3} and set(z[-4]) <= {0, 1, 2, 3} and max(z[-5]) > 3
    old, new = z[-5], z[-4]
    assert (old[old < 4] == new[old < 4]).mean() > 0.8  # the sticky weight holds at unchanged places


def test_crossing_weighs_unchanged_places():
    old, new = np.array([[0.0, 0], [4, 0], [0, 5]]), np.array([[0.0, 0], [4, 0]])
    w = simulate.crossing(old, new, 20.0)
    assert w[0] == pytest.approx([20 / 21, 1 / 21]) and w[1] == pytest.approx([1 / 21, 20 / 21])
    d = np.array([1 / 5, 1 / np.sqrt(41)])
    assert w[2] == pytest.approx(d / d.sum())
    assert simulate.crossing(old, new)[0] == pytest.approx([0.5, 0.5])


def test_forecasts_of_a_scenario():
    s = simulate.homogeneous(np.random.default_rng(4), n=30, steps=2)
    assert s["ahead"].shape == (30, 30) and (s["ahead"] == s["ahead"].T).all() and 0 <= s["ahead"].min() <= s["ahead"].max() < 0.74
    rng, x, z, w = np.random.default_rng(5), np.array([[0.0, 0], [3, 4]]), np.array([0, 1]), np.eye(2)
    centres = np.array([[1.0, 0], [2, 0]])
    mean = 0.5 * centres + 0.5 * x
    plain = 1 / (1 + np.exp(np.linalg.norm(mean[0] - mean[1]) - 1.0))
    assert simulate.forecast_map(x, z, w, 0.5, centres, 1.0)[0, 1] == pytest.approx(plain)
    assert simulate.forecast(rng, x, z, w, 0.5, centres, np.full(2, 1e-9), 1.0, 10)[0, 1] == pytest.approx(plain)


def test_rows_of_a_forecast(spark):
    sim = simulate.simulate(spark, "homogeneous", [1], n=20, steps=2)
    assert sim.where("part = 'ahead' AND t = 2 AND p BETWEEN 0 AND 1 AND i < j").count() == 190


def test_a_place_far_from_all_groups_has_a_likelihood(spark):
    pos = spark.createDataFrame([(0, 0, [60.0, 0.0]), (1, 0, [60.0, 1.0]), (0, 1, [0.0, 0.0]), (1, 1, [0.0, 80.0])], "t int, node int, x array<double>")
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    init, trans = one([(0, 1.0), (1, 0.0)], "k int, w double"), one([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.0), (1, 1, 1.0)], "k_from int, k_to int, w double")
    clusters = one([(0, [0.0, 0.0], 1.0), (1, [1.0, 0.0], 1.0)], "k int, mu array<double>, sigma double")
    got = {r["node"]: r["loglik"] for r in posterior.forward_loglik(pos, init, trans, clusters, 0.5).collect()}
    logpdf = lambda x, m: -np.log(2 * np.pi) - ((np.array(x) - m) ** 2).sum() / 2
    for node, (a, b) in {0: ([60.0, 0], [60.0, 1]), 1: ([0.0, 0], [0.0, 80])}.items():
        ends = [np.log(0.5) + logpdf(b, 0.5 * np.array(m) + 0.5 * np.array(a)) for m in ([0.0, 0], [1.0, 0])]
        assert got[node] == pytest.approx(logpdf(a, np.zeros(2)) + np.logaddexp(*ends))


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("blocks", [1, 3])
def test_blocks_give_every_pair_once(spark, directed, blocks):
    pos = spark.range(40).select((F.col("id") % 2).cast("int").alias("t"), (F.col("id") / 2).cast("int").alias("node"), F.array(F.col("id").cast("double")).alias("x"))
    got = sorted((r["t"], r["src"], r["dst"]) for r in likelihood.distances(pos, directed, blocks=blocks).collect())
    assert got == [(t, i, j) for t in range(2) for i in range(20) for j in range(20) if (i != j if directed else i < j)]


def test_no_edge_is_dropped_unasked(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Source,Target,Weight,Season\nA,B,3,1\nB,C,20,1\nC,D,1,2\n")
    edges, nodes = loaders.interactions(spark, str(tmp_path / "e.csv"))
    assert edges.count() == 6 and nodes.count() == 4
    edges, nodes = loaders.interactions(spark, str(tmp_path / "e.csv"), [1], 10)
    assert edges.count() == 2 and nodes.count() == 2


def test_directed_alliances(spark, tmp_path):
    (tmp_path / "k.txt").write_text("0 1 0\n0 0 2\n0 0 0\n")
    (tmp_path / "c.csv").write_text("name\nx\ny\nz\n")
    edges, nodes = loaders.alliances(spark, [str(tmp_path / "k.txt")], str(tmp_path / "c.csv"), remove_periphery=False, directed=True)
    assert sorted((r["t"], r["src"], r["dst"]) for r in edges.collect()) == [(0, 0, 1), (0, 1, 2)] and nodes.count() == 3
