"""Scaling, weighted paths, trajectories, spectra and variates against dense and plain forms."""

import itertools
import math
import random

import numpy as np
from py4j.java_gateway import GatewayClient
from pyspark.sql import functions as F

from tidegraph.functions import scalar, variates
from tidegraph.operators import diagnostics, draws, missing, network, scaling, spectra, trajectories


def _table(spark, d):
    return spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(d)) for j in range(len(d))], "src int, dst int, d double")


def test_leading_eigenvectors_and_stress(spark):
    rng = np.random.default_rng(0)
    n = 11
    x0 = rng.normal(0, 1, (n, 2)) + 3
    d = np.abs(rng.normal(3, 1, (n, n)))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    far, before = _table(spark, d), spark.createDataFrame([(i, x0[i].tolist()) for i in range(n)], "node int, x array<double>")
    got = np.array([r.x for r in scaling.leading(far, before, n).orderBy("node").collect()])
    h = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(h @ (-0.5 * d**2) @ h / 11 + 10 / 11 * x0 @ x0.T)
    want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-3
    turned = np.array([r.x for r in scaling.turned(before, spark.createDataFrame([(i, (x0[i] @ [[0.0, 1.0], [-1.0, 0.0]]).tolist()) for i in range(n)], "node int, x array<double>")).orderBy("node").collect()])
    assert np.allclose(turned, x0)
    nodes = before.select("node")
    x = np.array([r.x for r in scaling.smacof(far, nodes, rounds=6).orderBy("node").collect()])
    u = np.array([r.x for r in scaling.started(nodes, 2).orderBy("node").collect()])
    for _ in range(6):
        apart = np.sqrt(((u[:, None] - u[None]) ** 2).sum(-1))
        b = -np.divide(d, apart, out=np.zeros_like(d), where=apart > 0)
        b[np.arange(n), np.arange(n)] = -b.sum(axis=1)
        u = b @ u / n
    assert np.allclose(x, u)


def test_a_round_is_few_calls_to_the_jvm(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x0 = rng.normal(0, 1, (9, 2))
    d = np.sqrt(((x0[:, None] - x0[None]) ** 2).sum(-1)) + 0.1 * (1 - np.eye(9))
    far, before = _table(spark, d), spark.createDataFrame([(i, x0[i].tolist()) for i in range(9)], "node int, x array<double>")
    sent, tables, send, write = [0], [0], GatewayClient.send_command, scaling.written

    def counted(self, *args, **how):
        sent[0] += 1
        return send(self, *args, **how)

    def kept(df, name):
        tables[0] += 1
        return write(df, name)

    monkeypatch.setattr(GatewayClient, "send_command", counted)
    monkeypatch.setattr(scaling, "written", kept)
    scaling.leading(far, before, 9, rounds=3, tol=0.0)
    assert tables[0] == 4 and 0 < sent[0] < 1000 * tables[0]  # sums cell by cell were over ten thousand calls a round


def test_weighted_paths(spark):
    rng = random.Random(3)
    rows = [(t, a, b, rng.choice([0.25, 1.0, 2.5, 7.0])) for t in (1, 2) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.15]
    rows += [(1, 3, 3, 1.0), (1, 0, 1, -2.0), (1, 5, 4, 0.5), (1, 4, 5, 9.0)]
    got = {(r.t, r.src, r.dst): r.d for r in network.weighted_shortest_paths(spark.createDataFrame(rows, "t int, src int, dst int, w double"), spark.createDataFrame([(i,) for i in range(15)], "node int")).collect()}
    assert len(got) == 2 * 15 * 15
    for t in (1, 2):
        d = np.full((15, 15), np.inf)
        np.fill_diagonal(d, 0)
        for s, a, b, w in rows:
            if s == t and a != b and w > 0:
                d[a, b] = d[b, a] = min(d[a, b], w)
        for k in range(15):
            d = np.minimum(d, d[:, [k]] + d[[k]])
        d[np.isinf(d)] = d[~np.isinf(d)].max() + 1
        assert all(abs(got[t, a, b] - d[a, b]) < 1e-9 for a in range(15) for b in range(15))


def test_trajectories_with_gaps_and_seeds(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    rows = [(t, i, (centres[i % 3] + rng.normal(0, 0.3, 2)).tolist()) for i in range(60) for t in range(4) if (i, t) not in {(0, 1), (7, 0), (7, 3)}]
    positions = spark.createDataFrame(rows, "t int, node int, x array<double>")
    found = trajectories.kmeans(positions, 3)
    labels = {r.node: r.z for r in found.labels.collect()}
    assert found.settled and len(labels) == 60 and all(labels[i] == labels[i % 3] for i in range(60)) and len({labels[0], labels[1], labels[2]}) == 3
    for r in trajectories.summary(positions, found).collect():
        own = next(k for k in range(3) if labels[k] == r.k)
        assert np.allclose(r.mu, centres[own], atol=0.2) and 0.03 < r.variance < 0.3
    few = trajectories.kmeans(positions.where("node < 2"), 4)  # fewer nodes than labels
    assert len({r.z for r in few.labels.collect()}) == 2


def test_spectra_are_those_of_one_trace(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k, phi in enumerate((0.0, 0.8, -0.5)):
        x = 0.0
        for i in range(120):
            x = phi * x + rng.normal()
            rows.append((k, i + 10 * k, x))
    rows += [(9, i, 4.0) for i in range(30)] + [(8, 5, 1.0)]
    traces = spark.createDataFrame(rows, "chain int, iter int, x double")
    got = {r.chain: r.spectrum0 for r in spectra.spectra(traces, ["chain"]).collect()}
    scores = {r.chain: (r.z, r.p) for r in spectra.geweke(traces, ["chain"]).collect()}
    for k in range(3):
        one = traces.where(F.col("chain") == k).select("iter", "x")
        assert abs(got[k] - diagnostics.spectrum0_ar(one)) < 1e-9 * max(1, got[k])
        z, p = diagnostics.geweke(one)
        assert abs(scores[k][0] - z) < 1e-9 and abs(scores[k][1] - p) < 1e-9
    assert got[9] == 0.0 and got[8] == 0.0 and scores[9] == (0.0, 1.0)
    late = {r.chain: r.z for r in spectra.geweke(traces, ["chain"], n_burn=40).collect()}
    assert abs(late[1] - diagnostics.geweke(traces.where("chain = 1 AND iter >= 40").select("iter", "x"))[0]) < 1e-9


def test_special_functions(spark):
    xs = [-30.0, -5.0, -2.9, -0.3, 0.0, 1.0, 2.83, 4.0, 6.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.log_normal_cdf("x").alias("l"), scalar.normal_quantile(scalar.normal_cdf("x")).alias("q")).collect():
        want = math.log(0.5 * math.erfc(-r.x / math.sqrt(2)))
        assert abs(r.l - want) < 1e-11 * max(1, abs(want)) and (abs(r.x) > 5 or abs(r.q - r.x) < 1e-6)
    for r in spark.createDataFrame([(x,) for x in (1e-6, 0.3, 0.5, 1.0, 3.7, 1e4)], "x double").select("x", scalar.lgamma("x").alias("l")).collect():
        assert abs(r.l - math.lgamma(r.x)) < 1e-10 * max(1, abs(r.l))
    far = scalar.truncated_normal_logpdf(F.lit(31.0), F.lit(0.0), F.lit(1.0), F.lit(30.0), F.lit(40.0))  # deep in the tail
    assert abs(spark.range(1).select(far.alias("v")).first().v - (-0.5 * (31**2 - 30**2) + math.log(30 + 1 / 30))) < 1e-3


def test_variates_have_their_moments(spark):
    u = draws.hashed_uniform(5)
    of = lambda *more: u(F.col("id"), *more) + F.lit(1e-17)
    rows = spark.range(4000).select(
        variates.gamma(F.lit(0.4), of).alias("a"), variates.gamma(F.lit(3.5), of).alias("b"), variates.dirichlet(F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0)), lambda i, k: of(i, k)).alias("w"),
        variates.truncated_normal(F.lit(1.0), F.lit(4.0), F.lit(2.0), F.lit(3.0), of(F.lit(1))).alias("t"), variates.tables(F.lit(50), F.lit(2.0), of).alias("m"),
    ).agg(F.avg("a"), F.avg("b"), F.var_samp("b"), F.avg(F.col("w")[2]), F.max(F.abs(scalar.total("w") - 1)), F.min("t"), F.max("t"), F.avg("t"), F.avg("m")).first()
    a, b, vb, w2, off, low, high, mean, m = rows
    assert abs(a - 0.4) < 0.05 and abs(b - 3.5) < 0.15 and abs(vb - 3.5) < 0.4 and abs(w2 - 0.625) < 0.02 and off < 1e-12
    assert 2 <= low and high <= 3 and abs(mean - 2.46) < 0.03
    assert abs(m - sum(2 / (2 + i) for i in range(50))) < 0.2


def test_split_of_tied_orders(spark):
    rows = [(t, i, j, (i + j) % 2) for t in (0, 1) for i, j in itertools.combinations(range(20 if t else 3), 2)]
    dyads = spark.createDataFrame(rows, "t int, src int, dst int, y int")
    for order, rank in ((F.col("src") % 3, lambda r: (r[1] % 3, r[1], r[2])), (F.lit(1.0), lambda r: r[1:3])):
        got = {(r.t, r.src, r.dst) for r in missing.train_test_split(dyads, 0.3, order).where("held_out").collect()}
        want = set()
        for t in (0, 1):
            own = sorted((r for r in rows if r[0] == t), key=rank)
            want |= {r[:3] for r in own[: math.ceil(0.3 * len(own))]}
        assert got == want
    assert missing.train_test_split(dyads, 0).where("held_out").count() == 0 and missing.train_test_split(dyads, 10**6).where("NOT held_out").count() == 0
