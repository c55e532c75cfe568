"""One step ahead: link probabilities for the step after the last, from a model or from its samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import expit, normal_pdf
from .likelihood import pairs_of


def next_positions(last: DataFrame, trans: DataFrame, clusters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, node, x: the mean of a node's next position over all clusters it may move to.

    last: keys, node, x, z, lmbda; trans: keys, k_from, k_to, w; clusters: keys, k, mu. keys: iter, for samples.
    """
    keys = keys or []
    moves = trans.withColumnRenamed("k_to", "k").join(clusters.select(*keys, "k", "mu"), [*keys, "k"])
    joined = last.join(moves, [last["z"] == moves["k_from"], *[last[c] == moves[c] for c in keys]])
    mean = F.zip_with("mu", "x", lambda m, x: F.col("lmbda") * m + (F.lit(1.0) - F.col("lmbda")) * x)
    dims = joined.select(*[last[c] for c in keys], last["node"], F.posexplode(F.transform(mean, lambda v: F.col("w") * v)).alias("dim", "v"))
    summed = dims.groupBy(*keys, "node", "dim").agg(F.sum("v").alias("v"))
    return summed.groupBy(*keys, "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("x"))


def pairs(positions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, i, j, d of all pairs of nodes, met by blocks."""
    return pairs_of(positions, keys or []).withColumnsRenamed({"src": "i", "dst": "j"})


def plug_in(positions: DataFrame, intercept: float) -> DataFrame:
    """i, j, p of forecast positions."""
    return pairs(positions).select("i", "j", expit(F.lit(float(intercept)) - F.col("d")).alias("p"))


def mean_positions(positions: DataFrame) -> DataFrame:
    """Positions forecast by each sample, averaged."""
    dims = positions.select("node", F.posexplode("x").alias("dim", "v")).groupBy("node", "dim").agg(F.avg("v").alias("v"))
    return dims.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("x"))


def marginal(target: DataFrame, last: DataFrame, trans: DataFrame, clusters: DataFrame, intercepts: DataFrame, p: int = 2) -> DataFrame:
    """i, j, p: link probabilities at target positions (node, x), each sample weighed by both nodes' densities there.

    last: iter, node, x, z, lmbda; trans: iter, k_from, k_to, w; clusters: iter, k, mu, sigma; intercepts: iter, b.
    """
    moves = trans.withColumnRenamed("k_to", "k").join(clusters, ["iter", "k"])
    at = target.select(F.col("node"), F.col("x").alias("at"))
    joined = last.join(at, "node").join(moves, (last["iter"] == moves["iter"]) & (last["z"] == moves["k_from"]))
    mean = F.zip_with("mu", "x", lambda m, x: F.col("lmbda") * m + (F.lit(1.0) - F.col("lmbda")) * x)
    density = joined.groupBy(last["iter"], "node").agg(F.sum(F.col("w") * normal_pdf("at", mean, "sigma", p)).alias("f"))
    side = lambda n, f: density.select("iter", F.col("node").alias(n), F.col("f").alias(f))
    weighed = pairs(target).join(side("i", "fi"), "i").join(side("j", "fj"), ["iter", "j"]).join(intercepts.select("iter", "b"), "iter")
    w = F.col("fi") * F.col("fj")
    return weighed.groupBy("i", "j").agg(F.try_divide(F.sum(w * expit(F.col("b") - F.col("d"))), F.sum(w)).alias("p"))


def monte_carlo(last: DataFrame, trans: DataFrame, clusters: DataFrame, intercept: float, n_samples: int = 5000, seed: int = 123) -> DataFrame:
    """i, j, p averaged over draws of the next labels and positions; draws are dealt over tasks by their numbers.

    The model (a row for each node, cluster and move) is the driver's; draws give sums, not rows, from each task.
    """
    import numpy as np
    import pandas as pd

    nodes = last.select("node", "x", "z", "lmbda").orderBy("node").toPandas()
    own = clusters.select("k", "mu", "sigma").orderBy("k").toPandas()
    place = {k: n for n, k in enumerate(own["k"])}
    w = np.zeros((len(own), len(own)))
    for r in trans.select("k_from", "k_to", "w").collect():
        w[place[r["k_from"]], place[r["k_to"]]] = r["w"]
    w = np.cumsum(w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300), axis=1)
    x, z = np.stack(nodes["x"].to_list()), np.array([place[k] for k in nodes["z"]])
    lam, mu, sd = nodes["lmbda"].to_numpy()[:, None], np.stack(own["mu"].to_list()), np.sqrt(own["sigma"].to_numpy())
    i, j = np.triu_indices(len(x), 1)
    ids = nodes["node"].to_numpy()

    def draw(batches):
        total, n = np.zeros(len(i)), 0
        for batch in batches:
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                to = np.minimum((rng.random(len(x))[:, None] > w[z]).sum(axis=1), len(own) - 1)
                y = lam * mu[to] + (1 - lam) * x + rng.normal(size=x.shape) * sd[to][:, None]
                total += 1 / (1 + np.exp(np.sqrt(((y[i] - y[j]) ** 2).sum(axis=1)) - intercept))
                n += 1
        if n:
            yield pd.DataFrame({"i": ids[i], "j": ids[j], "total": total, "n": n})

    drawn = last.sparkSession.range(n_samples).mapInPandas(draw, "i int, j int, total double, n long")
    return drawn.groupBy("i", "j").agg((F.sum("total") / F.sum("n")).alias("p"))


def among_active(last: DataFrame, trans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """trans between the groups that have nodes at the last step, in each sample, with rows that sum to 1 again.

    last: keys, node, x, z; trans: keys, k_from, k_to, w. A move from or into a group without nodes is gone; a group whose
    moves all weigh nothing gets null weights.
    """
    keys = keys or []
    used = last.select(*keys, "z").distinct()
    kept = trans
    for side in ("k_from", "k_to"):
        kept = kept.join(used.withColumnRenamed("z", side), [*keys, side], "left_semi")
    return kept.select(*keys, "k_from", "k_to", F.try_divide(F.col("w"), F.sum("w").over(W.partitionBy(*keys, "k_from"))).alias("w"))


def hashed_uniform(seed: int = 123):
    """The k-th uniform number, between 0 and 1, of a sample's node: a function of seed, iter, node and k alone."""
    bits = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("iter"), F.col("node")), 11)
    return lambda k: (bits(k) + F.lit(0.5)) * F.lit(2.0**-53)


def drawn_positions(last: DataFrame, trans: DataFrame, clusters: DataFrame, uniform=None) -> DataFrame:
    """iter, node, z, x: a draw of every node's next group and place in every sample, in two dimensions.

    last: iter, node, x, z, lmbda; trans: iter, k_from, k_to, w; clusters: iter, k, mu, sigma. Moves are gathered by sample
    and group, a few numbers each, with their running sums; a node takes the first move whose sum reaches its number.
    Places use the polar form of two uniform numbers.
    """
    uniform = uniform or hashed_uniform()
    moves = trans.withColumnRenamed("k_to", "k").join(clusters, ["iter", "k"]).groupBy("iter", "k_from").agg(F.sort_array(F.collect_list(F.struct("k", "w", "mu", "sigma"))).alias("moves"))
    upto = F.transform("moves", lambda m, i: F.struct(m["k"].alias("k"), m["mu"].alias("mu"), m["sigma"].alias("sigma"), F.aggregate(F.slice("moves", F.lit(1), i + 1), F.lit(0.0), lambda a, v: a + v["w"]).alias("upto")))
    moves = moves.select(F.col("iter").alias("at"), "k_from", upto.alias("moves"))
    joined = last.join(moves, (F.col("iter") == F.col("at")) & (F.col("z") == F.col("k_from")))
    mark = uniform(0) * F.element_at("moves", -1)["upto"]
    reached = F.filter("moves", lambda m: m["upto"] >= F.col("mark"))
    to = joined.withColumn("mark", mark).withColumn("to", F.coalesce(F.try_element_at(reached, F.lit(1)), F.element_at("moves", -1)))
    radius, angle = F.sqrt(F.lit(-2.0) * F.log(uniform(1)) * F.col("to.sigma")), F.lit(2 * math.pi) * uniform(2)
    mean = lambda d: F.col("lmbda") * F.col("to.mu")[d] + (F.lit(1.0) - F.col("lmbda")) * F.col("x")[d]
    return to.select("iter", "node", F.col("to.k").alias("z"), F.array(mean(0) + radius * F.cos(angle), mean(1) + radius * F.sin(angle)).alias("x"))


def posterior_predictive(last: DataFrame, trans: DataFrame, clusters: DataFrame, intercepts: DataFrame, uniform=None) -> DataFrame:
    """i, j, p: link probabilities averaged over one draw of the next step from every sample.

    As marginal takes them; uniform(k) gives a column of uniform numbers. Pairs are summed before they move.
    """
    pos = drawn_positions(last, trans, clusters, uniform).select("iter", "node", "x")
    scored = pairs(pos, ["iter"]).join(intercepts.select("iter", "b"), "iter")
    return scored.groupBy("i", "j").agg(F.avg(expit(F.col("b") - F.col("d"))).alias("p"))
