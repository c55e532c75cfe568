"""Link probabilities, log-likelihoods, gradients and priors as joins and sums over dyads.

A dyad table has t, src, dst, y, distance d and, for directed networks, radii. It is the likelihood's own domain (every
pair of nodes of a step), made by an equi-join of positions on the step and a pair of node blocks; nothing wider than
positions is in it, so sums over it are aggregated on the map side and shuffle one row for each step and task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import METRICS, distance, expit, normal_logpdf, softplus, squared_distance


def pairs_of(positions: DataFrame, keys: list[str], directed: bool = False, squared: bool = False, blocks: int = 8, carried: tuple[str, ...] = (), metric: str | Callable[[str, str], Column] = "euclidean") -> DataFrame:
    """keys, src, dst, d of all pairs of nodes (node, x) that agree in keys: each once, or in both directions.

    metric: a name of METRICS, or a function of two array columns; squared goes with the Euclidean one.
    carried: more columns of positions, which come out for both ends, with _src and _dst behind their names.

    Nodes are dealt to blocks, and the pairs of two blocks meet by themselves, so that the pairs of a step or a sample
    are the work of blocks x blocks groups; a position is sent once for each block.
    """
    block = F.pmod(F.xxhash64("node"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = positions.select(*keys, F.col("node").alias("src"), F.col("x").alias("xs"), *[F.col(c).alias(f"{c}_src") for c in carried], block.alias("a_block"), every.alias("a_other"))
    b = positions.select(*[F.col(c).alias(f"{c}_b") for c in keys], F.col("node").alias("dst"), F.col("x").alias("xd"), *[F.col(c).alias(f"{c}_dst") for c in carried], block.alias("b_block"), every.alias("b_other"))
    meet = (F.col("a_block") == F.col("b_other")) & (F.col("a_other") == F.col("b_block"))
    for c in keys:
        meet = meet & (F.col(c) == F.col(f"{c}_b"))
    pair = (F.col("src") != F.col("dst")) if directed else (F.col("src") < F.col("dst"))
    of = squared_distance if squared else METRICS[metric] if isinstance(metric, str) else metric
    ends = [f"{c}_{side}" for c in carried for side in ("src", "dst")]
    return a.join(b, meet & pair).select(*keys, "src", "dst", of("xs", "xd").alias("d"), *ends)


def distances(positions: DataFrame, directed: bool = False, squared: bool = False, blocks: int = 8, metric: str | Callable[[str, str], Column] = "euclidean") -> DataFrame:
    """t, src, dst, d of all pairs of a step: each once, or in both directions."""
    return pairs_of(positions, ["t"], directed, squared, blocks, metric=metric)


def dyads(positions: DataFrame, edges: DataFrame, directed: bool = False, radii: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """distances with y (null where the dyad is among the missing ones), and r_src and r_dst where radii are given."""
    links = edges.select("t", "src", "dst").distinct() if directed else edges.where("src <> dst").select("t", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    keys = ["t", "src", "dst"]
    out = distances(positions, directed).join(links.withColumn("link", F.lit(1)), keys, "left").withColumn("y", F.coalesce("link", F.lit(0))).drop("link")
    if missing is not None:
        gone = missing.select(*keys).distinct().withColumn("gone", F.lit(True))
        out = out.join(gone, keys, "left").withColumn("y", F.when(F.col("gone").isNull(), F.col("y"))).drop("gone")
    if radii is not None:
        for side in ("src", "dst"):
            out = out.join(radii.select(F.col("node").alias(side), F.col("r").alias(f"r_{side}")), side)
    return out


def eta_undirected(intercept) -> Column:
    return F.lit(float(intercept)) - F.col("d")


def eta_directed(b_in, b_out) -> Column:
    d = F.col("d")
    return F.lit(float(b_in)) * (F.lit(1.0) - d / F.col("r_dst")) + F.lit(float(b_out)) * (F.lit(1.0) - d / F.col("r_src"))


def probabilities(pairs: DataFrame, eta: Column) -> DataFrame:
    return pairs.withColumn("p", expit(eta))


def term(eta: Column) -> Column:
    """A dyad's log-likelihood; null where y is."""
    return F.col("y") * eta - softplus(eta)


def loglikelihood(pairs: DataFrame, eta: Column, by: list[str] | None = None) -> DataFrame:
    value = F.sum(term(eta)).alias("loglik")
    return pairs.groupBy(*by).agg(value) if by else pairs.agg(value)


def partial_loglikelihood(pairs: DataFrame, eta: Column, node: int) -> DataFrame:
    """The terms of one node at each step."""
    return loglikelihood(pairs.where((F.col("src") == node) | (F.col("dst") == node)), eta, ["t"])


def intercept_gradient(pairs: DataFrame, intercept: float) -> DataFrame:
    return pairs.agg(F.sum(F.col("y") - expit(eta_undirected(intercept))).alias("grad"))


def scale_gradient(pairs: DataFrame, intercept: float, scale: float) -> DataFrame:
    """By the log of a factor on all distances; each dyad counts once, as in the likelihood."""
    stretched = F.exp(F.lit(float(scale))) * F.col("d")
    return pairs.agg(F.sum(-stretched * (F.col("y") - expit(F.lit(float(intercept)) - stretched))).alias("grad"))


def directed_gradient(pairs: DataFrame, b_in: float, b_out: float) -> DataFrame:
    rest = F.col("y") - expit(eta_directed(b_in, b_out))
    one = F.lit(1.0)
    return pairs.agg(F.sum((one - F.col("d") / F.col("r_dst")) * rest).alias("grad_in"), F.sum((one - F.col("d") / F.col("r_src")) * rest).alias("grad_out"))


def case_control_loglikelihood(pairs: DataFrame, eta: Column, chosen: Column) -> DataFrame:
    """Out-edges of every node whole, its non-edges by a part of them (where chosen holds), weighed up to all of them.

    Nodes whose part is empty add nothing for their non-edges.
    """
    value = term(eta)
    none = F.col("y") == 0
    by_node = pairs.groupBy("t", "src").agg(
        F.sum(F.when(~none, value).otherwise(0.0)).alias("edges"),
        F.sum(F.when(none & chosen, value).otherwise(0.0)).alias("controls"),
        F.sum(F.when(none, 1.0).otherwise(0.0)).alias("n"),
        F.sum(F.when(none & chosen, 1.0).otherwise(0.0)).alias("m"),
    )
    scaled = F.when(F.col("m") > 0, F.col("n") / F.nullif(F.col("m"), F.lit(0.0)) * F.col("controls")).otherwise(0.0)
    return by_node.groupBy("t").agg(F.sum(F.col("edges") + scaled).alias("loglik"))


def drawn_controls(positions: DataFrame, edges: DataFrame, n_control: int, pick: Column | None = None, seed: int = 123) -> DataFrame:
    """t, src, dst: for every node of a step up to n_control others that it has no edge to.

    Nodes are numbered 0 to n-1. pick is the number of the k-th control of src at t, of the columns t, src, k and n (how
    many nodes the step has); by default a hash. Repeated picks count once, and src itself and its edges are taken out,
    so that the work grows with nodes and edges, not with pairs.
    """
    pick = F.pmod(F.xxhash64(F.lit(seed), "t", "src", "k"), F.col("n")) if pick is None else pick
    sizes = positions.groupBy("t").agg(F.count("*").alias("n"))
    slots = positions.select("t", F.col("node").alias("src")).join(F.broadcast(sizes), "t").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_control - 1))))
    drawn = slots.select("t", "src", pick.cast("int").alias("dst")).where("src <> dst").distinct()
    return drawn.join(edges.select("t", "src", "dst"), ["t", "src", "dst"], "left_anti")


def _placed(links: DataFrame, positions: DataFrame, radii: DataFrame | None = None) -> DataFrame:
    """links (t, src, dst and more) with the distance d, and the radii of both ends."""
    a = positions.select("t", F.col("node").alias("src"), F.col("x").alias("xs"))
    b = positions.select("t", F.col("node").alias("dst"), F.col("x").alias("xd"))
    out = links.join(a, ["t", "src"]).join(b, ["t", "dst"]).withColumn("d", distance("xs", "xd")).drop("xs", "xd")
    if radii is not None:
        for side in ("src", "dst"):
            out = out.join(radii.select(F.col("node").alias(side), F.col("r").alias(f"r_{side}")), side)
    return out


def sampled_loglikelihood(positions: DataFrame, edges: DataFrame, controls: DataFrame, eta: Column, radii: DataFrame | None = None) -> DataFrame:
    """t, loglik as case_control_loglikelihood has it, from the edges and drawn controls (t, src, dst) alone.

    A node's non-edges are counted from its degree, and its controls are weighed up to them.
    """
    links = edges.where("src <> dst").select("t", "src", "dst").distinct().withColumn("y", F.lit(1)).union(controls.select("t", "src", "dst", F.lit(0)))
    value = term(eta)
    one = F.col("y") == 1
    by_node = _placed(links, positions, radii).groupBy("t", "src").agg(
        F.sum(F.when(one, value).otherwise(0.0)).alias("edges"),
        F.sum(F.when(~one, value).otherwise(0.0)).alias("controls"),
        F.sum(F.when(one, 1.0).otherwise(0.0)).alias("degree"),
        F.sum(F.when(~one, 1.0).otherwise(0.0)).alias("m"),
    )
    sizes = positions.groupBy("t").agg(F.count("*").alias("n"))
    rest = F.col("n") - F.lit(1.0) - F.col("degree")
    scaled = F.coalesce(F.try_divide(rest, F.col("m")) * F.col("controls"), F.lit(0.0))
    return by_node.join(F.broadcast(sizes), "t").groupBy("t").agg(F.sum(F.col("edges") + scaled).alias("loglik"))


def sampled_partial_loglikelihood(positions: DataFrame, edges: DataFrame, controls: DataFrame, eta: Column, node: int) -> DataFrame:
    """t, loglik of one node of an undirected network: its edges' own terms, less the mean over its controls of
    log(1 + exp(eta)) for all others. edges hold both directions; controls (t, src, dst) may have edges among them.
    """
    own = lambda df, y: df.where((F.col("src") == node) & (F.col("dst") != node)).select("t", "src", "dst").distinct().withColumn("y", F.lit(y))
    placed = _placed(own(edges, 1).union(own(controls, 0)), positions)
    one = F.col("y") == 1
    sums = placed.groupBy("t").agg(F.sum(F.when(one, eta).otherwise(0.0)).alias("edges"), F.avg(F.when(~one, softplus(eta))).alias("control"))
    sizes = positions.groupBy("t").agg(F.count("*").alias("n"))
    return sums.join(F.broadcast(sizes), "t").select("t", (F.col("edges") - (F.col("n") - F.lit(1.0)) * F.coalesce("control", F.lit(0.0))).alias("loglik"))


def displacements(positions: DataFrame) -> DataFrame:
    """t, node, ss: the squared step from the node's position before; null at its first."""
    return positions.select("t", "node", squared_distance("x", F.lag("x").over(W.partitionBy("node").orderBy("t"))).alias("ss"))


def onward(positions: DataFrame) -> DataFrame:
    """t, node, ss: the squared step to the node's position after; null at its last."""
    return positions.select("t", "node", squared_distance("x", F.lead("x").over(W.partitionBy("node").orderBy("t"))).alias("ss"))


def random_walk_prior(positions: DataFrame, tau_sq: float, sigma_sq: float) -> DataFrame:
    step = W.partitionBy("node").orderBy("t")
    origin = F.transform("x", lambda v: F.lit(0.0))
    before = F.lag("x").over(step)
    ss = squared_distance("x", F.coalesce(before, origin)) / F.when(before.isNull(), F.lit(float(tau_sq))).otherwise(F.lit(float(sigma_sq)))
    return positions.select(ss.alias("ss")).agg((F.sum("ss") * F.lit(-0.5)).alias("logprior"))


def blended(lmbda: float) -> Column:
    """The mean of a position given its cluster and the position before (mu alone at the first step)."""
    return F.when(F.col("before").isNull(), F.col("mu")).otherwise(F.zip_with("mu", "before", lambda m, b: F.lit(lmbda) * m + F.lit(1 - lmbda) * b))


def with_before(positions: DataFrame) -> DataFrame:
    return positions.withColumn("before", F.lag("x").over(W.partitionBy("node").orderBy("t")))


def mixture_prior(positions: DataFrame, labels: DataFrame, clusters: DataFrame, lmbda: float, p: int = 2) -> DataFrame:
    """The log density of all positions given labels (t, node, z) and clusters (k, mu, sigma)."""
    joined = with_before(positions).join(labels.select("t", "node", "z"), ["t", "node"]).join(clusters, F.col("z") == F.col("k"))
    return joined.agg(F.sum(normal_logpdf("x", blended(lmbda), "sigma", p)).alias("logprior"))


def gaussian_likelihood(positions: DataFrame, clusters: DataFrame, lmbda: float, p: int = 2, normalised: bool = False) -> DataFrame:
    """t, node, k, value: the log density under every cluster, or the densities scaled to sum to 1.

    Clusters are a few rows; every position meets each of them, which is this operator's result.
    """
    pairs = with_before(positions).join(F.broadcast(clusters), how="cross").withColumn("value", normal_logpdf("x", blended(lmbda), "sigma", p)).select("t", "node", "k", "value")
    if not normalised:
        return pairs
    own = W.partitionBy("t", "node")
    shifted = F.exp(F.col("value") - F.max("value").over(own))
    return pairs.withColumn("e", shifted).select("t", "node", "k", (F.col("e") / F.sum("e").over(own)).alias("value"))
