"""Summaries of posterior sample tables: labels (iter, t, node, z), scalars (iter, logp, ...), clusters and transitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import normal_logpdf


def retained(samples: DataFrame, n_burn: int = 0, thin: int = 1) -> DataFrame:
    return samples.where((F.col("iter") >= n_burn) & (F.col("iter") % thin == 0))


def cluster_counts(labels: DataFrame, by_step: bool = False) -> DataFrame:
    """iter (and t) with the number of labels in use."""
    return labels.groupBy("iter", *(["t"] if by_step else [])).agg(F.countDistinct("z").alias("n_groups"))


def group_counts(labels: DataFrame, by_step: bool = False) -> DataFrame:
    """How many samples have each number of groups."""
    return cluster_counts(labels, by_step).groupBy(*(["t"] if by_step else []), "n_groups").agg(F.count("*").alias("n"))


def best_k(labels: DataFrame) -> DataFrame:
    """The commonest number of groups; the smallest among equals."""
    return group_counts(labels).orderBy(F.desc("n"), "n_groups").limit(1).select("n_groups")


def cooccurrence(labels: DataFrame) -> DataFrame:
    """t, i, j, p with i <= j: the share of samples in which two nodes share a label. Pairs that never do are absent.

    Members of a group are listed once by sample and step and paired inside it; pairs are summed before they move, so
    what is shuffled grows with pairs of nodes, not with samples.
    """
    own = ["iter", "t", "z"]
    a, b = labels.select(*own, F.col("node").alias("i")), labels.select(*own, F.col("node").alias("j"))
    n = labels.groupBy("t").agg(F.countDistinct("iter").alias("s"))
    counts = a.join(b, own).where("i <= j").groupBy("t", "i", "j").agg(F.count("*").alias("c"))
    return counts.join(F.broadcast(n), "t").select("t", "i", "j", (F.col("c") / (F.col("s") * F.lit(1.0))).alias("p"))


def expected_vi(labels: DataFrame, together: DataFrame) -> DataFrame:
    """iter, t, vi: the posterior expected variation of information (base 2) of each sample's partition.

    together: t, i, j, p as cooccurrence gives it.
    """
    both = together.union(together.where("i <> j").select("t", F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    own = labels.select("iter", "t", F.col("node").alias("i"), "z")
    size = labels.groupBy("iter", "t", "z").agg(F.count("*").cast("double").alias("m"))
    mates = (
        own.join(labels.select("iter", "t", F.col("node").alias("j"), "z"), ["iter", "t", "z"])
        .join(both, ["t", "i", "j"])
        .groupBy("iter", "t", "i")
        .agg(F.sum("p").alias("within"))
    )
    overall = both.groupBy("t", "i").agg(F.sum("p").alias("row"))
    node_terms = own.join(mates, ["iter", "t", "i"]).join(overall, ["t", "i"]).join(size, ["iter", "t", "z"])
    term = F.log2("m") - F.lit(2.0) * F.log2("within") + F.log2("row")
    return node_terms.groupBy("iter", "t").agg((F.sum(term) / F.count("*")).alias("vi"))


def mean_expected_vi(labels: DataFrame, together: DataFrame) -> DataFrame:
    """iter, vi averaged over steps."""
    return expected_vi(labels, together).groupBy("iter").agg(F.avg("vi").alias("vi"))


def select_min_vi(labels: DataFrame, together: DataFrame, loglik: DataFrame | None = None) -> DataFrame:
    """The sample of least expected variation; then of the highest loglik (iter, loglik), then the first."""
    found = mean_expected_vi(labels, together).withColumn("vi", F.round("vi", 9))
    if loglik is not None:
        return found.join(loglik, "iter").orderBy("vi", F.desc("loglik"), "iter").limit(1).select("iter", "vi")
    return found.orderBy("vi", "iter").limit(1)


def map_per_k(labels: DataFrame, scalars: DataFrame) -> DataFrame:
    """n_groups, iter, logp: of each number of groups the sample of the highest logp, the first among equals."""
    joined = cluster_counts(labels).join(scalars.select("iter", "logp"), "iter")
    return joined.groupBy("n_groups").agg(F.min(F.struct(-F.col("logp"), F.col("iter"))).alias("best")).select("n_groups", F.col("best.iter").alias("iter"), (-F.col("best.col1")).alias("logp"))


def running_map(scalars: DataFrame, by: list[str] | None = None) -> DataFrame:
    """iter, logp, best_iter, best: the highest logp up to each sample, the first among equals; by: the chain."""
    upto = W.partitionBy(*(by or [])).orderBy("iter").rowsBetween(W.unboundedPreceding, W.currentRow)
    best = F.min(F.struct((-F.col("logp")).alias("low"), F.col("iter").alias("at"))).over(upto)
    return scalars.select(*(by or []), "iter", "logp", best.alias("b")).select(*(by or []), "iter", "logp", F.col("b.at").alias("best_iter"), (-F.col("b.low")).alias("best"))


def bic(chosen: DataFrame, loglik: DataFrame, latent: DataFrame, n_edges: int, n: int, steps: int, p: int = 2, directed: bool = False) -> DataFrame:
    """n_groups, bic, loglik, iter of chosen (n_groups, iter). loglik and latent: iter with the two log-likelihoods."""
    pen1 = (2 + n if directed else 1) * math.log(n_edges)
    k = F.col("n_groups").cast("double")
    pen2 = ((p + 1) * k + F.lit(2.0) * (k - 1) + F.lit(float(steps - 1)) * k * (k - 1)) * F.lit(math.log(n * steps))
    joined = chosen.select("n_groups", "iter").join(loglik.select("iter", "loglik"), "iter").join(latent.select("iter", F.col("loglik").alias("latent")), "iter")
    value = F.lit(-2.0) * F.col("loglik") + F.lit(pen1) - F.lit(2.0) * F.col("latent") + pen2
    return joined.select("n_groups", value.alias("bic"), "loglik", "iter")


def forward_loglik(positions: DataFrame, init: DataFrame, trans: DataFrame, clusters: DataFrame, lmbda: float, p: int = 2) -> DataFrame:
    """The marginal log-likelihood of positions over label paths: a forward pass in logarithms for each node, so that no
    density, however small, becomes zero.

    A node's steps are folded in order as an array, inside the engine. init: k, w; trans: t (or none), k_from, k_to, w;
    clusters: k, mu, sigma. These are a few rows of K and K x K size and become literals of the fold.
    """
    ks = sorted((r["k"], tuple(r["mu"]), r["sigma"]) for r in clusters.collect())
    place = {k: i for i, (k, _, _) in enumerate(ks)}
    w0 = [0.0] * len(ks)
    for r in init.collect():
        w0[place[r["k"]]] = r["w"]
    timed = "t" in trans.columns
    table: dict = {}
    for r in trans.collect():
        table.setdefault(r["t"] if timed else None, [[0.0] * len(ks) for _ in ks])[place[r["k_from"]]][place[r["k_to"]]] = r["w"]
    array = lambda v: F.array(*[array(u) if isinstance(u, (list, tuple)) else F.lit(float(u)) for u in v])
    moves = F.create_map(*[x for t, m in table.items() for x in (F.lit(t), array(m))]) if timed else None
    mus, sigmas = array([m for _, m, _ in ks]), array([s for _, _, s in ks])
    each = F.sequence(F.lit(0), F.lit(len(ks) - 1))
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    logpdf = lambda x, mean, i: normal_logpdf(x, mean, at(sigmas, i), p)
    log = lambda v: F.when(v > 0, F.log(v)).otherwise(F.lit(float("-inf")))

    def step(acc, s):
        first = F.size(acc["w"]) == 0
        mean = lambda i: F.when(first, at(mus, i)).otherwise(F.zip_with(at(mus, i), acc["x"], lambda m, b: F.lit(lmbda) * m + F.lit(1 - lmbda) * b))
        matrix = F.element_at(moves, s["t"]) if timed else array(table[None])
        came = lambda i: F.when(first, at(array(w0), i)).otherwise(
            F.aggregate(each, F.lit(0.0), lambda total, j: total + at(acc["w"], j) * at(at(matrix, j), i))
        )
        joint = F.transform(each, lambda i: log(came(i)) + logpdf(s["x"], mean(i), i))
        shifted = F.transform(joint, lambda v: F.when(v > float("-inf"), F.exp(v - F.array_max(joint))).otherwise(0.0))
        scale = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
        share = F.transform(shifted, lambda v: F.coalesce(F.try_divide(v, scale), F.lit(0.0)))
        return F.struct(share.alias("w"), s["x"].alias("x"), (acc["ll"] + F.array_max(joint) + log(scale)).alias("ll"))

    start = F.struct(F.array().cast("array<double>").alias("w"), F.array().cast("array<double>").alias("x"), F.lit(0.0).alias("ll"))
    paths = positions.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("path"))
    return paths.select("node", F.aggregate("path", start, step, lambda a: a["ll"]).alias("loglik"))


def renormalised_weights(trans: DataFrame, active: DataFrame) -> DataFrame:
    """trans (t, k_from, k_to, w) among active k, with rows that sum to 1 again."""
    kept = trans.join(active.select(F.col("k").alias("k_from")), "k_from", "left_semi").join(active.select(F.col("k").alias("k_to")), "k_to", "left_semi")
    return kept.select("t", "k_from", "k_to", F.try_divide(F.col("w"), F.sum("w").over(W.partitionBy("t", "k_from"))).alias("w"))


def relabelled(labels: DataFrame) -> DataFrame:
    """Labels numbered from 0 in their order among those in use."""
    codes = labels.select("z").distinct().withColumn("k", (F.dense_rank().over(W.orderBy("z")) - 1).cast("int"))
    return labels.join(codes, "z").drop("z").withColumnRenamed("k", "z")


def posterior_means(positions: DataFrame) -> DataFrame:
    """t, node, x of sampled positions (iter, t, node, x)."""
    dims = positions.select("t", "node", F.posexplode("x").alias("dim", "v")).groupBy("t", "node", "dim").agg(F.avg("v").alias("v"))
    return dims.groupBy("t", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("x"))


def missing_means(draws: DataFrame) -> DataFrame:
    """t, src, dst, y: the mean of a missing dyad's retained draws."""
    return draws.groupBy("t", "src", "dst").agg(F.avg("y").alias("y"))


def cluster_statistics(positions: DataFrame, labels: DataFrame, by_step: bool = True) -> DataFrame:
    """t, z, n and sums of each dimension."""
    keys = ["t", "z"] if by_step else ["z"]
    joined = positions.join(labels, ["t", "node"])
    return joined.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col("x")[d]).alias(f"s{d}") for d in range(2)])


def _residuals(positions: DataFrame, labels: DataFrame, lmbda: float) -> DataFrame:
    """A node's pull on its cluster: weight a (1 at first, lambda later) and r with x ~ N(a mu + rest)."""
    before = F.lag("x").over(W.partitionBy("node").orderBy("t"))
    joined = positions.withColumn("before", before).join(labels.select("t", "node", "z"), ["t", "node"])
    return joined.select(
        "z", "t", "node", "x", "before", F.when(F.col("before").isNull(), F.lit(1.0)).otherwise(F.lit(lmbda)).alias("a"),
        F.when(F.col("before").isNull(), F.col("x")).otherwise(F.zip_with("x", "before", lambda u, b: u - F.lit(1 - lmbda) * b)).alias("r"),
    )


def mu_posterior(positions: DataFrame, labels: DataFrame, sigmas: DataFrame, lmbda: float, prior_variance: float) -> DataFrame:
    """z, variance and mean (m0, m1) of each cluster's centre given all else, for a prior centred at 0."""
    sums = _residuals(positions, labels, lmbda).groupBy("z").agg(F.sum(F.col("a") * F.col("a")).alias("aa"), *[F.sum(F.col("a") * F.col("r")[d]).alias(f"s{d}") for d in range(2)])
    joined = sums.join(F.broadcast(sigmas.select(F.col("k").alias("z"), "sigma")), "z")
    variance = F.lit(1.0) / (F.lit(1.0 / prior_variance) + F.col("aa") / F.col("sigma"))
    return joined.select("z", variance.alias("variance"), *[(variance * F.col(f"s{d}") / F.col("sigma")).alias(f"m{d}") for d in range(2)])


def sigma_posterior(positions: DataFrame, labels: DataFrame, mus: DataFrame, lmbda: float, a: float, b: float, p: int = 2) -> DataFrame:
    """z, shape and scale of each cluster's inverse gamma variance, for a prior of shape a/2 and scale b/2."""
    joined = _residuals(positions, labels, lmbda).join(F.broadcast(mus.select(F.col("k").alias("z"), "mu")), "z")
    ss = F.aggregate(F.zip_with("r", "mu", lambda r, m: (r - F.col("a") * m) * (r - F.col("a") * m)), F.lit(0.0), lambda s, v: s + v)
    return joined.groupBy("z").agg((F.lit(a / 2) + F.count("*") * F.lit(p / 2)).alias("shape"), (F.lit(b / 2) + F.sum(ss) / F.lit(2.0)).alias("scale"))


def lambda_posterior(positions: DataFrame, labels: DataFrame, clusters: DataFrame, mean: float, variance: float) -> DataFrame:
    """Mean and variance of the blending weight before it is cut to (0, 1), for a normal prior."""
    joined = _residuals(positions, labels, 1.0).where("before IS NOT NULL").join(F.broadcast(clusters.select(F.col("k").alias("z"), "mu", "sigma")), "z")
    dot = lambda f: F.aggregate(F.zip_with(F.zip_with("mu", "before", lambda m, b: m - b), F.zip_with("x", "before", lambda x, b: x - b), f), F.lit(0.0), lambda s, v: s + v)
    sums = joined.agg(F.sum(dot(lambda u, v: u * u) / F.col("sigma")).alias("uu"), F.sum(dot(lambda u, v: u * v) / F.col("sigma")).alias("uv"))
    v = F.lit(1.0) / (F.lit(1.0 / variance) + F.col("uu"))
    return sums.select(v.alias("variance"), (v * (F.lit(mean / variance) + F.col("uv"))).alias("mean"))
