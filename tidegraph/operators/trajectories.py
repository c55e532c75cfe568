"""K-means over whole trajectories: one label a node, a centre for each label and step.

A node's steps are one array; centres (labels x steps x axes, all parameters of the model) are literals of a round,
so that nodes find their nearest centre without a shuffle, and a round hands the driver one row of sums for each label
and step. A node that misses steps is compared over those it has, by the mean of its squared distances. A label without
nodes keeps its centre. The first centres come from a few rounds of sampling by distance with hashed uniforms, each
candidate weighed by the nodes nearest to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import squared_distance
from ..storage import written
from .draws import hashed_uniform

Centres = dict[int, list[list[float]]]


@dataclass
class Trajectories:
    """labels: node, z; centres: a step's centres by label; rounds, and whether the last one changed no centre."""

    labels: DataFrame
    centres: Centres
    rounds: int
    settled: bool


def paths(positions: DataFrame) -> DataFrame:
    """node and path, its (t, x) in order."""
    return positions.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("path"))


def _apart(centres: Centres, k: int) -> Column:
    """A path's mean squared distance to the k-th centre."""
    at = F.create_map(*[c for t, of in sorted(centres.items()) for c in (F.lit(t), F.array(*[F.lit(float(v)) for v in of[k]]))])
    total = F.aggregate("path", F.lit(0.0), lambda s, step: s + squared_distance(step["x"], F.element_at(at, step["t"])))
    return total / F.size("path")


def assigned(nodes: DataFrame, centres: Centres) -> DataFrame:
    """nodes with z, the nearest centre (the first among equals), and apart."""
    size = len(next(iter(centres.values())))
    near = F.array_min(F.array(*[F.struct(_apart(centres, k).alias("apart"), F.lit(k).alias("z")) for k in range(size)]))
    return nodes.withColumn("near", near).select("*", F.col("near.z").alias("z"), F.col("near.apart").alias("apart")).drop("near")


def _moved(nodes: DataFrame, centres: Centres, p: int) -> Centres:
    steps = assigned(nodes, centres).select("z", F.explode("path").alias("s"))
    sums = steps.groupBy("z", F.col("s.t").alias("t")).agg(F.count("*").alias("n"), *[F.sum(F.col("s.x")[d]).alias(f"s{d}") for d in range(p)])
    out = {t: [list(c) for c in of] for t, of in centres.items()}
    for r in sums.collect():  # a row for each label and step
        out[r["t"]][r["z"]] = [r[f"s{d}"] / r["n"] for d in range(p)]
    return out


def means(positions: DataFrame, p: int) -> dict[int, list[float]]:
    rows = positions.groupBy("t").agg(*[F.avg(F.col("x")[d]).alias(f"m{d}") for d in range(p)]).collect()
    return {r["t"]: [r[f"m{d}"] for d in range(p)] for r in rows}


def centres_of(chosen: DataFrame, mean: dict[int, list[float]]) -> Centres:
    """Centres that are the paths of chosen nodes, in their order; a step that one misses has the mean of all nodes."""
    rows = [{s["t"]: list(s["x"]) for s in r["path"]} for r in chosen.orderBy("node").collect()]
    return {t: [path.get(t, m) for path in rows] for t, m in mean.items()}


def seeded(nodes: DataFrame, k: int, mean: dict[int, list[float]], rounds: int = 4, seed: int = 1) -> Centres:
    """The first centres: about 2 k nodes a round are drawn by their distance from those drawn before."""
    uniform = hashed_uniform(seed)
    n = nodes.count()
    chosen = written(nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(1), "trajectory-seeds")
    for r in range(rounds if n > k else 0):
        near = assigned(nodes, centres_of(chosen, mean))
        total = near.agg(F.sum("apart")).first()[0] or 0.0
        if total <= 0:
            break
        drawn = near.where(uniform(F.col("node"), F.lit(r)) < F.lit(2.0 * k / total) * F.col("apart")).select("node", "path")
        chosen = written(chosen.union(drawn).dropDuplicates(["node"]), "trajectory-seeds")
    if chosen.count() < k:  # too few that differ: the first nodes by hash make it up
        more = nodes.join(chosen.select("node"), "node", "left_anti").orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(k - chosen.count())
        chosen = written(chosen.union(more), "trajectory-seeds")
    candidates = centres_of(chosen, mean)
    size = len(next(iter(candidates.values())))
    weight = np.zeros(size)
    for r in assigned(nodes, candidates).groupBy("z").count().collect():
        weight[r["z"]] = r["count"]
    flat = np.array([[v for t in sorted(candidates) for v in candidates[t][c]] for c in range(size)])
    taken = [int(weight.argmax())]
    while len(taken) < min(k, size):  # the candidate that adds most to what the taken ones leave
        left = ((flat[:, None] - flat[None, taken]) ** 2).sum(axis=2).min(axis=1) * np.maximum(weight, 1e-9)
        left[taken] = -1
        taken.append(int(left.argmax()))
    return {t: [of[c] for c in taken] for t, of in candidates.items()}


def kmeans(positions: DataFrame, k: int, start: Centres | None = None, rounds: int = 50, p: int = 2, seed: int = 1) -> Trajectories:
    """Lloyd rounds from start, or from seeded centres, until no centre moves."""
    nodes = written(paths(positions), "trajectories")
    mean = means(positions, p)
    centres = start or seeded(nodes, k, mean, seed=seed)
    taken, settled = 0, False
    while taken < rounds and not settled:
        new = _moved(nodes, centres, p)
        taken += 1
        settled = all(np.allclose(new[t], centres[t], rtol=0, atol=1e-12) for t in centres)
        centres = new
    return Trajectories(written(assigned(nodes, centres).select("node", "z"), "trajectory-labels"), centres, taken, settled)


def summary(positions: DataFrame, found: Trajectories, var_reg: float = 1e-3, p: int = 2) -> DataFrame:
    """k, mu (a label's centres averaged over steps) and variance (within steps, averaged over axes and steps; var_reg for none)."""
    steps = sorted(found.centres)
    size = len(found.centres[steps[0]])
    mus = [(k, [float(np.mean([found.centres[t][k][d] for t in steps])) for d in range(p)]) for k in range(size)]
    spread = sum((F.var_pop(F.col("x")[d]) for d in range(p)), F.lit(0.0)) / F.lit(float(p))
    within = positions.join(found.labels, "node").groupBy("t", "z").agg(spread.alias("v")).groupBy(F.col("z").alias("k")).agg((F.sum("v") / F.lit(float(len(steps)))).alias("v"))
    known = positions.sparkSession.createDataFrame(mus, "k int, mu array<double>")
    return known.join(within, "k", "left").select("k", "mu", F.when(F.col("v") > 0, F.col("v")).otherwise(F.lit(var_reg)).alias("variance"))
