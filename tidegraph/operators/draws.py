"""Controls drawn without replacement among the nodes that a node has no edge to.

The k-th of those is found by a gap index: the m-th (from 0) of a node's sorted neighbours has place - m nodes before it that
aren't neighbours, so as many neighbours stand before the k-th other node as have gaps of at most k. A draw takes
min(n, available) different k of a node by Floyd's method, from hashed uniforms; gaps and draws meet in one order, so
that the work grows with edges and draws, and a hub's neighbours never meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import placed, running


def hashed_uniform(seed: int = 123) -> Callable[..., Column]:
    """A number in [0, 1) of the given columns, the same on every run."""
    return lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def subset(size: Column, available: Column, uniform: Callable[[Column], Column]) -> Column:
    """min(size, available) different numbers below available, in one array; every set is equally likely.

    uniform: a number in [0, 1) for each step's number.
    """
    taken = F.least(size, available).cast("int")
    first = available.cast("int") - taken

    def step(acc: Column, j: Column) -> Column:
        pick = F.floor(uniform(j) * (j + F.lit(1))).cast("int")
        return F.concat(acc, F.array(F.when(F.array_contains(acc, pick), j).otherwise(pick)))

    none = F.array().cast("array<int>")
    return F.when(taken > 0, F.aggregate(F.sequence(first, F.greatest(first, available.cast("int") - 1)), none, step)).otherwise(none)


def _others(ranks: DataFrame, barred: DataFrame, keys: list[str]) -> DataFrame:
    """keys and place of ranks (keys, rank): the rank-th of the places that aren't barred (keys, place)."""
    gaps = placed(barred, keys, ["place"], "m").select(*keys, (F.col("place") - F.col("m")).alias("at"), F.lit(0).alias("kind"))
    asked = ranks.select(*keys, F.col("rank").cast("long").alias("at"), F.lit(1).alias("kind"))
    passed = running(gaps.union(asked), keys, ["at", "kind"], F.lit(1) - F.col("kind"), "passed")
    return passed.where("kind = 1").select(*keys, (F.col("at") + F.col("passed")).alias("place"))


def exact_controls(nodes: DataFrame, edges: DataFrame, n_control: int, uniform: Callable[..., Column] | None = None) -> DataFrame:
    """t, src, dst: min(n_control, available) nodes of the step for each node (t, node) that it has no edge to, itself apart.

    edges: t, src, dst; for controls of in-edges pass them reversed. uniform: of the columns t, src and a number.
    """
    uniform = uniform or hashed_uniform()
    keys = ["t", "src"]
    places = placed(nodes.select("t", "node").distinct(), ["t"], ["node"])
    ends = edges.select("t", "src", F.col("dst").alias("node")).union(nodes.select("t", F.col("node").alias("src"), "node")).distinct()
    barred = ends.join(places, ["t", "node"]).select(*keys, "place")
    sizes = places.groupBy("t").agg(F.count("*").alias("n"))
    free = barred.groupBy(*keys).agg(F.count("*").alias("barred")).join(F.broadcast(sizes), "t")  # a row a step
    drawn = free.select(*keys, F.explode(subset(F.lit(n_control), F.col("n") - F.col("barred"), lambda j: uniform(F.col("t"), F.col("src"), j))).alias("rank"))
    return _others(drawn, barred, keys).join(places, ["t", "place"]).select("t", "src", F.col("node").alias("dst"))


def stratified_controls(nodes: DataFrame, edges: DataFrame, n_control: int, uniform: Callable[..., Column] | None = None) -> DataFrame:
    """src, dst, connected: controls of each node (node) for all steps, in two strata.

    Of the m nodes that a node is ever linked to, in either direction, floor(m / n * n_control) are drawn, one at least
    where there are any; what is left of n_control is drawn among the others, as far as there are so many.
    uniform: of the columns src, a number and whether the stratum is that of linked nodes (1 or 0).
    """
    uniform = uniform or hashed_uniform()
    places = placed(nodes.select("node").distinct(), [], ["node"])
    n = places.count()
    ever = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    linked = ever.join(places.withColumnRenamed("node", "dst"), "dst").select("src", "place")
    alone = places.select(F.col("node").alias("src"), "place")
    sizes = alone.select("src").join(linked.groupBy("src").agg(F.count("*").alias("m")), "src", "left").select("src", F.coalesce("m", F.lit(0)).alias("m"))
    share = F.floor(F.col("m") / F.lit(float(n)) * F.lit(n_control))
    sizes = sizes.withColumn("near", F.when(F.col("m") > 0, F.greatest(share, F.lit(1))).otherwise(F.lit(0)))
    drawn = lambda size, available, stratum: sizes.select("src", F.explode(subset(size, available, lambda j: uniform(F.col("src"), j, F.lit(stratum)))).alias("rank"))
    near = placed(linked, ["src"], ["place"], "rank").join(drawn(F.col("near"), F.col("m"), 1), ["src", "rank"]).select("src", "place", F.lit(1).alias("connected"))
    rest = _others(drawn(F.lit(n_control) - F.col("near"), F.lit(n - 1) - F.col("m"), 0), linked.union(alone), ["src"])
    both = near.union(rest.select("src", "place", F.lit(0).alias("connected")))
    return both.join(places, "place").select("src", F.col("node").alias("dst"), "connected")
