"""Average linkage over a sparse table of co-occurrences, as rounds of joins.

Likeness between clusters is the mean of p over pairs of their nodes; a pair that isn't in the table has none. A
cluster is named by its smallest node, and keeps for each other cluster the sum of p between them: sums add up when
clusters merge, so that no distance is worked out anew. In a round all pairs merge that are each other's nearest (ties go
to the pair of smaller names); since a merged cluster is never nearer to a third than the nearer of its parts, and ties
keep their order under names, these are the merges of the plain algorithm that takes one nearest pair at a time.
Rounds are tables in the shared folder. Clusters that share nothing merge last, at distance 1, in the order of names.

Defined results: nodes without any row in `nodes` are left out; a node that no row of the table has is a cluster of its
own; rows that repeat add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .ordered import placed, running

MERGES = "t int, a int, b int, height double, offset long, n long"


def _nearest(sums: DataFrame) -> DataFrame:
    """t, i, j of the pairs that are each other's nearest."""
    rated = sums.withColumn("far", F.round(-F.col("c") / (F.col("n_i") * F.col("n_j")), 12))  # sums in another order are ties still
    own = F.struct("far", F.col("i").alias("low"), F.col("j").alias("high"))
    ends = rated.select("t", F.col("i").alias("node"), own.alias("pair")).union(rated.select("t", "j", own))
    best = ends.groupBy("t", "node").agg(F.min("pair").alias("pair")).select("t", "pair.*")
    return best.groupBy("t", F.col("low").alias("i"), F.col("high").alias("j")).agg(F.count("*").alias("votes")).where("votes = 2").select("t", "i", "j")


def average_linkage(nodes: DataFrame, together: DataFrame) -> DataFrame:
    """t, a, b, height, offset, n: the merges of every step, of the clusters named a < b, at height 1 - mean of p.

    nodes: t, node; together: t, i, j, p of pairs (in one direction; i = j is left aside). offset: the nodes that a's
    cluster had before, n: those that it has then. A cluster is named b once, in its last row.
    """
    everyone = nodes.select("t", "node").distinct()
    known = lambda side: everyone.select("t", F.col("node").alias(side))
    pairs = together.where("i <> j AND p > 0").select("t", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "p")
    pairs = pairs.join(known("i"), ["t", "i"], "left_semi").join(known("j"), ["t", "j"], "left_semi")
    sums = pairs.groupBy("t", "i", "j").agg(F.sum("p").alias("c")).select("t", "i", "j", "c", F.lit(1).cast("long").alias("n_i"), F.lit(1).cast("long").alias("n_j"))
    sums = written(sums, "linkage-sums")
    clusters = written(everyone.withColumn("n", F.lit(1).cast("long")), "linkage-clusters")
    merges = []
    while sums.limit(1).count():
        chosen = written(_nearest(sums).join(sums, ["t", "i", "j"]), "linkage-merges")
        merges.append(chosen.select("t", F.col("i").alias("a"), F.col("j").alias("b"), (F.lit(1.0) - F.col("c") / (F.col("n_i") * F.col("n_j"))).alias("height"), F.col("n_i").alias("offset"), (F.col("n_i") + F.col("n_j")).alias("n")))
        # what each merged name goes by from now on, and its size
        renamed = chosen.select("t", F.explode(F.array("i", "j")).alias("was"), F.col("i").alias("now"), (F.col("n_i") + F.col("n_j")).alias("n_now"))
        for side in ("i", "j"):
            of = renamed.select("t", F.col("was").alias(side), F.col("now").alias(f"now_{side}"), F.col("n_now").alias(f"new_{side}"))
            sums = sums.join(of, ["t", side], "left")
        name = {s: F.coalesce(f"now_{s}", s) for s in "ij"}
        size = {s: F.coalesce(f"new_{s}", f"n_{s}") for s in "ij"}
        first = name["i"] < name["j"]
        moved = sums.where(name["i"] != name["j"]).select(
            "t", F.least(name["i"], name["j"]).alias("i"), F.greatest(name["i"], name["j"]).alias("j"), "c",
            F.when(first, size["i"]).otherwise(size["j"]).alias("n_i"), F.when(first, size["j"]).otherwise(size["i"]).alias("n_j"),
        )
        sums = written(moved.groupBy("t", "i", "j").agg(F.sum("c").alias("c"), F.first("n_i").alias("n_i"), F.first("n_j").alias("n_j")), "linkage-sums")
        left = clusters.join(chosen.select("t", F.col("j").alias("node")), ["t", "node"], "left_anti")
        grown = chosen.select("t", F.col("i").alias("node"), (F.col("n_i") + F.col("n_j")).alias("grown"))
        clusters = written(left.join(grown, ["t", "node"], "left").select("t", "node", F.coalesce("grown", "n").alias("n")), "linkage-clusters")
    upto = running(clusters, ["t"], ["node"], F.col("n"), "upto")
    firsts = clusters.groupBy("t").agg(F.min("node").alias("a"))
    last = upto.join(firsts, "t").where("node > a").select("t", "a", F.col("node").alias("b"), F.lit(1.0).alias("height"), (F.col("upto") - F.col("n")).alias("offset"), F.col("upto").alias("n"))
    for more in merges:
        last = last.union(more)
    return last.selectExpr("cast(t as int) t", "cast(a as int) a", "cast(b as int) b", "height", "offset", "n")


def _followed(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """t, node, top, offset: the end of each node's way up over merges (b goes to a), and the sum of offsets on it."""
    up = merges.select("t", F.col("b").alias("node"), F.col("a").alias("top"), "offset")
    way = nodes.select("t", "node").distinct().join(up, ["t", "node"], "left").select("t", "node", F.coalesce("top", "node").alias("top"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
    way = written(way, "linkage-ways")
    while True:  # every round doubles the ways
        next_up = way.where("top <> node").select("t", F.col("node").alias("top"), F.col("top").alias("above"), F.col("offset").alias("more"))
        found = way.join(next_up, ["t", "top"], "left")
        if not found.where("above IS NOT NULL").limit(1).count():
            return way
        way = written(found.select("t", "node", F.coalesce("above", "top").alias("top"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")), "linkage-ways")


def flat_clusters(nodes: DataFrame, merges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """t, node, z: clusters whose merges lie at the threshold or below, numbered from 0 by their smallest nodes."""
    tops = written(_followed(nodes, merges.where(F.col("height") <= threshold)).select("t", "node", "top"), "linkage-flat")
    numbers = placed(tops.select("t", "top").distinct(), ["t"], ["top"], "z")
    return tops.join(numbers, ["t", "top"]).select("t", "node", F.col("z").cast("int").alias("z"))


def leaf_order(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """t, node, place: the order of the dendrogram's leaves, the cluster of the smaller name on the left."""
    return _followed(nodes, merges).select("t", "node", F.col("offset").alias("place"))
