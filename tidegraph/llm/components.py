"""Connected components in Spark: smallest labels over links, roots hooked to smaller labels, pointers doubled.

Edges and labels stay in tables in the shared folder. Messages are summed up before they are shuffled, so a node with
many links costs no task more than its own partition of them; the rounds grow with the logarithm of a path's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches, for all nodes of edges (src, dst; longs, either direction)."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    labels = common.written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("root")), "components", gathered=True)
    while True:
        told = both.join(labels, both["src"] == labels["node"]).select(F.col("dst").alias("node"), "root")
        lower = told.union(labels).groupBy("node").agg(F.min("root").alias("low"))
        hooked = labels.join(lower, "node").where("low < root").select(F.col("root").alias("node"), F.col("low").alias("root"))
        least = lower.select("node", F.col("low").alias("root")).union(hooked).groupBy("node").agg(F.min("root").alias("root"))
        new = common.written(least, "components", gathered=True)
        up = new.select(F.col("node").alias("up"), F.col("root").alias("above"))
        jumped = new.join(up, new["root"] == up["up"], "left").select("node", F.coalesce("above", "root").alias("root"))
        new = common.written(jumped, "components", gathered=True)
        changed = new.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        labels = new
        if not changed:
            return labels
