"""The data behind figures: contours, ordered matrices, traces and panels, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import alluvial_flows  # noqa: F401  (flows are metrics and plot data alike)


def normal_contours(clusters: DataFrame, n_std: float = 2.0) -> DataFrame:
    """k, mu and the diameter of each spherical cluster's contour."""
    return clusters.select("k", "mu", (F.lit(2.0 * n_std) * F.sqrt("sigma")).alias("diameter"))


def ordered_matrix(pairs: DataFrame, labels: DataFrame, value: str = "p") -> DataFrame:
    """t, row, column, value of pairs (t, src, dst), nodes ordered by label and number within a step."""
    place = labels.withColumn("place", F.row_number().over(W.partitionBy("t").orderBy("z", "node")) - 1)
    side = lambda s, n: place.select("t", F.col("node").alias(s), F.col("place").alias(n))
    return pairs.join(side("src", "row"), ["t", "src"]).join(side("dst", "column"), ["t", "dst"]).select("t", "row", "column", value)


def group_boundaries(labels: DataFrame) -> DataFrame:
    """t, z and upto, the place behind a group's last node."""
    n = labels.groupBy("t", "z").agg(F.count("*").alias("n"))
    return n.select("t", "z", F.sum("n").over(W.partitionBy("t").orderBy("z")).alias("upto"))


def latent_panels(positions: DataFrame, labels: DataFrame) -> DataFrame:
    """positions with labels and the bounding box over all steps."""
    box = positions.agg(*[f(F.col("x")[d]).alias(f"{n}{d}") for d in range(2) for n, f in (("min", F.min), ("max", F.max))])
    return positions.join(labels, ["t", "node"]).join(F.broadcast(box), how="cross")  # one row


def visible_transitions(trans: DataFrame, active: DataFrame, above: float = 1e-3) -> DataFrame:
    """trans above a threshold between groups in use."""
    kept = trans.where(F.col("w") > above)
    for side in ("k_from", "k_to"):
        kept = kept.join(active.select(F.col("k").alias(side)), side, "left_semi")
    return kept


def network_view(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the names of both ends."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("name").alias(f"{s}_name"))
    return edges.join(side("src"), "src").join(side("dst"), "dst")
