"""Readers of edge lists (CSV) and adjacency matrices (text), and the writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import network


def edge_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, target, season, weight of CSV files with a header, weights summed over repeated rows."""
    raw = spark.read.schema(schema.EDGE_LIST).option("header", True).csv(paths)
    named = raw.select(F.col("Source").alias("source"), F.col("Target").alias("target"), F.col("Season").alias("season"), F.col("Weight").alias("weight"))
    return network.aggregated(named, ["source", "target", "season"])


def interactions(spark: SparkSession, paths: str | list[str], seasons: list[int] | None = None, weight_min: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): both directions of the edges (t is the season), of some seasons or of enough weight if asked, and names by number."""
    kept = edge_lists(spark, paths)
    if seasons is not None:
        kept = kept.where(F.col("season").isin(seasons))
    if weight_min is not None:
        kept = kept.where(F.col("weight") >= weight_min)
    nodes = network.encoded(kept.select(F.col("source").alias("name")).union(kept.select("target")), "name")
    ids = lambda side, code: nodes.select(F.col("name").alias(side), F.col("node").alias(code))
    edges = kept.join(ids("source", "src"), "source").join(ids("target", "dst"), "target").select(F.col("season").alias("t"), "src", "dst")
    return network.symmetrised(edges), nodes


def matrices(spark: SparkSession, paths: list[str]) -> DataFrame:
    """t (the path's place), src, dst, w of the cells of whitespace-separated square matrices, one file a step."""
    out = None
    for t, path in enumerate(paths):
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s*\n\s*")).alias("src", "line"))
        cells = rows.select(F.lit(t).alias("t"), "src", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("dst", "w")).withColumn("w", F.col("w").cast("double"))
        out = cells if out is None else out.unionByName(cells)
    return out


def lines(spark: SparkSession, path: str, column: str, header: bool = False) -> DataFrame:
    """node (the line's place) and its value."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("node", column))
    return rows.where("node > 0").withColumn("node", F.col("node") - 1) if header else rows


def labelled_matrices(spark: SparkSession, paths: list[str], names: str, groups: str, directed: bool = True, encode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of binary matrices over the same nodes, whose names and groups stand in files, one to a line.

    One path gives a static network. encode numbers the groups in the order of their names, as z.
    """
    edges = network.binarised(matrices(spark, paths)).where("src <> dst").select("t", "src", "dst")
    nodes = lines(spark, names, "name").join(lines(spark, groups, "grp"), "node")
    if encode:
        nodes = nodes.join(network.encoded(nodes, "grp", "z"), "grp").select("node", "name", "grp", "z")
    return (edges if directed else network.symmetrised(edges)), nodes


def monastery(spark: SparkSession, folder: str, dynamic: bool = True, directed: bool = True, waverers: bool = False, encode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the monastery network in a folder: its three steps, or the one static matrix of dynamic=False.

    waverers: groups by the file that keeps those who waver apart; encode: with the groups' numbers as z.
    """
    # fixed values: the data set's own file names
    steps = [f"{folder}/sampson_{t}.npy" for t in range(3)] if dynamic else [f"{folder}/sampson.npy"]
    groups = "sampson_groups_waverers.txt" if waverers else "sampson_groups.txt"
    return labelled_matrices(spark, steps, f"{folder}/sampson_names.txt", f"{folder}/{groups}", directed, encode)


def alliances(spark: SparkSession, paths: list[str], names: str, min_degree: int = 1, remove_periphery: bool = True, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): both directions of what is left of count matrices' links when each step's nodes outside its
    3-core and then nodes of a total degree under min_degree are gone; nodes are numbered anew in their order. directed
    keeps the links of those nodes as they stand.
    """
    links = network.binarised(matrices(spark, paths)).where("src <> dst").select("t", "src", "dst")
    edges = network.symmetrised(links)
    if remove_periphery:
        edges = network.symmetrised(network.k_core(edges, 3))
    ends = edges.groupBy(F.col("src").alias("old")).agg((2 * F.count("*")).alias("n")).where(F.col("n") >= min_degree)
    edges = edges.join(links, ["t", "src", "dst"], "left_semi") if directed else edges
    nodes = network.encoded(ends, "old").join(lines(spark, names, "name", header=True).withColumnRenamed("node", "old"), "old")
    ids = lambda side, code: nodes.select(F.col("old").alias(side), F.col("node").alias(code))
    return edges.join(ids("src", "a"), "src").join(ids("dst", "b"), "dst").select("t", F.col("a").alias("src"), F.col("b").alias("dst")), nodes.select("node", "name")


def write_results(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").partitionBy(*(by or []))
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
