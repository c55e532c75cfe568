"""Networks as edge tables (t, src, dst): shape, statistics and traversals. Undirected input holds both directions
where a function says so, else any; a network without a t column has no steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from .ordered import placed


def aggregated(edges: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Edges listed several times, with their weights summed."""
    return edges.groupBy(*keys).agg(F.sum(weight).alias(weight))


def binarised(cells: DataFrame, weight: str = "w", above: float = 0) -> DataFrame:
    return cells.where(F.col(weight) > above).drop(weight)


def symmetrised(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select("t", "src", "dst").union(edges.select("t", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Every undirected edge once, the smaller node first."""
    return edges.where("src <> dst").select("t", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def upper(k: int = 1) -> Column:
    return F.col("dst") - F.col("src") >= k


def diagonal() -> Column:
    return F.col("src") == F.col("dst")


def off_diagonal() -> Column:
    return F.col("src") != F.col("dst")


def encoded(values: DataFrame, column: str, code: str = "node") -> DataFrame:
    """The distinct values of a column, numbered from 0 in their order (null first), range by range."""
    return placed(values.select(column).distinct(), [], [column], code).withColumn(code, F.col(code).cast("int"))


def is_dynamic(edges: DataFrame) -> bool:
    return len(edges.select("t").distinct().limit(2).collect()) > 1


def num_edges(edges: DataFrame, directed: bool) -> DataFrame:
    """n_edges; undirected edges count once."""
    return (edges if directed else canonical(edges)).agg(F.count("*").alias("n_edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """t, node, n_in, n_out of all nodes with an edge."""
    ends = edges.select("t", F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("t", "src", F.lit(0), F.lit(1)))
    return ends.groupBy("t", "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def max_degrees(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("t").agg(F.max("n_in").alias("max_in"), F.max("n_out").alias("max_out"))


def neighbours(edges: DataFrame) -> DataFrame:
    """t, node and its sorted out-neighbours; a node's list is as long as its degree."""
    return edges.groupBy("t", F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def density(edges: DataFrame, n: int, steps: int, directed: bool = True) -> DataFrame:
    """Edges among possible ones, over all steps."""
    possible = float(steps * n * (n - 1) / (1 if directed else 2))
    return num_edges(edges, directed).select((F.col("n_edges") / F.lit(possible)).alias("density"))


def density_by_step(edges: DataFrame, n: int, directed: bool = True) -> DataFrame:
    possible = float(n * (n - 1) / (1 if directed else 2))
    return (edges if directed else canonical(edges)).groupBy("t").agg((F.count("*") / F.lit(possible)).alias("density"))


def modularity(edges: DataFrame, labels: DataFrame, directed: bool = False, textbook: bool = False) -> DataFrame:
    """t and modularity of each step. labels: node and z, with t or without.

    Undirected input is symmetrised. Directed input keeps its direction and takes half of both degrees; its
    denominators are 2m as for undirected ones, unless textbook asks for m.
    """
    edges = edges.select("t", "src", "dst") if directed else symmetrised(edges)
    on = ["t", "node"] if "t" in labels.columns else ["node"]
    a = labels.select(*on, "z")
    ends = edges.select("t", F.col("src").alias("node"), F.col("dst")).join(a, on).select("t", F.col("z").alias("zs"), F.col("dst").alias("node")).join(a, on)
    inside = ends.groupBy("t").agg(F.sum((F.col("zs") == F.col("z")).cast("double")).alias("inside"), F.count("*").cast("double").alias("m"))
    degree = degrees(edges).join(a, on).groupBy("t", "z").agg((F.sum(F.col("n_in") + F.col("n_out")) / F.lit(2.0)).alias("d"))
    squares = degree.groupBy("t").agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    two_m = F.col("m") * F.lit(1.0 if not directed or textbook else 2.0)  # symmetrised edges count twice already
    return inside.join(squares, "t").select("t", (F.col("inside") / two_m - F.col("dd") / (two_m * two_m)).alias("modularity"))


def modularity_mean(edges: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return modularity(edges, labels, **how).agg(F.avg("modularity").alias("modularity"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """t, node, component (its smallest node) of every node at every step that has an edge.

    Smallest labels travel over edges, and every round doubles the pointers, so rounds grow with the logarithm of a
    path. Rounds are tables in the shared folder.
    """
    both = written(symmetrised(edges), "components-edges")
    labels = both.select("t").distinct().join(nodes.select("node").distinct(), how="cross").withColumn("label", F.col("node"))
    labels = written(labels, "components")
    while True:
        told = both.join(labels.withColumnRenamed("node", "src"), ["t", "src"]).select("t", F.col("dst").alias("node"), "label")
        low = written(told.union(labels).groupBy("t", "node").agg(F.min("label").alias("label")), "components")
        up = low.select("t", F.col("node").alias("label"), F.col("label").alias("above"))
        new = written(low.join(up, ["t", "label"]).select("t", "node", F.col("above").alias("label")), "components")
        changed = new.join(labels.withColumnRenamed("label", "was"), ["t", "node"]).where("label <> was").limit(1).count()
        labels = new
        if not changed:
            return labels.withColumnRenamed("label", "component")


def connected_nodes(edges: DataFrame, nodes: DataFrame, size_cutoff: int = 1) -> DataFrame:
    """t, node of the nodes in weakly connected components larger than the cutoff."""
    found = components(edges, nodes)
    large = found.groupBy("t", "component").agg(F.count("*").alias("n")).where(F.col("n") > size_cutoff)
    return found.join(large, ["t", "component"], "left_semi").select("t", "node")


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """The undirected edges (smaller node first) among nodes that keep k neighbours when others are peeled off."""
    left = written(canonical(edges), "core")
    while True:
        ends = left.select("t", F.col("src").alias("node")).union(left.select("t", F.col("dst")))
        weak = ends.groupBy("t", "node").agg(F.count("*").alias("n")).where(F.col("n") < k).select("t", "node")
        for side in ("src", "dst"):
            kept = weak.withColumnRenamed("node", side)
            left = left.join(kept, ["t", side], "left_anti").select("t", "src", "dst")
        new = written(left, "core")
        if new.count() == ends.count() // 2:
            return new
        left = new


def shortest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """t, src, dst, d for all pairs of nodes, by breadth; pairs without a path have a step's longest path plus 1."""
    both = written(symmetrised(edges.where("src <> dst")), "paths-edges")
    everyone = both.select("t").distinct().join(nodes.select("node"), how="cross")
    seen = [written(everyone.select("t", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("d")), "paths")]
    while True:
        last = seen[-1]
        step = last.alias("a").join(both.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.dst") == F.col("b.src"))).select("a.t", "a.src", "b.dst").distinct()
        for old in seen[-2:]:  # a new pair can only have been met one or two rounds before
            step = step.join(old, ["t", "src", "dst"], "left_anti")
        new = written(step.withColumn("d", F.lit(len(seen))), "paths")
        if not new.limit(1).count():
            break
        seen.append(new)
    found = seen[0]
    for more in seen[1:]:
        found = found.union(more)
    longest = found.groupBy("t").agg((F.max("d") + 1).alias("far"))
    pairs = everyone.withColumnRenamed("node", "src").join(nodes.select(F.col("node").alias("dst")), how="cross")
    return pairs.join(found, ["t", "src", "dst"], "left").join(longest, "t").select("t", "src", "dst", F.coalesce("d", "far").alias("d"))


def weighted_shortest_paths(edges: DataFrame, nodes: DataFrame, weight: str = "w", delta: float | None = None) -> DataFrame:
    """t, src, dst, d for all pairs of nodes, by edges' lengths; pairs without a path have a step's longest path plus 1.

    Undirected: an edge is as long as the shorter of its directions and repetitions; lengths that aren't above 0 count as
    no edge. Delta-stepping: ways are settled by buckets of their length (delta, by default the mean of an edge); within
    a bucket short edges are followed until nothing in it changes, long ones once when it is settled. Rounds are tables.
    """
    lengths = edges.where((F.col("src") != F.col("dst")) & (F.col(weight) > 0)).select("t", "src", "dst", F.col(weight).cast("double").alias("w"))
    both = lengths.union(lengths.select("t", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("t", "src", "dst").agg(F.min("w").alias("w"))
    both = written(both, "lengths")
    step = delta or both.agg(F.avg("w")).first()[0] or 1.0
    light, heavy = both.where(F.col("w") <= step), both.where(F.col("w") > step)
    everyone = both.select("t").distinct().join(nodes.select("node"), how="cross")
    keys = ["t", "src", "dst"]
    linked = both.select("t", F.col("src").alias("node")).distinct()
    best = written(linked.select("t", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh")), "ways")

    def relaxed(frontier: DataFrame, by: DataFrame) -> DataFrame:
        """best with the ways that go on from frontier by one edge; fresh marks those that have become shorter."""
        on = by.select("t", F.col("src").alias("mid"), F.col("dst").alias("to"), "w")
        found = frontier.withColumnRenamed("dst", "mid").join(on, ["t", "mid"]).groupBy("t", "src", F.col("to").alias("dst")).agg(F.min(F.col("d") + F.col("w")).alias("new"))
        met = best.join(found, keys, "full")
        shorter = F.col("new") < F.coalesce("d", F.lit(float("inf")))
        return written(met.select(*keys, F.when(shorter, F.col("new")).otherwise(F.col("d")).alias("d"), F.coalesce(shorter, F.lit(False)).alias("fresh")), "ways")

    low: float | None = 0.0
    while low is not None:
        end = (low // step + 1) * step
        inside = (F.col("d") >= low) & (F.col("d") < end)
        frontier = best.where(inside)
        while frontier.limit(1).count():
            best = relaxed(frontier, light)
            frontier = best.where(inside & F.col("fresh"))
        best = relaxed(best.where(inside), heavy)
        low = best.where(F.col("d") >= end).agg(F.min("d")).first()[0]
    longest = best.groupBy("t").agg((F.max("d") + F.lit(1.0)).alias("far"))
    pairs = everyone.withColumnRenamed("node", "src").join(nodes.select(F.col("node").alias("dst")), how="cross")
    known = pairs.join(best.select(*keys, "d"), keys, "left").join(F.broadcast(longest), "t")  # a row a step
    return known.select("t", "src", "dst", F.when(F.col("src") == F.col("dst"), F.lit(0.0)).otherwise(F.coalesce("d", "far")).alias("d"))


def initial_radii(edges: DataFrame, nodes: DataFrame, reg: float = 1e-5) -> DataFrame:
    """node, r: half of a node's ends among all edges; where a node has none all get reg and are scaled to 1."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("n"))
    all_nodes = nodes.select("node").join(ends, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))
    whole = all_nodes.agg(F.sum("n").alias("ends"), F.min("n").alias("least"), F.count("*").alias("nodes"))
    r = F.col("n") / (F.lit(1.0) * F.col("ends"))
    shared = F.when(F.col("least") == 0, (r + reg) / (F.lit(1.0) + reg * F.col("nodes"))).otherwise(r)
    return all_nodes.join(F.broadcast(whole), how="cross").select("node", shared.alias("r"))  # a single row


def window_snapshots(events: DataFrame, width: str, time: str = "ts") -> DataFrame:
    """events with start, the start of the half-open window that a row falls in."""
    return events.withColumn("start", F.window(time, width)["start"])
