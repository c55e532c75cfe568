"""Missing dyads: masks for hold-out tests, and simple imputation. A dyad table has t, src, dst and a nullable y."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import placed


def hashed(seed: int = 0) -> Column:
    """A number in [0, 1) for a dyad, the same on every run and in every partition."""
    return F.pmod(F.xxhash64(F.lit(seed), "t", "src", "dst"), F.lit(1 << 53)) / F.lit(float(1 << 53))


def arithmetic(modulus: int = 1000) -> Column:
    """A dyad's residue by plain arithmetic, the same in any engine."""
    return (F.col("t") * 7919 + F.col("src") * 104729 + F.col("dst") * 1299709) % modulus


def train_test_split(dyads: DataFrame, test_size: float | int, order: Column | None = None, seed: int = 0, cells: int = 4096) -> DataFrame:
    """dyads with held_out: of each step's undirected dyads a share (rounded up) or a number, by a hash's order, then src and dst.

    order: any number, never null. Dyads fall into cells of the order's range; counts of cells (a row for each step and
    cell) tell the cell in which the last one held out lies, and only that cell's dyads are ranked, by ranges.
    """
    rated = dyads.withColumn("_order", order if order is not None else hashed(seed))
    at = F.col("_order").cast("double")
    bounds = rated.groupBy("t").agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.count("*").alias("_n"))
    wanted = F.ceil(F.lit(test_size) * F.col("_n")) if isinstance(test_size, float) else F.lit(test_size)
    bounds = bounds.withColumn("_wanted", F.greatest(wanted.cast("long"), F.lit(0)))
    cell = F.floor(F.coalesce(F.try_divide(at - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * F.lit(cells))
    placed_in = rated.join(F.broadcast(bounds), "t").withColumn("_cell", cell)  # a row a step
    counts = placed_in.groupBy("t", "_cell", "_wanted").agg(F.count("*").alias("_count"))
    upto = F.sum("_count").over(W.partitionBy("t").orderBy("_cell"))
    last = counts.withColumn("_upto", upto).where("_upto >= _wanted").groupBy("t").agg(F.min(F.struct("_cell", (F.col("_wanted") - F.col("_upto") + F.col("_count")).alias("_left"))).alias("_last"))
    told = placed_in.join(F.broadcast(last.select("t", F.col("_last._cell").alias("_last"), F.col("_last._left").alias("_left"))), "t", "left")
    clear = told.where("_last IS NULL OR _cell <> _last").withColumn("held_out", F.coalesce(F.col("_cell") < F.col("_last"), F.lit(True)))
    split = placed(told.where("_cell = _last"), ["t"], ["_order", "src", "dst"], "_place").withColumn("held_out", F.col("_place") < F.col("_left"))
    return clear.select(*dyads.columns, "held_out").union(split.select(*dyads.columns, "held_out"))


def masked(dyads: DataFrame) -> DataFrame:
    """Held-out dyads lose their y."""
    return dyads.withColumn("y", F.when(~F.col("held_out"), F.col("y")))


def imputed(dyads: DataFrame, strategy: str = "most_frequent", seed: int = 123) -> DataFrame:
    """Missing y by the step's commonest value (the smaller among equals), or drawn with the observed dyads' density."""
    seen = dyads.groupBy("t").agg(F.avg(F.col("y").cast("double")).alias("mean"))
    fill = (F.col("mean") > 0.5).cast("int") if strategy == "most_frequent" else (hashed(seed) < F.col("mean")).cast("int")
    return dyads.join(F.broadcast(seen), "t").withColumn("y", F.coalesce("y", F.when(F.col("mean").isNotNull(), fill).otherwise(0))).drop("mean")


def n_test(n: int, test_size: float | int) -> int:
    return math.ceil(test_size * n * (n - 1) / 2) if isinstance(test_size, float) else test_size
