"""Scores of predictions and partitions, by ranks and contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _stretch(score: Column) -> Column:
    """A number that never falls as the score rises: 4096 stretches to every factor of e, on either side of 0."""
    size = F.floor(F.lit(4096.0) * F.least(F.log(F.abs(score)), F.lit(1e4))) + F.lit(4_000_000)
    signed = F.when(score > 0, size).when(score < 0, -size).otherwise(F.lit(0))
    return F.when(score.isNull(), F.lit(-(1 << 40))).when(F.isnan(score), F.lit(1 << 40)).otherwise(signed)


def auc(scored: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve, ties counting half; null where only one class is seen. Rows with a null y are left out,
    a null score is the lowest and NaN the highest.

    Equal scores are summed up first. Scores are ranked within stretches of their range, which are tasks of their own;
    the ordered pass over all of them holds a row for each stretch.
    """
    by = by or []
    at = scored.where(F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("score")).agg(F.sum(F.col(y).cast("double")).alias("ones"), F.sum(F.lit(1.0) - F.col(y)).alias("zeros"))
    at = at.withColumn("stretch", _stretch(F.col("score").cast("double")))
    before = lambda *keys: F.sum("zeros").over(W.partitionBy(*by, *keys[:-1]).orderBy(keys[-1])) - F.col("zeros")
    inside = at.withColumn("won", F.col("ones") * (before("stretch", "score") + F.col("zeros") * F.lit(0.5)))
    summed = inside.groupBy(*by, "stretch").agg(*[F.sum(c).alias(c) for c in ("won", "ones", "zeros")])
    ranked = summed.withColumn("won", F.col("won") + F.col("ones") * before("stretch"))
    out = ranked.groupBy(*by) if by else ranked
    return out.agg(F.try_divide(F.sum("won"), F.sum("ones") * F.sum("zeros")).alias("auc"))


def contingency(labels: DataFrame, a: str = "a", b: str = "b", by: list[str] | None = None) -> DataFrame:
    return labels.groupBy(*(by or []), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))


def _margins(table: DataFrame, by: list[str]) -> DataFrame:
    over = lambda *c: F.sum("n").over(W.partitionBy(*by, *c))
    return table.withColumn("na", over("a")).withColumn("nb", over("b")).withColumn("total", over())


def variation_of_information(labels: DataFrame, a: str = "a", b: str = "b", by: list[str] | None = None) -> DataFrame:
    """H(a) + H(b) - 2 MI in nats."""
    by = by or []
    table = _margins(contingency(labels, a, b, by), by)
    share = F.col("n") / F.col("total")
    term = share * (F.log(F.col("na")) + F.log(F.col("nb")) - F.lit(2.0) * F.log(F.col("n")))
    out = table.groupBy(*by) if by else table
    return out.agg(F.sum(term).alias("vi"))


def adjusted_rand(labels: DataFrame, a: str = "a", b: str = "b", by: list[str] | None = None) -> DataFrame:
    """1 where both partitions are trivial in the same way."""
    by = by or []
    table = contingency(labels, a, b, by)
    pairs = lambda n: n * (n - F.lit(1.0)) / F.lit(2.0)
    group = lambda df, *c: df.groupBy(*by, *c)
    both = group(table).agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    sides = {s: group(group(table, s).agg(F.sum("n").alias("m"))).agg(F.sum(pairs(F.col("m"))).alias(f"in_{s}")) for s in ("a", "b")}
    if by:
        joined = both.join(sides["a"], by).join(sides["b"], by)
    else:
        joined = both.join(sides["a"], how="cross").join(sides["b"], how="cross")  # single rows
    expected = F.try_divide(F.col("in_a") * F.col("in_b"), pairs(F.col("total")))
    best = (F.col("in_a") + F.col("in_b")) / F.lit(2.0)
    return joined.select(*by, F.coalesce(F.try_divide(F.col("both") - expected, best - expected), F.lit(1.0)).alias("ari"))


def transition_counts(labels: DataFrame) -> DataFrame:
    """t, z0, z1, n: moves of nodes from the step before to t."""
    before = F.lag("z").over(W.partitionBy("node").orderBy("t"))
    moved = labels.withColumn("z0", before).where("z0 IS NOT NULL")
    return moved.groupBy("t", "z0", F.col("z").alias("z1")).agg(F.count("*").alias("n"))


def transition_freqs(labels: DataFrame) -> DataFrame:
    """Moves with their share of where they come from and of where they go."""
    n = transition_counts(labels)
    share = lambda side: F.col("n") / F.sum("n").over(W.partitionBy("t", side))
    return n.select("t", "z0", "z1", "n", share("z0").alias("frac_from"), share("z1").alias("frac_to"))


def alluvial_flows(labels: DataFrame) -> DataFrame:
    """Transition frequencies with the stacked offsets of each flow on either side."""
    flows = transition_freqs(labels)
    upto = lambda first, second: F.sum("n").over(W.partitionBy("t").orderBy(first, second)) - F.col("n")
    return flows.withColumn("offset_from", upto("z0", "z1")).withColumn("offset_to", upto("z1", "z0"))
