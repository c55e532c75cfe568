"""Diagnostics of many traces at once: rows (keys, iter, x), a trace for each chain and parameter, iterations consecutive.

Autocovariances are sums by trace and lag, by blocks of iterations; a trace's own (as many as its order asks for, some dozens) are one array, over
which the Yule-Walker equations are solved by a fold, an order a step. No trace reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf
from ..storage import written
from .lags import lag_sums


def trace_table(scalars: DataFrame, keys: list[str], parameters: list[str]) -> DataFrame:
    """keys, parameter, iter, x: a row for each sample and parameter of scalars (keys, iter, parameters); nulls are left out."""
    wide = scalars.select(*keys, "iter", *[F.col(f"`{c}`").cast("double").alias(c) for c in parameters])
    return wide.unpivot([*keys, "iter"], parameters, "parameter", "x").where("x IS NOT NULL").select(*keys, "parameter", "iter", "x")


def retained(traces: DataFrame, n_burn: int = 0) -> DataFrame:
    return traces.where(F.col("iter") >= n_burn)


def autocovariances(traces: DataFrame, keys: list[str], max_order: int | None = None) -> DataFrame:
    """keys, n and r: a trace's length and its autocovariances (by n) at lags 0 to its order, int(10 log10 n) by default."""
    sizes = traces.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    most = F.lit(max_order) if max_order is not None else F.floor(F.lit(10.0) * F.log10("n")).cast("int")
    sizes = sizes.withColumn("order", F.least(most, F.col("n") - 1).cast("int"))
    x = traces.join(sizes.withColumn("order", F.greatest("order", F.lit(0))), keys).select(*keys, "iter", (F.col("x") - F.col("mean")).alias("x"), "n", "order")
    sums = lag_sums(x, [*keys, "n"]).withColumn("r", F.col("ss") / F.col("n"))
    return sums.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "r"))), lambda s: s["r"]).alias("r"))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def spectrum0() -> Column:
    """Of columns n and r: the spectral density at 0 of the autoregression of least AIC, by n; 0 for a constant trace."""
    r, n = F.col("r"), F.col("n").cast("double")

    def step(acc: Column, k: Column) -> Column:
        heard = _total(F.zip_with(acc["a"], F.reverse(F.slice(r, 2, F.size(acc["a"]))), lambda a, b: a * b))
        turn = (F.element_at(r, k + 1) - heard) / acc["v"]
        a = F.concat(F.zip_with(acc["a"], F.reverse(acc["a"]), lambda u, w: u - turn * w), F.array(turn))
        v = F.greatest(acc["v"] * (F.lit(1.0) - turn * turn), F.lit(1e-300))
        aic = n * F.log(v) + F.lit(2.0) * k
        density = v * n / F.greatest(F.lit(1.0), n - k - 1) / F.pow(F.lit(1.0) - _total(a), 2)
        better = aic < acc["aic"]
        return F.struct(a.alias("a"), v.alias("v"), F.when(better, aic).otherwise(acc["aic"]).alias("aic"), F.when(better, density).otherwise(acc["best"]).alias("best"))

    start = F.struct(F.array().cast("array<double>").alias("a"), r[0].alias("v"), F.lit(float("inf")).alias("aic"), F.lit(0.0).alias("best"))
    found = F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), start, step, lambda acc: acc["best"]) / n
    return F.when((F.size(r) > 1) & (r[0] >= 1e-12), found).otherwise(F.lit(0.0))


def spectra(traces: DataFrame, keys: list[str], max_order: int | None = None) -> DataFrame:
    """keys, n, spectrum0."""
    return autocovariances(traces, keys, max_order).select(*keys, "n", spectrum0().alias("spectrum0"))


def geweke(traces: DataFrame, keys: list[str], first: float = 0.1, last: float = 0.5, n_burn: int = 0) -> DataFrame:
    """keys, z, p of every trace: the means of its first and last parts, by their spectra. z is 0 where neither part moves.

    n_burn: iterations before it are left aside. Parts that are empty leave z and p null.
    """
    kept = retained(traces, n_burn)
    bounds = kept.groupBy(*keys).agg(F.min("iter").alias("lo"), F.count("*").alias("n"))
    at, n = F.col("iter") - F.col("lo"), F.col("n")
    parts = F.filter(F.array(F.when(at < F.floor(n * F.lit(first)), F.lit(0)), F.when(at >= n - F.floor(n * F.lit(last)), F.lit(1))), lambda v: v.isNotNull())
    rows = written(kept.join(bounds, keys).select(*keys, F.explode(parts).alias("part"), "iter", "x"), "trace-parts")  # read three times
    means = rows.groupBy(*keys, "part").agg(F.avg("x").alias("mean"))
    of = means.join(spectra(rows, [*keys, "part"]), [*keys, "part"])
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    both = of.groupBy(*keys).agg(pick(0, "mean").alias("m0"), pick(1, "mean").alias("m1"), (pick(0, "spectrum0") + pick(1, "spectrum0")).alias("spread"))
    z = F.when(F.col("spread") > 0, (F.col("m0") - F.col("m1")) / F.sqrt("spread")).when(F.col("spread").isNotNull(), F.lit(0.0))
    return both.select(*keys, z.alias("z")).withColumn("p", F.lit(2.0) * normal_cdf(-F.abs("z")))
