"""Chain diagnostics over traces (iter, x), whose iterations are consecutive integers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lags import lag_sums


def detrended(trace: DataFrame) -> DataFrame:
    mean = trace.agg(F.avg("x").alias("mean"))
    return trace.join(F.broadcast(mean), how="cross").select("iter", (F.col("x") - F.col("mean")).alias("x"))  # one row


def autocovariances(trace: DataFrame, maxlags: int) -> DataFrame:
    """lag, ss: sums of products at each lag that some rows have, by blocks of iterations."""
    return lag_sums(detrended(trace).withColumn("order", F.lit(maxlags)), []).where("pairs > 0").select("lag", "ss")


def acf(trace: DataFrame, maxlags: int = 100) -> DataFrame:
    """lag, rho, with the whole sum of squares below; rho is null for a constant trace."""
    ss = autocovariances(trace, maxlags)
    zero = ss.where("lag = 0").select(F.col("ss").alias("all"))
    return ss.join(F.broadcast(zero), how="cross").select("lag", F.try_divide(F.col("ss"), F.col("all")).alias("rho"))


def ess(trace: DataFrame, maxlags: int = 100) -> DataFrame:
    """S / (1 + 2 sum of rho), over all lags up to the last."""
    n = trace.agg(F.count("*").alias("n"))
    rho = acf(trace, maxlags).where("lag > 0").agg(F.sum("rho").alias("rho"))
    return n.join(F.broadcast(rho), how="cross").select(F.try_divide(F.col("n").cast("double"), F.lit(1.0) + F.lit(2.0) * F.coalesce("rho", F.lit(0.0))).alias("ess"))


def geweke_means(trace: DataFrame, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """Means of the first and last parts of a trace."""
    ends = trace.agg(F.min("iter").alias("lo"), F.count("*").alias("n"))
    rows = trace.join(F.broadcast(ends), how="cross").withColumn("k", F.col("iter") - F.col("lo"))
    head, tail = F.col("k") < F.floor(F.col("n") * F.lit(first)), F.col("k") >= F.col("n") - F.floor(F.col("n") * F.lit(last))
    return rows.agg(F.avg(F.when(head, F.col("x"))).alias("mean_first"), F.avg(F.when(tail, F.col("x"))).alias("mean_last"))


def _levinson(r: np.ndarray):
    """Yule-Walker coefficients and innovation variances of orders 1, 2, ..."""
    a, v = np.zeros(0), r[0]
    for k in range(1, len(r)):
        reflection = (r[k] - a @ r[k - 1 : 0 : -1]) / v if k > 1 else r[1] / v
        a = np.append(a - reflection * a[::-1], reflection)
        v *= 1 - reflection**2
        yield a, v


def spectrum0_ar(trace: DataFrame, max_order: int | None = None) -> float:
    """Spectral density at 0 of the autoregression of least AIC, by the trace's length; 0 for a constant one.

    Autocovariances are summed in Spark; only max_order + 1 numbers reach the driver.
    """
    n = trace.count()
    order = min(max_order or int(10 * math.log10(n)), n - 1) if n > 1 else 0
    if order < 1:
        return 0.0
    r = np.array([row["ss"] for row in autocovariances(trace, order).orderBy("lag").collect()]) / n
    if r[0] < 1e-12:
        return 0.0
    best = (math.inf, 0.0)
    for a, v in _levinson(r):
        v = max(v, 1e-300)
        aic = n * math.log(v) + 2 * len(a)
        if aic < best[0]:
            best = (aic, v * n / max(1, n - len(a) - 1) / (1 - a.sum()) ** 2)
    return best[1] / n


def geweke(trace: DataFrame, first: float = 0.1, last: float = 0.5) -> tuple[float, float]:
    """z and its two-sided p-value."""
    bounds = trace.agg(F.min("iter").alias("lo"), F.count("*").alias("n")).first()
    lo, n = bounds["lo"], bounds["n"]
    head, tail = trace.where(F.col("iter") < lo + int(n * first)), trace.where(F.col("iter") >= lo + n - int(n * last))
    means = geweke_means(trace, first, last).first()
    spread = spectrum0_ar(head) + spectrum0_ar(tail)
    if spread <= 0:
        return 0.0, 1.0
    z = (means["mean_first"] - means["mean_last"]) / math.sqrt(spread)
    return z, 1 - math.erf(abs(z) / math.sqrt(2))
