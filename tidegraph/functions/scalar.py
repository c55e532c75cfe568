"""Column expressions of the models; none leaves the engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def expit(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def softplus(z) -> Column:
    """log(1 + exp(z)) without overflow."""
    z = _c(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def total(array) -> Column:
    return F.aggregate(_c(array), F.lit(0.0), lambda a, x: a + x)


def squared_distance(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def distance(x, y) -> Column:
    return F.sqrt(squared_distance(x, y))


def manhattan(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a - b)))


def chebyshev(x, y) -> Column:
    return F.array_max(F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a - b)))


def cosine(x, y) -> Column:
    """1 - the cosine; null where a vector is zero."""
    dot = lambda u, v: total(F.zip_with(_c(u), _c(v), lambda a, b: a * b))
    return F.lit(1.0) - F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


#: Distances by name, as functions of two arrays.
METRICS = {"euclidean": distance, "sqeuclidean": squared_distance, "manhattan": manhattan, "chebyshev": chebyshev, "cosine": cosine}


def combined(a, x, b, y) -> Column:
    """a x + b y of two arrays."""
    return F.zip_with(_c(x), _c(y), lambda u, v: _c(a) * u + _c(b) * v)


def normal_logpdf(x, mean, variance, p: int) -> Column:
    """Log density of a spherical normal over p dimensions."""
    v = _c(variance)
    return F.lit(-0.5 * p) * F.log(F.lit(2 * math.pi) * v) - squared_distance(x, mean) / (F.lit(2.0) * v)


def normal_pdf(x, mean, variance, p: int) -> Column:
    return F.exp(normal_logpdf(x, mean, variance, p))


#: Lanczos' coefficients of the gamma function for g = 7 and nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def bound(value, f) -> Column:
    """f of a value that is computed once, however often f has it: an expression has no names for its parts."""
    return F.transform(F.array(value), f)[0]


def lgamma(x) -> Column:
    """log of the gamma function of x > 0."""
    return bound(_c(x).cast("double"), _lgamma)


def _lgamma(x: Column) -> Column:
    y = F.when(x < 0.5, F.lit(1.0) - x).otherwise(x) - F.lit(1.0)
    t = y + F.lit(7.5)
    series = sum((F.lit(c) / (y + F.lit(float(k))) for k, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    value = F.lit(0.5 * math.log(2 * math.pi)) + (y + F.lit(0.5)) * F.log(t) - t + F.log(series)
    return F.when(x < 0.5, F.log(F.lit(math.pi) / F.sin(F.lit(math.pi) * x)) - value).otherwise(value)


def log_erfc(x) -> Column:
    """log(1 - erf(x)), far into the tail: a series near 0, a continued fraction beyond."""
    return bound(_c(x).cast("double"), _log_erfc)


def _log_erfc(x: Column) -> Column:
    a = F.abs(x)
    square = x * x
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, k: F.struct((acc["t"] * F.lit(2.0) * square / (F.lit(2.0) * k + F.lit(1.0))).alias("t"), (acc["s"] + acc["t"] * F.lit(2.0) * square / (F.lit(2.0) * k + F.lit(1.0))).alias("s")),
        lambda acc: acc["s"],
    )
    near = F.lit(2 / math.sqrt(math.pi)) * x * F.exp(-square) * terms  # erf
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda acc, k: a + F.lit(0.5) * k / acc)
    far = -square - F.log(fraction) - F.lit(0.5 * math.log(math.pi))
    return F.when(a <= 2.0, F.log1p(-near)).when(x > 0, far).otherwise(F.log(F.lit(2.0) - F.exp(far)))


def log_normal_cdf(z) -> Column:
    return log_erfc(-_c(z) / F.lit(math.sqrt(2.0))) - F.lit(math.log(2.0))


def normal_cdf(z) -> Column:
    return F.exp(log_normal_cdf(z))


#: Acklam's rational approximation of the normal quantile.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _polynomial(x: Column, coefficients) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def normal_quantile(p) -> Column:
    """The z with normal_cdf(z) = p in (0, 1): an approximation and one step of Halley's method."""

    def approximated(low: Column) -> Column:
        tail = bound(F.sqrt(F.lit(-2.0) * F.log(low)), lambda q: _polynomial(q, QUANTILE_C) / (_polynomial(q, QUANTILE_D) * q + F.lit(1.0)))
        centre = bound(low - F.lit(0.5), lambda mid: mid * _polynomial(mid * mid, QUANTILE_A) / (_polynomial(mid * mid, QUANTILE_B) * mid * mid + F.lit(1.0)))
        return F.when(low < 0.02425, tail).otherwise(centre)

    def mended(low: Column, z: Column) -> Column:
        e = (normal_cdf(z) - low) * F.lit(math.sqrt(2 * math.pi)) * F.exp(z * z / F.lit(2.0))
        return bound(e, lambda off: z - off / (F.lit(1.0) + z * off / F.lit(2.0)))

    def sided(p: Column) -> Column:
        low = F.least(p, F.lit(1.0) - p)
        z = bound(low, lambda q: bound(approximated(q), lambda z: mended(q, z)))
        return bound(z, lambda v: F.when(p <= 0.5, v).otherwise(-v))

    return bound(_c(p).cast("double"), sided)


def dirichlet_logpdf(x, alphas) -> Column:
    """Of arrays on the simplex; entries of both are raised to the least normal double."""
    raised = lambda v: F.greatest(v.cast("double"), F.lit(TINY))
    a = F.transform(_c(alphas), raised)
    parts = F.zip_with(_c(x), a, lambda u, v: (v - F.lit(1.0)) * F.log(raised(u)) - lgamma(v))
    return lgamma(total(a)) + total(parts)


def multivariate_t_logpdf(x, df, mean, scale) -> Column:
    """Of arrays, with a scale that is the same in all dimensions."""
    n, s, p = _c(df).cast("double"), _c(scale).cast("double"), F.size(_c(x)).cast("double")
    half = (n + p) / F.lit(2.0)
    return lgamma(half) - lgamma(n / F.lit(2.0)) - p / F.lit(2.0) * F.log(n * F.lit(math.pi) * s) - half * F.log1p(squared_distance(x, mean) / s / n)


def truncated_normal_logpdf(x, mean, variance, lower, upper) -> Column:
    """Of a normal cut to [lower, upper]; minus infinity outside."""
    x, m, v = (_c(c).cast("double") for c in (x, mean, variance))
    a, b = ((_c(c).cast("double") - m) / F.sqrt(v) for c in (lower, upper))
    # both ends are looked at from the side where the normal's tail is small
    ends = bound(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when(s["a"] > 0, F.struct((-s["b"]).alias("lo"), (-s["a"]).alias("hi"))).otherwise(F.struct(s["a"].alias("lo"), s["b"].alias("hi"))))
    logs = bound(ends, lambda s: F.struct(log_normal_cdf(s["lo"]).alias("lo"), log_normal_cdf(s["hi"]).alias("hi")))
    mass = bound(logs, lambda s: s["hi"] + F.log1p(-F.exp(s["lo"] - s["hi"])))
    inside = F.lit(-0.5) * F.log(F.lit(2 * math.pi) * v) - (x - m) * (x - m) / (F.lit(2.0) * v) - mass
    return F.when((x >= _c(lower)) & (x <= _c(upper)), inside).otherwise(F.lit(float("-inf")))
