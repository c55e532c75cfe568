"""Random variates as column expressions of counted uniforms: the same on every run and in every partition.

uniform: a number in (0, 1) of a counter's column, for example of hashed keys and the counter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c, bound, log_normal_cdf, normal_quantile, total

Uniform = Callable[[Column], Column]

#: Tries of the rejection method; each is taken with a chance of over 0.95.
TRIES = 16


def gamma(shape, uniform: Uniform) -> Column:
    """A gamma variate of scale 1 by Marsaglia and Tsang's method: the first try that is taken, of three uniforms each.

    Shapes below 1 are drawn one above and brought down by a power of one more uniform.
    """
    return bound(_c(shape).cast("double"), lambda a: _gamma(a, uniform))


def _gamma(a: Column, uniform: Uniform) -> Column:
    raised = F.when(a < 1, a + F.lit(1.0)).otherwise(a) - F.lit(1 / 3)

    def drawn(d: Column) -> Column:
        def tried(acc: Column, k: Column) -> Column:
            first = F.lit(3) * k
            x = F.sqrt(F.lit(-2.0) * F.log(uniform(first))) * F.cos(F.lit(2 * math.pi) * uniform(first + F.lit(1)))
            return F.when(acc > 0, acc).otherwise(bound(x, lambda x: taken(x, F.greatest(F.lit(1.0) + x / F.sqrt(F.lit(9.0) * d), F.lit(0.0)), uniform(first + F.lit(2)))))

        def taken(x: Column, root: Column, u: Column) -> Column:
            fine = lambda v: (v > 0) & (F.log(u) < F.lit(0.5) * x * x + d - d * v + d * F.log(v))
            return bound(F.pow(root, 3), lambda v: F.when(fine(v), d * v).otherwise(F.lit(0.0)))

        found = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(0.0), tried)
        return bound(found, lambda g: F.when(g > 0, g).otherwise(d))  # after so many tries: never in practice

    return bound(raised, drawn) * F.when(a < 1, F.pow(uniform(F.lit(3 * TRIES)), F.lit(1.0) / a)).otherwise(F.lit(1.0))


def dirichlet(alphas, uniform: Callable[[Column, Column], Column]) -> Column:
    """An array on the simplex: gamma variates by their sum. uniform: of a component's place and a counter."""
    drawn = F.transform(_c(alphas), lambda a, i: gamma(a, lambda k: uniform(i, k)))
    return bound(drawn, lambda gs: bound(total(gs), lambda whole: F.transform(gs, lambda g: g / whole)))


def truncated_normal(mean, variance, lower, upper, u) -> Column:
    """A normal cut to [lower, upper], by the quantile of u between their chances, seen from the side of the smaller tail."""
    m, sd = _c(mean), F.sqrt(_c(variance))
    ends = F.struct(((_c(lower) - m) / sd).alias("a"), ((_c(upper) - m) / sd).alias("b"))

    def drawn(s: Column) -> Column:
        flip = s["a"] > 0
        lo, hi = F.when(flip, -s["b"]).otherwise(s["a"]), F.when(flip, -s["a"]).otherwise(s["b"])
        chances = F.struct(F.exp(log_normal_cdf(lo)).alias("lo"), F.exp(log_normal_cdf(hi)).alias("hi"))
        p = bound(chances, lambda c: c["lo"] + _c(u) * (c["hi"] - c["lo"]))
        z = normal_quantile(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0 - 1e-16)))
        return bound(z, lambda v: F.when(flip, -v).otherwise(v))

    return F.least(F.greatest(m + sd * bound(ends, drawn), _c(lower)), _c(upper))


def tables(n, mass, uniform: Uniform) -> Column:
    """Of n customers the number that open a table: the i-th does with the chance mass / (mass + i)."""
    n, mass = _c(n).cast("int"), _c(mass).cast("double")
    opened = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda m, i: m + (uniform(i) < mass / (mass + i)).cast("int"))
    return F.when(n > 0, opened).otherwise(F.lit(0))
