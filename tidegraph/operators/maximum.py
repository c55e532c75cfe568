"""Maximum-likelihood intercepts and scale of given positions, by damped Newton steps.

The log-odds of a link are linear in two coefficients, so the log-likelihood is concave. What links add is a sum of
their two covariates, taken once over the edge list; a round then needs one row of sums over all pairs of nodes, which
meet by blocks and are never joined with links, kept or shuffled: value, gradient and second derivatives at a point.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import distance, expit, softplus, squared_distance
from ..storage import written
from .likelihood import pairs_of

#: Nodes that a block of a step has at most, on average.
BLOCK = 2000


@dataclass
class Fit:
    """values: the coefficients; loglik: at these; rounds: sums over all pairs; converged: whether the last full step was below the tolerance."""

    values: tuple[float, float]
    loglik: float
    rounds: int
    converged: bool


def _placed(links: DataFrame, positions: DataFrame, squared: bool, carried: tuple[str, ...] = ()) -> DataFrame:
    """links (t, src, dst) with the distance of their ends, and their ends' carried columns."""
    end = lambda side: positions.select("t", F.col("node").alias(side), F.col("x").alias(f"x_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in carried])
    out = links.select("t", "src", "dst").distinct().join(end("src"), ["t", "src"]).join(end("dst"), ["t", "dst"])
    return out.withColumn("d", (squared_distance if squared else distance)("x_src", "x_dst"))


def _sums(pairs: DataFrame, z: tuple[Column, Column], at: tuple[float, float]) -> list[float]:
    """Sums over pairs: the normaliser log(1 + exp(eta)), its two derivatives, and its three second ones."""
    eta = F.lit(at[0]) * z[0] + F.lit(at[1]) * z[1]
    p = expit(eta)
    w = p * (F.lit(1.0) - p)
    values = [softplus(eta), p * z[0], p * z[1], w * z[0] * z[0], w * z[0] * z[1], w * z[1] * z[1]]
    row = pairs.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s{k}") for k, v in enumerate(values)]).first()
    return list(row)


def newton(links: DataFrame, pairs: DataFrame, z: tuple[Column, Column], start: tuple[float, float], missing: DataFrame | None = None, positive: bool = False, tol: float = 1e-8, most: int = 60) -> Fit:
    """The coefficients of z over pairs, of which links are 1 and missing ones aren't counted.

    A step that doesn't raise the likelihood, or leaves the positive side in the first coefficient where positive asks
    for it, is halved. Ends when a step is below tol, or after `most` sums; separable links have no maximum and end so.
    """
    held = links.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"z{k}") for k, c in enumerate(z)]).first()

    def at(point: tuple[float, float]) -> tuple[float, list[float], list[float]]:
        s = _sums(pairs, z, point)
        if missing is not None:
            s = [a - b for a, b in zip(s, _sums(missing, z, point))]
        return held[0] * point[0] + held[1] * point[1] - s[0], [held[0] - s[1], held[1] - s[2]], s[3:]

    point, rounds = start, 1
    value, grad, hess = at(point)
    while rounds < most:
        det = hess[0] * hess[2] - hess[1] * hess[1]
        ridge = 0.0 if det > 1e-12 * max(1e-300, hess[0] * hess[2]) else 1e-6 + 1e-6 * (hess[0] + hess[2])
        a, b, c = hess[0] + ridge, hess[1], hess[2] + ridge
        step = ((c * grad[0] - b * grad[1]) / (a * c - b * b), (a * grad[1] - b * grad[0]) / (a * c - b * b))
        if max(map(abs, step)) < tol:
            return Fit(point, value, rounds, True)
        part = 1.0
        while rounds < most:
            new = (point[0] + part * step[0], point[1] + part * step[1])
            if not positive or new[0] > 0:
                found = at(new)
                rounds += 1
                if math.isfinite(found[0]) and found[0] >= value - 1e-12 * abs(value):
                    point, (value, grad, hess) = new, found
                    break
            part /= 2
            if part * max(map(abs, step)) < tol:
                return Fit(point, value, rounds, False)
    return Fit(point, value, rounds, False)


def _blocks(positions: DataFrame) -> int:
    largest = positions.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    return max(4, -(-largest // BLOCK))


def scale_and_intercept(positions: DataFrame, edges: DataFrame, missing: DataFrame | None = None, squared: bool = False, tol: float = 1e-8) -> Fit:
    """values: scale and intercept of an undirected network, with log-odds intercept - exp(scale) d.

    Both directions of an edge count once; missing: dyads (t, src, dst) that aren't known.
    """
    und = lambda df: df.where("src <> dst").select("t", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    z = (-F.col("d"), F.lit(1.0))
    links, positions = und(edges), written(positions, "mle-positions")  # every round reads them
    gone = _placed(und(missing), positions, squared) if missing is not None else None
    if missing is not None:
        links = links.join(und(missing), ["t", "src", "dst"], "left_anti")
    pairs = pairs_of(positions, ["t"], False, squared, _blocks(positions))
    fit = newton(_placed(links, positions, squared), pairs, z, (1.0, 1.0), gone, positive=True, tol=tol)
    return Fit((math.log(fit.values[0]), fit.values[1]), fit.loglik, fit.rounds, fit.converged)


def directed_intercepts(positions: DataFrame, edges: DataFrame, radii: DataFrame, start: tuple[float, float] = (0.0, 0.0), missing: DataFrame | None = None, squared: bool = False, tol: float = 1e-8) -> Fit:
    """values: the intercepts for receiving and sending, with log-odds b_in (1 - d / r_dst) + b_out (1 - d / r_src)."""
    one = F.lit(1.0)
    z = (one - F.col("d") / F.col("r_dst"), one - F.col("d") / F.col("r_src"))
    links = edges.where("src <> dst").select("t", "src", "dst")
    sized = written(positions.join(radii.select("node", "r"), "node"), "mle-positions")  # every round reads them
    gone = _placed(missing.where("src <> dst"), sized, squared, ("r",)) if missing is not None else None
    if missing is not None:
        links = links.join(missing, ["t", "src", "dst"], "left_anti")
    pairs = pairs_of(sized, ["t"], True, squared, _blocks(sized), ("r",))
    return newton(_placed(links, sized, squared, ("r",)), pairs, z, start, gone, tol=tol)
