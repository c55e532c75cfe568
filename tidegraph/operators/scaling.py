"""Positions from dissimilarities: stress majorisation, and the leading eigenvectors of double-centred squares.

Dissimilarities are a table of all ordered pairs of nodes; a round joins it with the positions of both ends, which are
a row a node, and sums by node. Joins leave the choice between broadcast (by measured size) and a shuffle to adaptive
execution. The driver sees p by p sums. Rounds are tables in the shared folder. Every operation on a column is several
calls to the JVM: what a round repeats for each cell of a matrix is therefore one expression given as text, and its
numbers are array literals, so that the code generated for a round serves the next.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import distance
from ..storage import written
from .network import shortest_paths


def started(nodes: DataFrame, p: int, seed: int = 1) -> DataFrame:
    """node, x: hashed uniform coordinates, the same on every run."""
    axis = lambda k: F.pmod(F.xxhash64(F.lit(seed), "node", F.lit(k)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return nodes.select("node", F.array(*[axis(k) for k in range(p)]).alias("x"))


def _ends(far: DataFrame, positions: DataFrame) -> DataFrame:
    side = lambda s: positions.selectExpr(f"node AS {s}", f"x AS x_{s}")
    return far.join(side("src"), "src").join(side("dst"), "dst")


def majorised(far: DataFrame, positions: DataFrame, n: int, p: int = 2) -> DataFrame:
    """node, x after one Guttman transform, and each node's half of the stress before it.

    far: src, dst, d of all ordered pairs of the n nodes; positions: node, x.
    """
    apart = " + ".join(f"(x_src[{k}] - x_dst[{k}]) * (x_src[{k}] - x_dst[{k}])" for k in range(p))
    ends = _ends(far.where("src <> dst"), positions).withColumn("apart", F.expr(f"sqrt({apart})"))
    sums = ", ".join(f"sum(IF(apart > 0, d / apart, 0D) * (x_src[{k}] - x_dst[{k}])) / {float(n)!r}D" for k in range(p))
    moved = ends.groupBy("src").agg(F.expr(f"array({sums}) AS x"), F.expr("sum(pow(apart - d, 2)) / 2D AS stress"))
    return moved.withColumnRenamed("src", "node").select("node", "x", "stress")


def stress(far: DataFrame, positions: DataFrame) -> DataFrame:
    """stress: squared differences of distances and dissimilarities over unordered pairs."""
    ends = _ends(far.where("src < dst"), positions)
    return ends.agg(F.sum(F.pow(distance("x_src", "x_dst") - F.col("d"), 2)).alias("stress"))


def smacof(far: DataFrame, nodes: DataFrame, p: int = 2, rounds: int = 300, eps: float = 1e-3, seeds: tuple[int, ...] = (1,)) -> DataFrame:
    """node, x of least stress among the starts; a start ends when a round lowers stress by less than eps of it."""
    far = written(far.select("src", "dst", "d"), "scaling-far")
    n = nodes.count()
    best: tuple[float, DataFrame] | None = None
    for seed in seeds:
        x, last = written(started(nodes, p, seed), "scaling"), math.inf
        for _ in range(rounds):
            new = written(majorised(far, x, n, p), "scaling")
            now = new.agg(F.sum("stress")).first()[0] or 0.0  # of x: the new one's is not above it
            x = new.select("node", "x") if n > 1 else x
            if last - now < eps * max(now, 1e-300):
                break
            last = now
        if best is None or now < best[0]:
            best = (now, x)
    return best[1]


def _matrix(rows: DataFrame, left: str, right: str, width: int, other: int | None = None) -> np.ndarray:
    """Sums over nodes of the outer products of two columns of arrays."""
    cells = rows.select(F.posexplode(left).alias("a", "p"), right).select("a", "p", F.posexplode(right).alias("b", "q"))
    out = np.zeros((width, other or width))
    for a, b, v in cells.groupBy("a", "b").agg(F.expr("sum(p * q)")).collect():
        out[a, b] = v or 0.0
    return out


def _times(column: str, m: np.ndarray) -> Column:
    """An array column, as a row vector, times a small matrix."""
    columns = ", ".join(f"array({', '.join(f'{float(v)!r}D' for v in col)})" for col in m.T)
    return F.expr(f"transform(array({columns}), m -> aggregate(zip_with({column}, m, (a, b) -> a * b), 0D, (s, v) -> s + v))")


def _orthonormal(moments: np.ndarray, c: np.ndarray) -> np.ndarray:
    """c, the weights of a basis over columns with these moments, changed so that the basis is orthonormal."""
    lam, q = np.linalg.eigh(c.T @ moments @ c)
    return c @ (q * np.where(lam > 1e-14 * max(lam.max(), 1e-300), 1 / np.sqrt(np.maximum(lam, 1e-300)), 0.0))


def leading(far: DataFrame, before: DataFrame, n: int, p: int = 2, lmbda: float = 10.0, rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """node, x: the p leading eigenvectors of (B + lmbda X X') / (1 + lmbda) by the roots of their values.

    B is -1/2 of the double-centred squares of far (src, dst, d of all ordered pairs), X the positions before (node, x).
    Block power iteration with a few more vectors than asked for. A round multiplies the squares with the basis, in one
    join and sum, and takes the moments of all columns u = (1, x, v, w); centring, the part of X, a shift that keeps
    negative values from leading, and the next basis are then weights over u.
    """
    alpha, beta, width = 1 / (1 + lmbda), lmbda / (1 + lmbda), min(n, p + 4)
    one, at_v, at_w = slice(0, 1), slice(1 + p, 1 + p + width), slice(1 + p + width, 1 + p + 2 * width)
    table = before.join(started(before.select("node"), width, 7).withColumnRenamed("x", "v"), "node")
    u, size = F.concat(F.array(F.lit(1.0)), "x", "v"), 1 + p + width
    table = written(table.select("node", "x", u.alias("u")), "scaling-basis")
    moments = _matrix(table, "u", "u", size)
    weights = np.zeros((size, width))
    weights[at_v] = np.eye(width)
    weights[one] = -moments[0, at_v] / n
    shift, last = 0.0, None
    for _ in range(rounds):
        weights = _orthonormal(moments, weights)
        centred = weights.copy()
        centred[one] -= moments[0] @ weights / n  # u begins with a 1
        basis = table.select("node", "x", _times("u", weights).alias("v"))
        v = table.select(F.col("node").alias("dst"), _times("u", centred).alias("v"))
        sums = far.join(v, "dst").groupBy("src").agg(F.expr(f"array({', '.join(f'{-0.5 * alpha!r}D * sum(d * d * v[{k}])' for k in range(width))}) AS w"))
        rows = sums.withColumnRenamed("src", "node")
        u, size = F.concat(F.array(F.lit(1.0)), "x", "v", "w"), 1 + p + 2 * width
        table = written(basis.join(rows, "node").select("node", "x", u.alias("u")), "scaling-basis")
        moments = _matrix(table, "u", "u", size)
        image = np.zeros((size, width))  # the matrix times the basis, as weights over u
        image[at_w] = np.eye(width)
        image[one] = -moments[0, at_w] / n
        image[1 : 1 + p] = beta * moments[1 : 1 + p, at_v]
        ritz = moments[at_v] @ image
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        if last is not None and np.all(np.abs(values[:p] - last) <= tol * max(1e-300, abs(values).max())):
            break
        last, shift = values[:p], max(shift, -float(values.min()))
        weights = image
        weights[at_v] = shift * np.eye(width)
    roots = turn[:, :p] * np.sqrt(np.maximum(values[:p], 0.0))
    return table.select("node", _times(f"slice(u, {2 + p}, {width})", roots).alias("x"))


def turned(reference: DataFrame, positions: DataFrame, p: int = 2) -> DataFrame:
    """positions (node, x) turned, or mirrored, to lie nearest to the reference."""
    both = positions.join(reference.select("node", F.col("x").alias("to")), "node")
    u, _, v = np.linalg.svd(_matrix(both, "x", "to", p))
    return positions.select("node", _times("x", u @ v).alias("x"))


def generalised_mds(edges: DataFrame, nodes: DataFrame, p: int = 2, lmbda: float = 10.0, directed: bool = False, far: DataFrame | None = None, **first) -> DataFrame:
    """t, node, x: scaling of the first step's path lengths, then each step's leaning on the step before.

    far: t, src, dst, d of all ordered pairs; by default the lengths of shortest paths. For directed networks positions
    are divided by the number of nodes.
    """
    far = written(far if far is not None else shortest_paths(edges, nodes), "scaling-paths")
    n = nodes.count()
    before, out = None, None
    for t in sorted(r["t"] for r in far.select("t").distinct().collect()):
        own = far.where(F.col("t") == t).select("src", "dst", "d")
        x = smacof(own, nodes.select("node"), p, **first) if before is None else turned(before, leading(own, before, n, p, lmbda), p)
        before = written(x, "scaling")
        step = before.select(F.lit(t).cast("int").alias("t"), "node", "x")
        out = step if out is None else out.union(step)
    scale = F.lit(1.0 / n) if directed else F.lit(1.0)
    return out.select("t", "node", F.transform("x", lambda v: v * scale).alias("x"))
