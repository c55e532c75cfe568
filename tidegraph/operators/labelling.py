"""Labels of nodes given their positions: smoothed probabilities, a drawn path and the likeliest one.

A node's steps are one array, folded twice inside the engine: backward messages from its last step to its first (what
the later positions say of a label), then forward from the first (chances, a draw, or the best choice). Every message
is scaled by its largest entry in logarithms, so that no density becomes zero. init, trans and clusters are of K and K x
K size and become literals of the fold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .likelihood import gaussian_likelihood


def _at(array: Column, place: Column) -> Column:
    return F.element_at(array, (place + 1).cast("int"))


def _literal(values) -> Column:
    return F.array(*[_literal(v) if isinstance(v, (list, tuple)) else F.lit(float(v)) for v in values])


@dataclass
class Chain:
    """Starting and moving chances of K labels as literals; ks: the labels in order, which places number."""

    ks: list[int]
    init: Column
    moves: Callable[[Column], Column]  # of the step that is moved into: the matrix, a row for each label that is left

    @classmethod
    def of(cls, init: DataFrame, trans: DataFrame, clusters: DataFrame) -> Chain:
        """init: k, w; trans: k_from, k_to, w, with t (the step that is moved into) or for all steps; clusters: k."""
        ks = sorted(r["k"] for r in clusters.select("k").collect())
        place = {k: i for i, k in enumerate(ks)}
        first = [0.0] * len(ks)
        for r in init.collect():
            first[place[r["k"]]] = r["w"]
        timed = "t" in trans.columns
        table: dict = {}
        for r in trans.collect():
            table.setdefault(r["t"] if timed else None, [[0.0] * len(ks) for _ in ks])[place[r["k_from"]]][place[r["k_to"]]] = r["w"]
        if not timed:
            return cls(ks, _literal(first), lambda t: _literal(table.get(None, [])))
        by_step = F.create_map(*[x for t, m in table.items() for x in (F.lit(t), _literal(m))])
        return cls(ks, _literal(first), lambda t: F.try_element_at(by_step, t))

    def each(self, f: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(self.ks) - 1)), f)


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _log(v: Column) -> Column:
    return F.when(v > 0, F.log(v)).otherwise(F.lit(float("-inf")))


def _scaled(logs: Column) -> Column:
    """exp of logarithms, with 1 for the largest; all 1 where all are minus infinity."""
    most = F.array_max(logs)
    return F.transform(logs, lambda v: F.when(most > float("-inf"), F.exp(v - most)).otherwise(F.lit(1.0)))


def _paths(positions: DataFrame, clusters: DataFrame, lmbda: float, p: int) -> DataFrame:
    """node and path: an array of (t, the log densities of the position under every label, in their order)."""
    rated = gaussian_likelihood(positions, clusters, lmbda, p).groupBy("node", "t").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("rated"))
    step = F.struct("t", F.transform("rated", lambda s: s["value"]).alias("ll"))
    return rated.groupBy("node").agg(F.sort_array(F.collect_list(step)).alias("path"))


def _backward(chain: Chain, combine: Callable[[Column, Column], Column]) -> Column:
    """The path with each step's log density plus the message of what follows, first step first.

    combine(row, logs): what a label with that row of chances hears, as a logarithm, from the next step's logs.
    """
    none = F.array().cast("array<struct<t: int, part: array<double>>>")
    ones = F.array_repeat(F.lit(0.0), len(chain.ks))

    def step(acc: Column, s: Column) -> Column:
        part = F.zip_with(s["ll"], acc["heard"], lambda a, b: a + b)
        message = chain.each(lambda j: combine(_at(chain.moves(s["t"]), j), part))
        most = F.array_max(message)
        kept = F.transform(message, lambda v: F.when(most > float("-inf"), v - most).otherwise(F.lit(0.0)))
        return F.struct(F.concat(F.array(F.struct(s["t"].cast("int").alias("t"), part.alias("part"))), acc["done"]).alias("done"), kept.alias("heard"))

    start = F.struct(none.alias("done"), ones.alias("heard"))
    # the message into a first step would ask for the moves into it: it is made, and thrown away, from those of the next
    return F.aggregate(F.reverse("path"), start, step, lambda acc: acc["done"])


def _sum_heard(row: Column, logs: Column) -> Column:
    most = F.array_max(logs)
    total = _total(F.zip_with(row, logs, lambda w, v: F.when(most > float("-inf"), w * F.exp(v - most)).otherwise(F.lit(0.0))))
    return _log(total) + most


def _max_heard(row: Column, logs: Column) -> Column:
    return F.array_max(F.zip_with(row, logs, lambda w, v: _log(w) + v))


def _numbered(folded: DataFrame, chain: Chain, value: Callable[[Column], list[Column]]) -> DataFrame:
    """A row for each step of folded (node, out: an array of structs with t)."""
    return folded.select("node", F.explode("out").alias("s")).select(F.col("s.t").alias("t"), "node", *value(F.col("s")))


def marginals(positions: DataFrame, init: DataFrame, trans: DataFrame, clusters: DataFrame, lmbda: float, p: int = 2) -> DataFrame:
    """t, node, k, p: the chance of every label at every step given all of the node's positions."""
    chain = Chain.of(init, trans, clusters)
    back = _paths(positions, clusters, lmbda, p).select("node", _backward(chain, _sum_heard).alias("path"))

    def step(acc: Column, s: Column) -> Column:
        part = _scaled(s["part"])
        first = F.size(acc["out"]) == 0
        moves = chain.moves(s["t"])

        def onward(j: Column) -> Column:
            """The chances of the next label from label j, times that of label j."""
            row = F.zip_with(_at(moves, j), part, lambda w, v: w * v)
            return F.transform(row, lambda v: F.coalesce(F.try_divide(_at(acc["now"], j) * v, _total(row)), F.lit(0.0)))

        came = chain.each(onward)
        sums = chain.each(lambda i: _total(F.transform(came, lambda row: _at(row, i))))
        now = F.when(first, F.zip_with(chain.init, part, lambda w, v: w * v)).otherwise(sums)
        share = F.transform(now, lambda v: F.coalesce(F.try_divide(v, _total(now)), F.lit(0.0)))
        return F.struct(share.alias("now"), F.concat(acc["out"], F.array(F.struct(s["t"].alias("t"), share.alias("p")))).alias("out"))

    start = F.struct(F.array().cast("array<double>").alias("now"), F.array().cast("array<struct<t: int, p: array<double>>>").alias("out"))
    folded = back.select("node", F.aggregate("path", start, step, lambda acc: acc["out"]).alias("out"))
    rows = folded.select("node", F.explode("out").alias("s")).select(F.col("s.t").alias("t"), "node", F.posexplode("s.p").alias("place", "p"))
    return rows.select("t", "node", _at(F.array(*[F.lit(k) for k in chain.ks]), F.col("place")).alias("k"), "p")


def drawn_path(positions: DataFrame, init: DataFrame, trans: DataFrame, clusters: DataFrame, lmbda: float, uniform: Callable[[Column, Column], Column], p: int = 2) -> DataFrame:
    """t, node, z: a path of labels drawn from their joint distribution given the positions.

    uniform: a number in [0, 1) of a node and a step; a label is the first whose cumulated chance reaches it.
    """
    chain = Chain.of(init, trans, clusters)
    back = _paths(positions, clusters, lmbda, p).select("node", _backward(chain, _sum_heard).alias("path"))

    def step(acc: Column, s: Column) -> Column:
        part = _scaled(s["part"])
        row = F.when(acc["z"] < 0, chain.init).otherwise(_at(chain.moves(s["t"]), F.greatest(acc["z"], F.lit(0))))
        share = F.zip_with(row, part, lambda w, v: w * v)
        upto = F.aggregate(share, F.array().cast("array<double>"), lambda a, v: F.concat(a, F.array(v + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))
        aim = uniform(F.col("node"), s["t"]) * F.element_at(upto, -1)
        z = F.size(F.filter(upto, lambda v: v < aim)).cast("int")
        return F.struct(z.alias("z"), F.concat(acc["out"], F.array(F.struct(s["t"].alias("t"), z.alias("z")))).alias("out"))

    return _chosen(back, chain, step)


def best_path(positions: DataFrame, init: DataFrame, trans: DataFrame, clusters: DataFrame, lmbda: float, p: int = 2) -> DataFrame:
    """t, node, z: the likeliest path of labels; of equal choices the first label, step by step."""
    chain = Chain.of(init, trans, clusters)
    back = _paths(positions, clusters, lmbda, p).select("node", _backward(chain, _max_heard).alias("path"))

    def step(acc: Column, s: Column) -> Column:
        row = F.when(acc["z"] < 0, chain.init).otherwise(_at(chain.moves(s["t"]), F.greatest(acc["z"], F.lit(0))))
        logs = F.zip_with(row, s["part"], lambda w, v: _log(w) + v)
        z = (F.array_position(logs, F.array_max(logs)) - 1).cast("int")
        return F.struct(z.alias("z"), F.concat(acc["out"], F.array(F.struct(s["t"].alias("t"), z.alias("z")))).alias("out"))

    return _chosen(back, chain, step)


def _chosen(back: DataFrame, chain: Chain, step: Callable[[Column, Column], Column]) -> DataFrame:
    start = F.struct(F.lit(-1).alias("z"), F.array().cast("array<struct<t: int, z: int>>").alias("out"))
    folded = back.select("node", F.aggregate("path", start, step, lambda acc: acc["out"]).alias("out"))
    rows = folded.select("node", F.explode("out").alias("s"))
    return rows.select(F.col("s.t").alias("t"), "node", _at(F.array(*[F.lit(k) for k in chain.ks]), F.col("s.z")).alias("z"))
