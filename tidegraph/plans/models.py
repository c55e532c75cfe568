"""Estimators: chains run as Spark tasks and stream their samples to Parquet; all that follows is a query over them.

A chain is one row (its network's edges, its configuration and seed) and so one task; rows of samples leave it in
blocks, thinned while they are drawn. A seed stands for a chain whatever the number of partitions.
"""

from __future__ import annotations

from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import expit
from ..operators import metrics, posterior
from ..storage import removed, written
from .kernel import Chain, Config

ROWS = (
    "run_id string, chain int, iter int, part string, t int, node int, k int, k_to int, x array<double>, z int, v double"
)
SCALARS = ("logp", "lambda", "tau_sq", "scale_b", "gamma", "alpha0", "alpha", "kappa")


def dense(edges: list, missing: list, n: int, steps: int, directed: bool) -> np.ndarray:
    y = np.zeros((steps, n, n))
    for value, rows in ((1.0, edges), (np.nan, missing)):
        for t, i, j in rows:
            if i != j:
                y[t, i, j] = value
                if not directed:
                    y[t, j, i] = value
    return y


def _rows(run_id: str, chain: int, s: dict, missing: list) -> list[tuple]:
    at = (run_id, chain, s["iter"])
    out = [(*at, name, None, None, None, None, None, None, float(s[name])) for name in SCALARS if name in s]
    out += [(*at, f"b{k}", None, None, None, None, None, None, float(v)) for k, v in enumerate(s["b"])]
    out += [(*at, "position", t, i, None, None, x.tolist(), None, None) for t, xs in enumerate(s["x"]) for i, x in enumerate(xs)]
    out += [(*at, "radius", None, i, None, None, None, None, float(v)) for i, v in enumerate(s["r"])]
    out += [(*at, "missing", t, i, None, j, None, int(s["y"][t, i, j]), None) for t, i, j in missing]
    if "z" in s:
        out += [(*at, "label", t, i, None, None, None, int(z), None) for t, zs in enumerate(s["z"]) for i, z in enumerate(zs)]
        out += [(*at, "cluster", None, None, k, None, m.tolist(), None, float(v)) for k, (m, v) in enumerate(zip(s["mu"], s["sigma"]))]
        out += [(*at, "beta", None, None, k, None, None, None, float(v)) for k, v in enumerate(s["beta"])]
        out += [(*at, "init", None, None, k, None, None, None, float(v)) for k, v in enumerate(s["w0"])]
        for t in range(1, len(s["w"])):
            out += [(*at, "trans", t, None, a, b, None, None, float(v)) for a, row in enumerate(s["w"][t]) for b, v in enumerate(row)]
    return out


def sample(jobs: DataFrame) -> DataFrame:
    """Rows of samples of every job: run_id, chain, seed, n, steps, edges and missing (arrays of t, src, dst), config."""
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches):
        for batch in batches:
            for job in batch.to_dict("records"):
                config = Config(**{k: v for k, v in job["config"].items()})
                edges = [(e["t"], e["src"], e["dst"]) for e in job["edges"]]
                gone = [(e["t"], e["src"], e["dst"]) for e in job["missing"]]
                y = dense(edges, gone, job["n"], job["steps"], config.directed)
                block: list[tuple] = []
                for s in Chain(y, config, [job["seed"], job["chain"]]).run():
                    block += _rows(job["run_id"], job["chain"], s, gone)
                    if len(block) > 50_000:
                        yield pd.DataFrame(block, columns=names)
                        block = []
                if block:
                    yield pd.DataFrame(block, columns=names)

    return jobs.mapInPandas(run, ROWS)


CONFIG_TYPES = {int: "bigint", float: "double", bool: "boolean", str: "string"}


def _config_column(config: Config):
    literal = lambda v, kind: F.lit(v).cast(kind)
    kinds = {k: "string" if k == "kind" else "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) and k != "n_control" else "double" for k, v in asdict(config).items()}
    return F.struct(*[literal(v, kinds[k]).alias(k) for k, v in asdict(config).items()])


class Fit:
    """The samples of one run and what is read off them, as DataFrames."""

    def __init__(self, rows: DataFrame, edges: DataFrame, missing: DataFrame | None, nodes: DataFrame, steps: DataFrame, config: Config):
        self.rows, self.edges, self.missing, self.nodes, self.steps, self.config = rows, edges, missing, nodes, steps, config
        self.best: tuple[int, int] | None = None

    def scalars(self) -> DataFrame:
        names = [*SCALARS, "b0", "b1"]
        wide = self.rows.where(F.col("part").isin(names)).groupBy("chain", "iter").pivot("part", names).agg(F.first("v"))
        if self.config.directed:
            return wide.withColumnRenamed("b0", "b_in").withColumnRenamed("b1", "b_out")
        return wide.withColumn("b_in", F.col("b0")).withColumn("b_out", F.lit(None).cast("double")).drop("b0", "b1")

    def positions(self) -> DataFrame:
        return self.rows.where("part = 'position'").select("chain", "iter", "t", "node", "x")

    def labels(self) -> DataFrame:
        return self.rows.where("part = 'label'").select("chain", "iter", "t", "node", "z")

    def clusters(self) -> DataFrame:
        return self.rows.where("part = 'cluster'").select("chain", "iter", "k", F.col("x").alias("mu"), F.col("v").alias("sigma"))

    def transitions(self) -> DataFrame:
        return self.rows.where("part = 'trans'").select("chain", "iter", "t", F.col("k").alias("k_from"), "k_to", F.col("v").alias("w"))

    def initial(self) -> DataFrame:
        return self.rows.where("part = 'init'").select("chain", "iter", "k", F.col("v").alias("w"))

    def radii(self) -> DataFrame:
        return self.rows.where("part = 'radius'").select("chain", "iter", "node", F.col("v").alias("r"))

    def missing_probabilities(self) -> DataFrame:
        """t, src, dst, y: posterior means of missing dyads."""
        drawn = self.rows.where("part = 'missing'").select("t", F.col("node").alias("src"), F.col("k_to").alias("dst"), F.col("z").alias("y"))
        return posterior.missing_means(drawn)

    def select(self, by: str = "map") -> tuple[int, int]:
        """(chain, iter) of the selected sample: by "map" or, for mixtures, within the first chain by "bic", "vi" or "mode",
        the sample of the highest logp among those with the commonest number of groups.
        """
        if by == "map":
            best = self.scalars().orderBy(F.desc("logp"), "chain", "iter").first()
            return best["chain"], best["iter"]
        first = F.col("chain") == 0
        labels, logp = self.labels().where(first).drop("chain"), self.scalars().where(first).select("iter", "logp")
        if by == "vi":
            found = posterior.select_min_vi(labels, posterior.cooccurrence(labels), logp.withColumnRenamed("logp", "loglik")).first()
            return 0, found["iter"]
        if by == "bic":
            return 0, self.bic_table().orderBy("bic").first()["iter"]
        if by == "mode":
            chosen = posterior.map_per_k(labels, logp).join(posterior.best_k(labels), "n_groups")
            return 0, chosen.first()["iter"]
        raise ValueError(by)

    def set_best_model(self, by: str = "map") -> Fit:
        """Makes the sample selected so the one that probabilities, auc and the forecasts from one sample take."""
        self.best = self.select(by)
        return self

    def chosen(self) -> tuple[int, int]:
        """The sample of set_best_model, else the MAP one."""
        return self.best or self.select()

    def bic_table(self) -> DataFrame:
        """A row for each number of groups seen by the first chain: its best sample and BIC."""
        first = F.col("chain") == 0
        labels = self.labels().where(first).drop("chain")
        chosen = posterior.map_per_k(labels, self.scalars().where(first))
        n, steps, p = self.nodes.count(), self.steps.count(), self.config.p
        latent, network = [], []
        for r in chosen.collect():  # a row for each number of groups, at most n_components
            at = (0, r["iter"])
            trans, clusters = self._at(self.transitions(), at), self._at(self.clusters(), at)
            lam = self._at(self.scalars(), at).first()["lambda"]
            total = posterior.forward_loglik(self._at(self.positions(), at).select("t", "node", "x"), self._at(self.initial(), at), trans.select("t", "k_from", "k_to", "w"), clusters, lam, p)
            latent.append((r["iter"], total.agg(F.sum("loglik")).first()[0]))
            network.append((r["iter"], self.loglik(at)))
        make = lambda rows: self.rows.sparkSession.createDataFrame(rows, "iter int, loglik double")
        edges = self.edges.select("t", F.least("src", "dst"), F.greatest("src", "dst")).distinct().count() if not self.config.directed else self.edges.count()
        return posterior.bic(chosen, make(network), make(latent), max(edges, 1), n, steps, p, self.config.directed)

    def _at(self, df: DataFrame, at: tuple[int, int]) -> DataFrame:
        return df.where((F.col("chain") == at[0]) & (F.col("iter") == at[1])).drop("chain", "iter")

    def _pairs(self, at: tuple[int, int]) -> tuple[DataFrame, object]:
        from ..operators import likelihood

        s = self._at(self.scalars(), at).first()
        radii = self._at(self.radii(), at) if self.config.directed else None
        pairs = likelihood.dyads(self._at(self.positions(), at), self.edges, self.config.directed, radii, self.missing)
        eta = likelihood.eta_directed(s["b_in"], s["b_out"]) if self.config.directed else likelihood.eta_undirected(s["b_in"])
        return pairs, eta

    def loglik(self, at: tuple[int, int]) -> float:
        from ..operators import likelihood

        pairs, eta = self._pairs(at)
        return likelihood.loglikelihood(pairs, eta).first()["loglik"]

    def probabilities(self, at: tuple[int, int] | None = None) -> DataFrame:
        """t, src, dst, d, y, p at a sample, the chosen one unless another is named; y is null where the dyad is missing."""
        pairs, eta = self._pairs(at or self.chosen())
        return pairs.withColumn("p", expit(eta)).select("t", "src", "dst", "d", "y", "p")

    def auc(self, at: tuple[int, int] | None = None) -> float:
        return metrics.auc(self.probabilities(at)).first()["auc"]

    def cooccurrence(self, chain: int = 0) -> DataFrame:
        return posterior.cooccurrence(self.labels().where(F.col("chain") == chain).drop("chain"))

    def merges(self, t: int, chain: int = 0) -> DataFrame:
        """The average-linkage dendrogram of a step's cooccurrence as a table of merges."""
        from ..operators import linkage

        return linkage.average_linkage(self._members(t), self.cooccurrence(chain).where(F.col("t") == t))

    def linkage(self, t: int, threshold: float = 0.5, chain: int = 0) -> DataFrame:
        """node, z: average linkage of a step's cooccurrence, cut at a height."""
        from ..operators import linkage

        return linkage.flat_clusters(self._members(t), self.merges(t, chain), threshold).select("node", "z")

    def leaf_order(self, t: int, chain: int = 0) -> DataFrame:
        """node, place: the order of a step's nodes in the dendrogram."""
        from ..operators import linkage

        return linkage.leaf_order(self._members(t), self.merges(t, chain)).select("node", "place")

    def _members(self, t: int) -> DataFrame:
        return self.nodes.select(F.lit(t).alias("t"), "node")

    def forecast(self, kind: str = "map", n_samples: int = 5000, renormalise: bool = False) -> DataFrame:
        """i, j, p of the step after the last, for undirected mixtures: "map", "plugin", "marginal", "monte_carlo" or
        "posterior_predictive", a draw from every sample. "map" and "monte_carlo" take one sample, set_best_model's or the
        first chain's MAP one; the others those of the first chain. renormalise keeps to the groups with nodes at the last step.
        """
        from ..operators import forecast

        end = self.steps.agg(F.max("t")).first()[0]
        chain = self.best[0] if self.best and kind in ("map", "monte_carlo") else 0
        scalars = self.scalars().where(F.col("chain") == chain).select("iter", "lambda", "b_in")
        last = (
            self.positions().where((F.col("chain") == chain) & (F.col("t") == end)).join(self.labels(), ["chain", "iter", "t", "node"])
            .join(scalars, "iter").select("iter", "node", "x", "z", F.col("lambda").alias("lmbda"))
        )
        trans = self.transitions().where((F.col("chain") == chain) & (F.col("t") == end)).select("iter", "k_from", "k_to", "w")
        if renormalise:
            trans = forecast.among_active(last, trans, ["iter"])
        clusters = self.clusters().where(F.col("chain") == chain).drop("chain")
        if kind in ("map", "monte_carlo"):
            own = self.scalars().where(F.col("chain") == chain)
            at = (own.where(F.col("iter") == self.best[1]) if self.best else own.orderBy(F.desc("logp"), "iter")).first()
            one = lambda df: df.where(F.col("iter") == at["iter"]).drop("iter")
            if kind == "map":
                return forecast.plug_in(forecast.next_positions(one(last), one(trans), one(clusters)), at["b_in"])
            return forecast.monte_carlo(one(last), one(trans), one(clusters), at["b_in"], n_samples)
        if kind == "posterior_predictive":
            return forecast.posterior_predictive(last, trans, clusters, scalars.select("iter", F.col("b_in").alias("b")))
        target = forecast.mean_positions(forecast.next_positions(last, trans, clusters, ["iter"]))
        if kind == "plugin":
            return forecast.plug_in(target, scalars.agg(F.avg("b_in")).first()[0])
        return forecast.marginal(target, last, trans, clusters, scalars.select("iter", F.col("b_in").alias("b")), self.config.p)

    def delete_traces(self) -> None:
        """Deletes the table of samples; what was read off them before and isn't stored elsewhere is lost too."""
        removed(self.rows, f"samples-{self.config.kind}")
        self.rows = self.rows.sparkSession.createDataFrame([], self.rows.schema)


class Estimator:
    """chains of one model on one network (edges t, src, dst with nodes numbered from 0)."""

    kind = "hdp"

    def __init__(self, spark: SparkSession, chains: int = 1, seed: int = 123, **config):
        self.spark, self.chains, self.seed = spark, chains, seed
        self.config = replace(Config(kind=self.kind), **config)

    def jobs(self, edges: DataFrame, n: int, steps: int, missing: DataFrame | None = None, run_id: str = "run") -> DataFrame:
        rows = lambda df: df.select(F.struct(F.col("t").cast("int").alias("t"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).alias("e")).agg(F.sort_array(F.collect_list("e")).alias("e"))
        empty = edges.select("t", "src", "dst").limit(0)
        packed = rows(edges).withColumnRenamed("e", "edges").join(rows(missing if missing is not None else empty).withColumnRenamed("e", "missing"), how="cross")  # single rows
        chains = self.spark.range(self.chains).select(F.lit(run_id).alias("run_id"), F.col("id").cast("int").alias("chain"), F.lit(self.seed).alias("seed"))
        return chains.join(packed, how="cross").select("*", F.lit(n).alias("n"), F.lit(steps).alias("steps"), _config_column(self.config).alias("config")).repartition(self.chains, "chain")

    def fit(self, edges: DataFrame, nodes: DataFrame, steps: DataFrame, missing: DataFrame | None = None, run_id: str = "run") -> Fit:
        """nodes: node (0 to n-1); steps: t (0 to T-1), also those without an edge."""
        rows = written(sample(self.jobs(edges, nodes.count(), steps.count(), missing, run_id)), f"samples-{self.kind}")
        return Fit(rows, edges, missing, nodes, steps, self.config)


class LSM(Estimator):
    kind = "lsm"


class LPCM(Estimator):
    kind = "lpcm"


class HDPLPCM(Estimator):
    kind = "hdp"
