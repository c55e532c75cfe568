"""Every registered query of the library, with the SQL that gives the same rows.

A query's columns are listed once (name:i for integers, name:d for doubles rounded to six places, name:s for strings)
and shape both sides. The SQL builds the views of sources.views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.scalar import dirichlet_logpdf, distance, expit, multivariate_t_logpdf
from .operators import diagnostics, forecast, likelihood, metrics, missing, network, posterior
from .sources.views import Tables

QUERIES: dict = {}
SQL: dict = {}

#: Model constants of the likelihood and posterior queries.
B0, B_IN, B_OUT, LAMBDA, TAU_SQ, SIGMA_SQ = 1.0, 1.0, 0.5, 0.7, 2.0, 0.1

VIEWS = {
    "trades": """SELECT year(o_orderdate)::INT AS t, c_nationkey AS src, s_nationkey AS dst, o_totalprice AS value, l_quantity AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "cells": "SELECT t, src, dst, count(*) AS w FROM trades GROUP BY t, src, dst",
    "net": "SELECT t, src, dst, w FROM (SELECT *, avg(w) OVER (PARTITION BY t) AS m FROM cells) WHERE w > m AND src <> dst",
    "nodes": "SELECT n_nationkey AS node, n_name AS name, n_regionkey AS z FROM nation",
    "twoway": "SELECT DISTINCT t, src, dst FROM (SELECT t, src, dst FROM net UNION ALL SELECT t, dst, src FROM net)",
    "und": "SELECT DISTINCT t, least(src, dst) AS src, greatest(src, dst) AS dst FROM net",
    "sboth": "SELECT DISTINCT t, src, dst FROM (SELECT t, src, dst FROM net UNION ALL SELECT t, dst, src FROM net)",
    "dlab": """SELECT t, node, ntile(4) OVER (PARTITION BY t ORDER BY volume, node) - 1 AS z
        FROM (SELECT t, src AS node, count(*) AS volume FROM trades GROUP BY t, src)""",
    "pos": """SELECT t, node, coalesce((v - avg(v) OVER y) / nullif(stddev_pop(v) OVER y, 0), 0) AS x0, coalesce((q - avg(q) OVER y) / nullif(stddev_pop(q) OVER y, 0), 0) AS x1
        FROM (SELECT t, src AS node, avg(value) AS v, avg(quantity) AS q FROM trades GROUP BY t, src) WINDOW y AS (PARTITION BY t)""",
    "steps": "SELECT *, lag(x0) OVER n AS b0, lag(x1) OVER n AS b1 FROM pos WINDOW n AS (PARTITION BY node ORDER BY t)",
    "ends": "SELECT src AS node FROM net UNION ALL SELECT dst FROM net",
    "rad": """SELECT node, CASE WHEN lonely THEN (r + 1e-5) / (1 + 1e-5 * total) ELSE r END AS r FROM (
        SELECT node, n::DOUBLE / sum(n) OVER () AS r, min(n) OVER () = 0 AS lonely, count(*) OVER () AS total
        FROM (SELECT nodes.node, count(ends.node) AS n FROM nodes LEFT JOIN ends ON nodes.node = ends.node GROUP BY nodes.node))""",
    "dist": "SELECT a.t, a.node AS src, b.node AS dst, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2) AS d FROM pos a JOIN pos b ON a.t = b.t AND a.node < b.node",
    "ddist": "SELECT a.t, a.node AS src, b.node AS dst, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2) AS d FROM pos a JOIN pos b ON a.t = b.t AND a.node <> b.node",
    "dyads": "SELECT dist.*, (und.src IS NOT NULL)::INT AS y, 1.0::DOUBLE - d AS eta FROM dist LEFT JOIN und USING (t, src, dst)",
    "ddyads": """SELECT ddist.*, (net.src IS NOT NULL)::INT AS y, i.r AS r_src, j.r AS r_dst, (1 - d / j.r) + 0.5::DOUBLE * (1 - d / i.r) AS eta
        FROM ddist LEFT JOIN net USING (t, src, dst) JOIN rad i ON i.node = ddist.src JOIN rad j ON j.node = ddist.dst""",
    "clusters": """SELECT k, m0, m1, greatest(avg(((x0 - m0) ** 2 + (x1 - m1) ** 2) / 2), 0.01::DOUBLE) AS sigma FROM (
        SELECT dlab.z AS k, x0, x1, avg(x0) OVER (PARTITION BY dlab.z) AS m0, avg(x1) OVER (PARTITION BY dlab.z) AS m1 FROM pos JOIN dlab USING (t, node)) GROUP BY k, m0, m1""",
    "moves": "SELECT t, z0, z1, count(*) AS n FROM (SELECT t, z AS z1, lag(z) OVER (PARTITION BY node ORDER BY t) AS z0 FROM dlab) WHERE z0 IS NOT NULL GROUP BY t, z0, z1",
    "ks": "SELECT range AS k FROM range(4)",
    "trans": """SELECT a.k AS k_from, b.k AS k_to, (1 + coalesce(n, 0))::DOUBLE / sum(1 + coalesce(n, 0)) OVER (PARTITION BY a.k) AS w
        FROM ks a CROSS JOIN ks b LEFT JOIN (SELECT z0, z1, sum(n) AS n FROM moves GROUP BY z0, z1) ON z0 = a.k AND z1 = b.k""",
    "final": "SELECT node, x0, x1, z FROM pos JOIN dlab USING (t, node) WHERE t = (SELECT max(t) FROM pos)",
    "draws": "SELECT range AS iter, 0.5::DOUBLE + 0.1::DOUBLE * range AS lam, 1 + 0.1::DOUBLE * range AS b, 0.05::DOUBLE * range AS shift FROM range(3)",
    "ahead": """SELECT iter, f.node, f.x0, f.x1, f.z, lam, b, w, lam * (m0 + shift) + (1 - lam) * f.x0 AS y0, lam * (m1 + shift) + (1 - lam) * f.x1 AS y1, sigma * (1 + shift) AS sigma
        FROM final f JOIN trans ON k_from = f.z JOIN clusters ON k = k_to CROSS JOIN draws""",
    "next": "SELECT iter, node, sum(w * y0) AS x0, sum(w * y1) AS x1 FROM ahead GROUP BY iter, node",
    "mean_next": "SELECT node, avg(x0) AS x0, avg(x1) AS x1 FROM next GROUP BY node",
    "evs": "SELECT day(ts) AS iter, hour(ts) // 12 AS t, user_id % 25 AS node, event_type FROM events",
    "smp": """SELECT iter, t, node, z FROM (SELECT *, row_number() OVER (PARTITION BY iter, t, node ORDER BY n DESC, event_type) AS place
        FROM (SELECT iter, t, node, event_type, count(*) AS n FROM evs GROUP BY ALL)) JOIN
        (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS z FROM (SELECT DISTINCT event_type FROM evs)) USING (event_type) WHERE place = 1""",
    "cooc": """SELECT t, i, j, c::DOUBLE / s AS p FROM (SELECT a.t, a.node AS i, b.node AS j, count(*) AS c FROM smp a JOIN smp b
        ON a.iter = b.iter AND a.t = b.t AND a.z = b.z AND a.node <= b.node GROUP BY a.t, a.node, b.node) JOIN (SELECT t, count(DISTINCT iter) AS s FROM smp GROUP BY t) USING (t)""",
    "evi": """SELECT iter, t, avg(log2(m) - 2 * log2(within) + log2(overall)) AS vi FROM (
        SELECT o.iter, o.t, o.node, max(sz.m)::DOUBLE AS m, sum(c.p) AS within, max(r.overall) AS overall FROM smp o
        JOIN smp q ON q.iter = o.iter AND q.t = o.t AND q.z = o.z JOIN cboth c ON c.t = o.t AND c.i = o.node AND c.j = q.node
        JOIN (SELECT t, i, sum(p) AS overall FROM cboth GROUP BY t, i) r ON r.t = o.t AND r.i = o.node
        JOIN (SELECT iter, t, z, count(*) AS m FROM smp GROUP BY ALL) sz ON sz.iter = o.iter AND sz.t = o.t AND sz.z = o.z
        GROUP BY o.iter, o.t, o.node) GROUP BY iter, t""",
    "cboth": "SELECT * FROM cooc UNION ALL SELECT t, j, i, p FROM cooc WHERE i <> j",
    "logp": "SELECT iter, sum(value) AS logp FROM (SELECT day(ts) AS iter, value FROM events) GROUP BY iter",
    "counts": "SELECT iter, count(DISTINCT z) AS n_groups FROM smp GROUP BY iter",
    "lagged": "SELECT event_id AS iter, value - (SELECT avg(value) FROM events) AS x FROM events",
    "auto": "SELECT lag, sum(a.x * b.x) AS ss FROM (SELECT range AS lag FROM range(21)) CROSS JOIN lagged a JOIN lagged b ON b.iter = a.iter - lag GROUP BY lag",
    "emb": "SELECT vec_id AS node, label AS z, embedding::DOUBLE[] AS x FROM embeddings",
}
NEEDS = {
    "cells": "trades", "net": "cells", "twoway": "net", "und": "net", "sboth": "net", "dlab": "trades", "pos": "trades", "steps": "pos", "ends": "net",
    "rad": "ends nodes", "dist": "pos", "ddist": "pos", "dyads": "dist und", "ddyads": "ddist net rad", "clusters": "pos dlab", "moves": "dlab", "trans": "ks moves", "final": "pos dlab",
    "ahead": "final trans clusters draws", "next": "ahead", "mean_next": "next", "smp": "evs", "cooc": "smp", "cboth": "cooc", "evi": "cboth smp", "counts": "smp", "auto": "lagged",
}


def _with(views: str, body: str) -> str:
    order: list[str] = []

    def add(name: str):
        for need in NEEDS.get(name, "").split():
            add(need)
        if name not in order:
            order.append(name)

    for name in views.split():
        add(name)
    made = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if not made:
        return body
    return f"WITH RECURSIVE {made} {body}" if not body.startswith(",") else f"WITH RECURSIVE {made}{body}"


def query(columns: str, views: str, body: str | None):
    """Registers a function of Tables under its name, with its columns and its SQL."""
    kinds = [c.split(":") for c in columns.split()]

    def register(f):
        def run(spark, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            cast = {"i": lambda c: F.col(c).cast("long"), "d": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0), "s": F.col}
            return df.select(*[cast[k](c).alias(c) for c, k in kinds])

        name = f.__name__.strip("_")
        QUERIES[name] = run
        if body is not None:
            shaped = {"i": "{0}::BIGINT AS {0}", "d": "round({0}::DOUBLE, 6) + 0.0::DOUBLE AS {0}", "s": "{0}"}
            SQL[name] = f"SELECT {', '.join(shaped[k].format(c) for c, k in kinds)} FROM ({_with(views, body)})"
        return f

    return register


# Shape and statistics of networks.


@query("src:i dst:i season:i weight:i", "cells", "SELECT src, dst, t AS season, sum(w) AS weight FROM cells GROUP BY src, dst, t")
def edges_agg(c):
    return network.aggregated(c.trades().select("src", "dst", F.col("t").alias("season"), F.lit(1).alias("weight")), ["src", "dst", "season"])


@query("src:i dst:i season:i weight:i", "cells", "SELECT src, dst, t AS season, w AS weight FROM cells WHERE t IN (1995, 1996, 1997) AND w >= 10")
def edges_filtered(c):
    return edges_agg(c).where("season IN (1995, 1996, 1997) AND weight >= 10")


@query("t:i src:i dst:i", "twoway", "SELECT * FROM twoway")
def edges_symmetrised(c):
    return network.symmetrised(c.net())


@query("t:i src:i dst:i", "cells", "SELECT t, src, dst FROM cells WHERE w > 2")
def edges_binarised(c):
    return network.binarised(c.cells(), above=2)


@query("t:i n_upper:i n_diagonal:i n_off:i", "cells", "SELECT t, sum((dst - src >= 1)::INT) AS n_upper, sum((src = dst)::INT) AS n_diagonal, sum((src <> dst)::INT) AS n_off FROM cells GROUP BY t")
def index_selectors(c):
    n = lambda p: F.sum(p.cast("int"))
    return c.cells().groupBy("t").agg(n(network.upper()).alias("n_upper"), n(network.diagonal()).alias("n_diagonal"), n(network.off_diagonal()).alias("n_off"))


@query("name:s node:i", "", "SELECT n_name AS name, dense_rank() OVER (ORDER BY n_name) - 1 AS node FROM nation")
def label_encode(c):
    return network.encoded(c.nodes(), "name")


@query("start:s event_type:s n:i users:i", "", """SELECT strftime(time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def window_snapshot(c):
    snaps = network.window_snapshots(c.table("events"), "5 days")
    return snaps.groupBy(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("period:i src:i dst:i w:i", "cells", "SELECT (t - 1995) // 5 AS period, src, dst, sum(w) AS w FROM cells GROUP BY ALL")
def period_snapshot(c):
    return c.cells().groupBy(F.expr("(t - 1995) DIV 5").alias("period"), "src", "dst").agg(F.sum("w").alias("w"))


@query("t:i node:i n_in:i n_out:i", "net", "SELECT t, node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT t, dst AS node, 1 AS i, 0 AS o FROM net UNION ALL SELECT t, src, 0, 1 FROM net) GROUP BY t, node")
def degree_in_out(c):
    return network.degrees(c.net())


@query("t:i max_in:i max_out:i", "net", """SELECT t, max(i) AS max_in, max(o) AS max_out FROM (SELECT t, node, sum(i) AS i, sum(o) AS o FROM
 (SELECT t, dst AS node, 1 AS i, 0 AS o FROM net UNION ALL SELECT t, src, 0, 1 FROM net) GROUP BY t, node) GROUP BY t""")
def max_degree(c):
    return network.max_degrees(c.net())


@query("t:i node:i neighbours:s", "net", "SELECT t, src AS node, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM net GROUP BY t, src")
def neighbours(c):
    return network.neighbours(c.net()).withColumn("neighbours", F.concat_ws(",", F.transform("neighbours", lambda v: v.cast("string"))))


@query("n_directed:i n_undirected:i", "net und", "SELECT (SELECT count(*) FROM net) AS n_directed, (SELECT count(*) FROM und) AS n_undirected")
def num_edges(c):
    a, b = network.num_edges(c.net(), True), network.num_edges(c.net(), False)
    return a.withColumnRenamed("n_edges", "n_directed").join(b.withColumnRenamed("n_edges", "n_undirected"), how="cross")


@query("t:i density:d", "net", "SELECT t, count(*) / (25.0::DOUBLE * 24) AS density FROM net GROUP BY t")
def density_by_t(c):
    return network.density_by_step(c.net(), 25)


@query("density:d", "und", "SELECT count(*) / (7.0::DOUBLE * 25 * 24 / 2) AS density FROM und")
def density_pooled(c):
    return network.density(c.net(), 25, 7, directed=False)


MODULARITY = """, lz AS (SELECT t, node, z FROM {labels}), inside AS (
  SELECT e.t, sum((a.z = b.z)::INT)::DOUBLE AS inside, count(*)::DOUBLE AS m FROM {edges} e JOIN lz a ON a.node = e.src AND a.t = e.t JOIN lz b ON b.node = e.dst AND b.t = e.t GROUP BY e.t),
d AS (SELECT e.t, z, sum(h)::DOUBLE / 2 AS d FROM (SELECT t, src AS node, 1 AS h FROM {edges} UNION ALL SELECT t, dst, 1 FROM {edges}) e JOIN lz ON lz.node = e.node AND lz.t = e.t GROUP BY e.t, z),
q AS (SELECT t, inside / (m * {f}) - dd / (m * {f}) ** 2 AS modularity FROM inside JOIN (SELECT t, sum(d * d) AS dd FROM d GROUP BY t) USING (t)) SELECT {out} FROM q"""
STATIC = "(SELECT DISTINCT net.t, nodes.node, nodes.z FROM net CROSS JOIN nodes)"


@query("t:i modularity:d", "twoway nodes", MODULARITY.format(labels=STATIC, edges="twoway", f=1, out="*"))
def modularity_static(c):
    return network.modularity(c.net(), c.labels())


@query("modularity:d", "twoway dlab", MODULARITY.format(labels="dlab", edges="twoway", f=1, out="avg(modularity) AS modularity"))
def modularity_dynamic(c):
    return network.modularity_mean(c.net(), c.dynamic_labels())


@query("t:i modularity:d", "net nodes", MODULARITY.format(labels=STATIC, edges="net", f=2, out="*"))
def modularity_directed(c):
    return network.modularity(c.net(), c.labels(), directed=True)


@query("t:i modularity:d", "net nodes", MODULARITY.format(labels=STATIC, edges="net", f=1, out="*"))
def modularity_directed_textbook(c):
    return network.modularity(c.net(), c.labels(), directed=True, textbook=True)


REACH = ", reach AS (SELECT DISTINCT s.t, n.node AS a, n.node AS b FROM sboth s CROSS JOIN nodes n UNION SELECT r.t, r.a, e.dst FROM reach r JOIN sboth e ON e.t = r.t AND e.src = r.b)"
COMPONENT = REACH + ", comp AS (SELECT t, a AS node, min(b) AS component FROM reach GROUP BY t, a)"


@query("t:i node:i component:i", "sboth nodes", COMPONENT + " SELECT * FROM comp")
def components(c):
    return network.components(c.net(), c.nodes())


@query("t:i node:i", "sboth nodes", COMPONENT + " SELECT t, node FROM comp JOIN (SELECT t, component FROM comp GROUP BY t, component HAVING count(*) > 2) USING (t, component)")
def connected_nodes(c):
    return network.connected_nodes(c.net(), c.nodes(), 2)


def _peels(rounds: int) -> str:
    """Rounds of peeling, unrolled; 25 nodes need 25 at most."""
    out = ", c0 AS (SELECT * FROM sboth)"
    for k in range(rounds):
        alive = f"(SELECT t, src AS node FROM c{k} GROUP BY t, src HAVING count(*) >= 3)"
        out += f", c{k + 1} AS (SELECT e.* FROM c{k} e SEMI JOIN {alive} a ON a.t = e.t AND a.node = e.src SEMI JOIN {alive} b ON b.t = e.t AND b.node = e.dst)"
    return out.replace(" AS (", " AS MATERIALIZED (") + f" SELECT * FROM c{rounds} WHERE src < dst"


@query("t:i src:i dst:i", "sboth", _peels(25))
def kcore3(c):
    return network.k_core(c.net(), 3)


PATHS = """, walk AS (SELECT DISTINCT s.t, n.node AS a, n.node AS b, 0 AS d FROM sboth s CROSS JOIN nodes n
 UNION SELECT w.t, w.a, e.dst, w.d + 1 FROM walk w JOIN sboth e ON e.t = w.t AND e.src = w.b WHERE w.d < 25),
 short AS (SELECT t, a, b, min(d) AS d FROM walk GROUP BY t, a, b)
{0} SELECT p.t, p.a AS src, p.b AS dst, coalesce(d, far) AS d FROM (SELECT DISTINCT s.t, i.node AS a, j.node AS b FROM sboth s CROSS JOIN nodes i CROSS JOIN nodes j) p
 LEFT JOIN short USING (t, a, b) JOIN (SELECT t, max(d) + 1 AS far FROM short GROUP BY t) USING (t)"""


@query("t:i src:i dst:i d:i", "sboth nodes", PATHS.format(""))
def sp_dissimilarity(c):
    return network.shortest_paths(c.net(), c.nodes())


@query("node:i r:d", "rad", "SELECT * FROM rad")
def radii_init(c):
    return network.initial_radii(c.net(), c.nodes())


# Distances, probabilities and likelihoods.


@query("t:i src:i dst:i d:d", "dist", "SELECT * FROM dist")
def pairwise_dist(c):
    return likelihood.distances(c.positions())


@query("t:i src:i dst:i d:d", "dist", "SELECT t, src, dst, d * d AS d FROM dist")
def pairwise_dist_sq(c):
    return likelihood.distances(c.positions(), squared=True)


@query("node:i k:i d:d", "emb", """, centre AS (SELECT z AS k, list(v ORDER BY dim) AS mu FROM (SELECT z, dim, avg(v) AS v FROM (SELECT z, unnest(x) AS v, unnest(range(len(x))) AS dim FROM emb) GROUP BY z, dim) GROUP BY z)
 SELECT node, k, list_distance(x, mu) AS d FROM emb CROSS JOIN centre""")
def emb_dist(c):
    emb = c.embeddings()
    dims = emb.select("z", F.posexplode("x").alias("dim", "v")).groupBy("z", "dim").agg(F.avg("v").alias("v"))
    centres = dims.groupBy(F.col("z").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("mu"))
    return emb.join(F.broadcast(centres), how="cross").select("node", "k", distance("x", "mu").alias("d"))  # a row for each of ten classes


@query("t:i node:i ss:d", "steps", "SELECT t, node, (x0 - b0) ** 2 + (x1 - b1) ** 2 AS ss FROM steps")
def lag_displacement(c):
    return likelihood.displacements(c.positions())


@query("t:i src:i dst:i p:d", "dyads", "SELECT t, src, dst, 1 / (1 + exp(-eta)) AS p FROM dyads")
def prob_undirected(c):
    return likelihood.probabilities(likelihood.distances(c.positions()), likelihood.eta_undirected(B0))


def _pairs(c, directed=False):
    return likelihood.dyads(c.positions(), c.net(), directed, network.initial_radii(c.net(), c.nodes()) if directed else None)


@query("t:i src:i dst:i p:d", "ddyads", "SELECT t, src, dst, 1 / (1 + exp(-eta)) AS p FROM ddyads")
def prob_directed(c):
    return likelihood.probabilities(_pairs(c, True), likelihood.eta_directed(B_IN, B_OUT))


TERM = "y * eta - (greatest(eta, 0) + ln(1 + exp(-abs(eta))))"


@query("t:i loglik:d", "dyads", f"SELECT t, sum({TERM}) AS loglik FROM dyads GROUP BY t")
def ll_undirected(c):
    return likelihood.loglikelihood(_pairs(c), likelihood.eta_undirected(B0), ["t"])


@query("t:i loglik:d", "ddyads", f"SELECT t, sum({TERM}) AS loglik FROM ddyads GROUP BY t")
def ll_directed(c):
    return likelihood.loglikelihood(_pairs(c, True), likelihood.eta_directed(B_IN, B_OUT), ["t"])


@query("t:i loglik:d", "dyads", f"SELECT t, sum({TERM}) AS loglik FROM dyads WHERE src = 3 OR dst = 3 GROUP BY t")
def ll_partial_node(c):
    return likelihood.partial_loglikelihood(_pairs(c), likelihood.eta_undirected(B0), 3)


@query("t:i loglik:d", "ddyads", f"SELECT t, sum({TERM}) AS loglik FROM ddyads WHERE src = 3 OR dst = 3 GROUP BY t")
def ll_partial_node_directed(c):
    return likelihood.partial_loglikelihood(_pairs(c, True), likelihood.eta_directed(B_IN, B_OUT), 3)


@query("iter:i loglik:d", "dist und", f"""SELECT iter, sum({TERM}) AS loglik FROM (SELECT s AS iter, 0.5::DOUBLE + 0.25::DOUBLE * s - d AS eta, (und.src IS NOT NULL)::INT AS y
 FROM dist LEFT JOIN und USING (t, src, dst) CROSS JOIN (SELECT range AS s FROM range(4))) GROUP BY iter""")
def ll_per_sample(c):
    pairs = _pairs(c).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return likelihood.loglikelihood(pairs, F.lit(0.5) + F.lit(0.25) * F.col("iter") - F.col("d"), ["iter"])


@query("grad:d", "dyads", "SELECT sum(y - 1 / (1 + exp(-eta))) AS grad FROM dyads")
def grad_undirected(c):
    return likelihood.intercept_gradient(_pairs(c), B0)


@query("grad:d", "dyads", "SELECT sum(-exp(0.25::DOUBLE) * d * (y - 1 / (1 + exp(-(1.0::DOUBLE - exp(0.25::DOUBLE) * d))))) AS grad FROM dyads")
def grad_scale(c):
    return likelihood.scale_gradient(_pairs(c), B0, 0.25)


@query("grad_in:d grad_out:d", "ddyads", "SELECT sum((1 - d / r_dst) * (y - 1 / (1 + exp(-eta)))) AS grad_in, sum((1 - d / r_src) * (y - 1 / (1 + exp(-eta)))) AS grad_out FROM ddyads")
def grad_directed(c):
    return likelihood.directed_gradient(_pairs(c, True), B_IN, B_OUT)


HASH = "(t * 7919 + src * 104729 + dst * 1299709) % 1000"


@query("t:i loglik:d", "ddyads", f"""SELECT t, sum(e + CASE WHEN m > 0 THEN n / m * cs ELSE 0 END) AS loglik FROM (SELECT t, src, sum(CASE WHEN y = 1 THEN v ELSE 0 END) AS e,
 sum(CASE WHEN y = 0 AND h < 400 THEN v ELSE 0 END) AS cs, sum((y = 0)::INT)::DOUBLE AS n, sum((y = 0 AND h < 400)::INT)::DOUBLE AS m
 FROM (SELECT *, {TERM} AS v, {HASH} AS h FROM ddyads) GROUP BY t, src) GROUP BY t""")
def ll_case_control(c):
    return likelihood.case_control_loglikelihood(_pairs(c, True), likelihood.eta_directed(B_IN, B_OUT), missing.arithmetic() < 400)


PICKED = "(src * 7 + t * 3 + k * 11) % 25"


def _controls(c, edges):
    return likelihood.drawn_controls(c.positions(), edges, 8, F.pmod(F.col("src") * 7 + F.col("t") * 3 + F.col("k") * 11, F.col("n")))


DRAWS = f"SELECT DISTINCT t, src, {PICKED} AS dst FROM (SELECT t, node AS src FROM pos) CROSS JOIN (SELECT range AS k FROM range(8)) WHERE src <> {PICKED}"


@query("t:i src:i dst:i", "net pos", f"SELECT * FROM ({DRAWS}) ANTI JOIN net USING (t, src, dst)")
def control_nodes(c):
    return _controls(c, c.net())


@query("t:i loglik:d", "ddyads", f"""SELECT t, sum(e + CASE WHEN m > 0 THEN n / m * cs ELSE 0 END) AS loglik FROM (SELECT t, src, sum(CASE WHEN y = 1 THEN v ELSE 0 END) AS e,
 sum(CASE WHEN y = 0 AND h THEN v ELSE 0 END) AS cs, sum((y = 0)::INT)::DOUBLE AS n, sum((y = 0 AND h)::INT)::DOUBLE AS m
 FROM (SELECT ddyads.*, {TERM} AS v, p.src IS NOT NULL AS h FROM ddyads LEFT JOIN ({DRAWS}) p USING (t, src, dst)) GROUP BY t, src) GROUP BY t""")
def ll_case_control_drawn(c):
    eta = likelihood.eta_directed(B_IN, B_OUT)
    return likelihood.sampled_loglikelihood(c.positions(), c.net(), _controls(c, c.net()), eta, network.initial_radii(c.net(), c.nodes()))


@query("t:i loglik:d", "dyads", f"""SELECT t, sum(y * eta) - 24 * avg(CASE WHEN p.dst IS NOT NULL THEN greatest(eta, 0) + ln(1 + exp(-abs(eta))) END) AS loglik
 FROM (SELECT t, CASE WHEN src = 3 THEN dst ELSE src END AS dst, y, eta FROM dyads WHERE src = 3 OR dst = 3) LEFT JOIN (SELECT t, dst FROM ({DRAWS}) WHERE src = 3) p USING (t, dst) GROUP BY t""")
def ll_partial_case_control(c):
    both = network.symmetrised(c.net())
    return likelihood.sampled_partial_loglikelihood(c.positions(), both, _controls(c, both.limit(0)), likelihood.eta_undirected(B0), 3)


@query("t:i node:i ss:d", "pos", "SELECT t, node, (x0 - lead(x0) OVER n) ** 2 + (x1 - lead(x1) OVER n) ** 2 AS ss FROM pos WINDOW n AS (PARTITION BY node ORDER BY t)")
def lead_displacement(c):
    return likelihood.onward(c.positions())


@query("logprior:d", "steps", "SELECT -0.5::DOUBLE * sum(CASE WHEN b0 IS NULL THEN (x0 ** 2 + x1 ** 2) / 2.0::DOUBLE ELSE ((x0 - b0) ** 2 + (x1 - b1) ** 2) / 0.1::DOUBLE END) AS logprior FROM steps")
def prior_random_walk(c):
    return likelihood.random_walk_prior(c.positions(), TAU_SQ, SIGMA_SQ)


def clusters_of(c) -> DataFrame:
    """k, mu, sigma of the dynamic labels."""
    joined = c.positions().join(c.dynamic_labels(), ["t", "node"]).select(F.col("z").alias("k"), F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))
    own = W.partitionBy("k")
    centred = joined.withColumn("m0", F.avg("x0").over(own)).withColumn("m1", F.avg("x1").over(own))
    ss = (F.pow(F.col("x0") - F.col("m0"), 2) + F.pow(F.col("x1") - F.col("m1"), 2)) / F.lit(2.0)
    return centred.groupBy("k", "m0", "m1").agg(F.greatest(F.avg(ss), F.lit(0.01)).alias("sigma")).select("k", F.array("m0", "m1").alias("mu"), "sigma")


def trans_of(c) -> DataFrame:
    ks = c.spark.range(4).select(F.col("id").cast("int").alias("k"))
    n = metrics.transition_counts(c.dynamic_labels()).groupBy(F.col("z0").alias("k_from"), F.col("z1").alias("k_to")).agg(F.sum("n").alias("n"))
    grid = ks.withColumnRenamed("k", "k_from").join(ks.withColumnRenamed("k", "k_to"), how="cross")  # sixteen rows
    seen = grid.join(n, ["k_from", "k_to"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return seen.select("k_from", "k_to", (F.col("n") / (F.lit(1.0) * F.sum("n").over(W.partitionBy("k_from")))).alias("w"))


LOGPDF = "-ln(2 * pi() * sigma) - ((x0 - c0) ** 2 + (x1 - c1) ** 2) / (2 * sigma)"
BLEND = "CASE WHEN b0 IS NULL THEN m{0} ELSE 0.7::DOUBLE * m{0} + 0.3::DOUBLE * b{0} END AS c{0}"
EVERY = f"SELECT t, node, k, x0, x1, sigma, {BLEND.format(0)}, {BLEND.format(1)} FROM steps CROSS JOIN clusters"


@query("logprior:d", "steps dlab clusters", f"SELECT sum({LOGPDF}) AS logprior FROM ({EVERY}) JOIN dlab USING (t, node) WHERE z = k")
def prior_mixture(c):
    return likelihood.mixture_prior(c.positions(), c.dynamic_labels(), clusters_of(c), LAMBDA)


@query("t:i node:i k:i value:d", "steps clusters", f"SELECT t, node, k, {LOGPDF} AS value FROM ({EVERY})")
def gauss_lik(c):
    return likelihood.gaussian_likelihood(c.positions(), clusters_of(c), LAMBDA)


@query("t:i node:i k:i value:d", "steps clusters", f"""SELECT t, node, k, exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY t, node) AS value FROM (
 SELECT t, node, k, v, max(v) OVER (PARTITION BY t, node) AS mx FROM (SELECT *, {LOGPDF} AS v FROM ({EVERY})))""")
def gauss_lik_normalised(c):
    return likelihood.gaussian_likelihood(c.positions(), clusters_of(c), LAMBDA, normalised=True)


# Clusters and their conditionals.


@query("t:i z:i n:i s0:d s1:d", "pos dlab", "SELECT t, z, count(*) AS n, sum(x0) AS s0, sum(x1) AS s1 FROM pos JOIN dlab USING (t, node) GROUP BY t, z")
def cluster_suffstats(c):
    return posterior.cluster_statistics(c.positions(), c.dynamic_labels())


PULL = """, pull AS (SELECT z, x0, x1, b0, b1, m0, m1, sigma, CASE WHEN b0 IS NULL THEN 1 ELSE 0.7::DOUBLE END AS a, CASE WHEN b0 IS NULL THEN x0 ELSE x0 - 0.3::DOUBLE * b0 END AS r0,
 CASE WHEN b0 IS NULL THEN x1 ELSE x1 - 0.3::DOUBLE * b1 END AS r1 FROM steps JOIN dlab USING (t, node) JOIN clusters ON k = z)"""


@query("z:i variance:d m0:d m1:d", "steps dlab clusters", PULL + """ SELECT z, v AS variance, v * s0 AS m0, v * s1 AS m1 FROM (SELECT z, 1 / (1 / 4.0::DOUBLE + sum(a * a) / max(sigma)) AS v,
 sum(a * r0) / max(sigma) AS s0, sum(a * r1) / max(sigma) AS s1 FROM pull GROUP BY z)""")
def mu_posterior(c):
    return posterior.mu_posterior(c.positions(), c.dynamic_labels(), clusters_of(c), LAMBDA, 4.0)


@query("z:i shape:d scale:d", "steps dlab clusters", PULL + " SELECT z, 2 + count(*)::DOUBLE AS shape, 0.5::DOUBLE + sum((r0 - a * m0) ** 2 + (r1 - a * m1) ** 2) / 2 AS scale FROM pull GROUP BY z")
def sigma_posterior(c):
    return posterior.sigma_posterior(c.positions(), c.dynamic_labels(), clusters_of(c), LAMBDA, 4.0, 1.0)


@query("variance:d mean:d", "steps dlab clusters", PULL + """ SELECT v AS variance, v * (0.9::DOUBLE / 0.01::DOUBLE + uv) AS mean FROM (SELECT 1 / (1 / 0.01::DOUBLE + sum(((m0 - b0) ** 2 + (m1 - b1) ** 2) / sigma)) AS v,
 sum(((m0 - b0) * (x0 - b0) + (m1 - b1) * (x1 - b1)) / sigma) AS uv FROM pull WHERE b0 IS NOT NULL)""")
def lambda_posterior(c):
    return posterior.lambda_posterior(c.positions(), c.dynamic_labels(), clusters_of(c), 0.9, 0.01)


@query("t:i z0:i z1:i n:i", "moves", "SELECT * FROM moves")
def trans_counts(c):
    return metrics.transition_counts(c.dynamic_labels())


FREQS = "SELECT *, n / sum(n) OVER (PARTITION BY t, z0) AS frac_from, n / sum(n) OVER (PARTITION BY t, z1) AS frac_to FROM moves"


@query("t:i z0:i z1:i n:i frac_from:d frac_to:d", "moves", FREQS)
def transition_freqs(c):
    return metrics.transition_freqs(c.dynamic_labels())


@query("t:i z0:i z1:i n:i offset_from:i offset_to:i", "moves", """SELECT *, sum(n) OVER (PARTITION BY t ORDER BY z0, z1) - n AS offset_from,
 sum(n) OVER (PARTITION BY t ORDER BY z1, z0) - n AS offset_to FROM moves""")
def alluvial_flows(c):
    return metrics.alluvial_flows(c.dynamic_labels())


@query("t:i k_from:i k_to:i w:d", "trans moves", """SELECT t, k_from, k_to, w / sum(w) OVER (PARTITION BY t, k_from) AS w FROM trans CROSS JOIN (SELECT DISTINCT t FROM moves)
 WHERE k_from IN (0, 1, 3) AND k_to IN (0, 1, 3)""")
def renormalised_weights(c):
    steps = c.dynamic_labels().select("t").distinct()
    first = steps.agg(F.min("t").alias("t0"))
    later = steps.join(first, F.col("t") > F.col("t0")).select("t")
    timed = trans_of(c).join(later, how="cross")  # a row for each step and move
    return posterior.renormalised_weights(timed, c.spark.createDataFrame([(0,), (1,), (3,)], "k int"))


# Scores.


AUC = """SELECT {out} try_auc AS auc FROM (SELECT {by} (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)::DOUBLE AS try_auc
 FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER ({part2} p) - 1) / 2.0::DOUBLE AS rk FROM ({rows})) {group})"""


def _auc(rows: str, by: str = "") -> str:
    return AUC.format(out=f"{by}," if by else "", by=f"{by}," if by else "", part=f"PARTITION BY {by}" if by else "", part2=f"PARTITION BY {by + ',' if by else ''}", group=f"GROUP BY {by}" if by else "", rows=rows)


ROUNDED = "SELECT t, src, dst, y, round(1 / (1 + exp(-eta)), 9) AS p FROM dyads"


def _scored(c):
    return _pairs(c).select("t", "src", "dst", "y", F.round(expit(likelihood.eta_undirected(B0)), 9).alias("p"))


@query("t:i auc:d", "dyads", _auc(ROUNDED, "t"))
def auc_insample(c):
    return metrics.auc(_scored(c), ["t"])


@query("auc:d", "dyads", _auc(f"SELECT * FROM ({ROUNDED}) WHERE {HASH} >= 100"))
def auc_masked(c):
    return metrics.auc(_scored(c).withColumn("y", F.when(missing.arithmetic() >= 100, F.col("y"))))


@query("auc:d", "dyads", _auc(f"SELECT * FROM ({ROUNDED}) WHERE {HASH} < 200"))
def auc_heldout(c):
    test = _scored(c).where(missing.arithmetic() < 200).select("t", "src", "dst")
    return metrics.auc(_scored(c).join(test, ["t", "src", "dst"], "left_semi"))


LABELS2 = "SELECT t, dlab.node, nodes.z AS a, dlab.z AS b FROM dlab JOIN nodes ON nodes.node = dlab.node"


def _two(c):
    return c.dynamic_labels().withColumnRenamed("z", "b").join(c.labels().withColumnRenamed("z", "a"), "node")


def _vi(by: str = "") -> str:
    b, comma = (by, ",") if by else ("", "")
    return f"""SELECT {b}{comma} sum(n::DOUBLE / total * (ln(na) + ln(nb) - 2 * ln(n))) AS vi FROM (SELECT {b}{comma} n, sum(n) OVER (PARTITION BY {b}{comma} a) AS na, sum(n) OVER (PARTITION BY {b}{comma} b) AS nb,
 sum(n) OVER ({f'PARTITION BY {b}' if b else ''}) AS total FROM (SELECT {b}{comma} a, b, count(*) AS n FROM ({LABELS2}) GROUP BY {b}{comma} a, b)) {f'GROUP BY {b}' if b else ''}"""


def _ari(by: str = "") -> str:
    b, comma = (by, ",") if by else ("", "")
    g = f"GROUP BY {b}{comma}" if b else "GROUP BY"
    one = f"GROUP BY {b}" if b else ""
    join = f"JOIN {{}} USING ({b})" if b else "CROSS JOIN {}"
    side = lambda s: f"(SELECT {b}{comma} sum(m * (m - 1) / 2.0::DOUBLE) AS in_{s} FROM (SELECT {b}{comma} count(*) AS m FROM ({LABELS2}) {g} {s}) {one}) AS side_{s}"
    both = f"(SELECT {b}{comma} sum(n * (n - 1) / 2.0::DOUBLE) AS same, sum(n) * (sum(n) - 1) / 2.0::DOUBLE AS pairs FROM (SELECT {b}{comma} count(*) AS n FROM ({LABELS2}) {g} a, b) {one}) AS joint"
    return f"SELECT {b}{comma} coalesce((same - in_a * in_b / pairs) / nullif((in_a + in_b) / 2 - in_a * in_b / pairs, 0), 1) AS ari FROM {both} {join.format(side('a'))} {join.format(side('b'))}"


@query("vi:d", "dlab nodes", _vi())
def vi(c):
    return metrics.variation_of_information(_two(c))


@query("t:i vi:d", "dlab nodes", _vi("t"))
def vi_by_t(c):
    return metrics.variation_of_information(_two(c), by=["t"])


@query("ari:d", "dlab nodes", _ari())
def ari(c):
    return metrics.adjusted_rand(_two(c))


@query("t:i ari:d", "dlab nodes", _ari("t"))
def ari_by_t(c):
    return metrics.adjusted_rand(_two(c), by=["t"])


# Posterior summaries over the pseudo-posterior of events.


@query("t:i i:i j:i p:d", "cooc", "SELECT * FROM cooc")
def cooccurrence(c):
    return posterior.cooccurrence(c.samples())


@query("n_groups:i n:i", "counts", "SELECT n_groups, count(*) AS n FROM counts GROUP BY n_groups")
def posterior_counts(c):
    return posterior.group_counts(c.samples())


@query("t:i n_groups:i n:i", "smp", "SELECT t, n_groups, count(*) AS n FROM (SELECT iter, t, count(DISTINCT z) AS n_groups FROM smp GROUP BY iter, t) GROUP BY t, n_groups")
def group_counts_t(c):
    return posterior.group_counts(c.samples(), by_step=True)


@query("iter:i t:i vi:d", "evi", "SELECT * FROM evi")
def expected_vi(c):
    return posterior.expected_vi(c.samples(), posterior.cooccurrence(c.samples()))


@query("iter:i vi:d", "evi", "SELECT iter, vi FROM (SELECT iter, round(avg(vi), 9) AS vi FROM evi GROUP BY iter) ORDER BY vi, iter LIMIT 1")
def select_min_vi(c):
    return posterior.select_min_vi(c.samples(), posterior.cooccurrence(c.samples()))


def _logp(c):
    return c.table("events").groupBy(F.dayofmonth("ts").alias("iter")).agg(F.sum("value").alias("logp"))


BEST = "SELECT n_groups, iter, logp FROM (SELECT *, row_number() OVER (PARTITION BY n_groups ORDER BY logp DESC, iter) AS place FROM counts JOIN logp USING (iter)) WHERE place = 1"


@query("n_groups:i iter:i logp:d", "counts logp", BEST)
def map_per_k(c):
    return posterior.map_per_k(c.samples(), _logp(c))


@query("iter:i logp:d best_iter:i best:d", "logp", """SELECT l.iter, l.logp, arg_max(b.iter, (b.logp, -b.iter)) AS best_iter, max(b.logp) AS best FROM logp l JOIN logp b ON b.iter <= l.iter GROUP BY l.iter, l.logp""")
def running_map(c):
    return posterior.running_map(_logp(c))


@query("n_groups:i bic:d loglik:d iter:i", "counts logp und", f"""SELECT n_groups, -2 * logp + ln((SELECT count(*) FROM und)) - 2 * (logp / 2)
 + (3 * n_groups + 2 * (n_groups - 1) + 6 * n_groups * (n_groups - 1)) * ln(175) AS bic, logp AS loglik, iter FROM ({BEST})""")
def bic_table(c):
    n = network.num_edges(c.net(), False).first()["n_edges"]
    ll = _logp(c).select("iter", F.col("logp").alias("loglik"))
    return posterior.bic(posterior.map_per_k(c.samples(), _logp(c)), ll, ll.withColumn("loglik", F.col("loglik") / F.lit(2.0)), n, 25, 7)


@query("n_groups:i", "counts", "SELECT n_groups FROM (SELECT n_groups, count(*) AS n FROM counts GROUP BY n_groups) ORDER BY n DESC, n_groups LIMIT 1")
def best_k_mode(c):
    return posterior.best_k(c.samples())


@query("node:i loglik:d", "pos clusters trans", """, o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t) AS s FROM pos),
 f AS (SELECT node, s, k, 0.25::DOUBLE * exp(-((x0 - m0) ** 2 + (x1 - m1) ** 2) / (2 * sigma)) / (2 * pi() * sigma) AS a, x0, x1 FROM o CROSS JOIN clusters WHERE s = 1
 UNION ALL SELECT o.node, o.s, c.k, (sum(f.a * tr.w) OVER (PARTITION BY o.node, c.k)) * exp(-((o.x0 - 0.7::DOUBLE * m0 - 0.3::DOUBLE * f.x0) ** 2 + (o.x1 - 0.7::DOUBLE * m1 - 0.3::DOUBLE * f.x1) ** 2) / (2 * sigma)) / (2 * pi() * sigma), o.x0, o.x1
 FROM f JOIN o ON o.node = f.node AND o.s = f.s + 1 CROSS JOIN clusters c JOIN trans tr ON tr.k_from = f.k AND tr.k_to = c.k QUALIFY row_number() OVER (PARTITION BY o.node, c.k ORDER BY f.k) = 1)
 SELECT node, ln(sum(a)) AS loglik FROM f JOIN (SELECT node, max(s) AS s FROM o GROUP BY node) USING (node, s) GROUP BY node""")
def forward_loglik(c):
    init = c.spark.range(4).select(F.col("id").cast("int").alias("k"), F.lit(0.25).alias("w"))
    return posterior.forward_loglik(c.positions(), init, trans_of(c), clusters_of(c), LAMBDA)


@query("t:i node:i x0:d x1:d", "pos", "SELECT t, node, avg(x0 + 0.1::DOUBLE * s) AS x0, avg(x1 + 0.1::DOUBLE * s) AS x1 FROM pos CROSS JOIN (SELECT range AS s FROM range(5)) WHERE s >= 2 GROUP BY t, node")
def posterior_means(c):
    drawn = c.positions().withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("x", F.transform("x", lambda v: v + F.lit(0.1) * F.col("iter")))
    return posterior.posterior_means(posterior.retained(drawn, 2)).select("t", "node", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query("iter:i t:i node:i z:i", "smp", "SELECT * FROM smp WHERE iter >= 10 AND iter % 3 = 0")
def burn_thin_filter(c):
    return posterior.retained(c.samples(), 10, 3)


@query("iter:i t:i node:i z:i", "smp", "SELECT iter, t, node, dense_rank() OVER (ORDER BY z) - 1 AS z FROM smp WHERE z <> 1")
def relabelled(c):
    return posterior.relabelled(c.samples().where("z <> 1"))


@query("t:i src:i dst:i y:d", "dyads", f"SELECT t, src, dst, avg(((({HASH}) * (s + 1)) % 7 < 3)::INT) AS y FROM dyads CROSS JOIN (SELECT range AS s FROM range(6)) WHERE {HASH} < 100 AND s >= 2 GROUP BY t, src, dst")
def missing_means(c):
    draws = likelihood.distances(c.positions()).where(missing.arithmetic() < 100).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return posterior.missing_means(posterior.retained(draws.withColumn("y", ((missing.arithmetic() * (F.col("iter") + 1)) % 7 < 3).cast("int")), 2))


# Traces.


@query("lag:i rho:d", "auto", "SELECT lag, ss / (SELECT ss FROM auto WHERE lag = 0) AS rho FROM auto")
def acf(c):
    return diagnostics.acf(c.trace(), 20)


@query("ess:d", "auto", "SELECT (SELECT count(*) FROM events) / (1 + 2 * (SELECT sum(ss) FROM auto WHERE lag > 0) / (SELECT ss FROM auto WHERE lag = 0)) AS ess")
def ess(c):
    return diagnostics.ess(c.trace(), 20)


@query("mean_first:d mean_last:d", "", """SELECT avg(CASE WHEN k < floor(n * 0.1::DOUBLE) THEN value END) AS mean_first, avg(CASE WHEN k >= n - floor(n * 0.5::DOUBLE) THEN value END) AS mean_last
 FROM (SELECT value, event_id - min(event_id) OVER () AS k, count(*) OVER () AS n FROM events)""")
def geweke_means(c):
    return diagnostics.geweke_means(c.trace())


@query("event_type:s median:d sd:d", "", "SELECT event_type, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd FROM events GROUP BY event_type")
def metric_median_sd(c):
    return c.table("events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"), F.stddev_samp("value").alias("sd"))


@query("lo:d hi:d", "", "SELECT quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM events")
def quantile_ci(c):
    return c.table("events").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


@query("t:i k1:d k2:d k3:d k4:d k5:d more:d", "smp", """SELECT t, {}, sum((n_groups > 5)::INT)::DOUBLE / count(*) AS more FROM (SELECT iter, t, count(DISTINCT z) AS n_groups FROM smp GROUP BY iter, t) GROUP BY t""".format(", ".join(f"sum((n_groups = {k})::INT)::DOUBLE / count(*) AS k{k}" for k in range(1, 6))))
def posterior_prob_pivot(c):
    """The chances of one to five groups, and of more."""
    n = posterior.group_counts(c.samples(), by_step=True)
    share = lambda holds: F.sum(F.when(holds, F.col("n")).otherwise(0)) / (F.lit(1.0) * F.sum("n"))
    return n.groupBy("t").agg(*[share(F.col("n_groups") == k).alias(f"k{k}") for k in range(1, 6)], share(F.col("n_groups") > 5).alias("more"))


@query("t:i node:i name:s z:i place:i", "dlab nodes", "SELECT t, dlab.node, name, dlab.z, row_number() OVER (PARTITION BY t ORDER BY dlab.z, dlab.node) - 1 AS place FROM dlab JOIN nodes ON nodes.node = dlab.node")
def ordered_by_label(c):
    joined = c.dynamic_labels().join(c.nodes().select("node", "name"), "node")
    return joined.withColumn("place", F.row_number().over(W.partitionBy("t").orderBy("z", "node")) - 1)


# Forecasts. Samples are three shifted copies of the model.


def _model(c, samples: bool = False):
    last = c.positions().join(c.dynamic_labels(), ["t", "node"])
    end = c.sums().agg(F.max("t").alias("end"))
    last = last.join(F.broadcast(end), F.col("t") == F.col("end")).select("node", "x", "z")
    trans, clusters = trans_of(c), clusters_of(c)
    iters = F.explode(F.sequence(F.lit(0), F.lit(2)))
    shift = F.lit(0.05) * F.col("iter")
    last = last.withColumn("iter", iters).withColumn("lmbda", F.lit(0.5) + F.lit(0.1) * F.col("iter"))
    clusters = clusters.withColumn("iter", iters).select("iter", "k", F.transform("mu", lambda v: v + shift).alias("mu"), (F.col("sigma") * (F.lit(1.0) + shift)).alias("sigma"))
    intercepts = c.spark.range(3).select(F.col("id").cast("int").alias("iter"), (F.lit(1.0) + F.lit(0.1) * F.col("id")).alias("b"))
    return last, trans.withColumn("iter", iters), clusters, intercepts


DIST = "sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2)"


@query("i:i j:i p:d", "next", f"SELECT a.node AS i, b.node AS j, 1 / (1 + exp({DIST} - 1)) AS p FROM next a JOIN next b ON a.node < b.node AND a.iter = b.iter WHERE a.iter = 0")
def forecast_map(c):
    last, trans, clusters, _ = _model(c)
    first = lambda df: df.where("iter = 0").drop("iter")
    return forecast.plug_in(forecast.next_positions(first(last), first(trans), first(clusters)), 1.0)


@query("i:i j:i p:d", "mean_next", f"SELECT a.node AS i, b.node AS j, 1 / (1 + exp({DIST} - 1.1::DOUBLE)) AS p FROM mean_next a JOIN mean_next b ON a.node < b.node")
def forecast_plugin(c):
    last, trans, clusters, _ = _model(c)
    return forecast.plug_in(forecast.mean_positions(forecast.next_positions(last, trans, clusters, ["iter"])), 1.1)


@query("i:i j:i p:d", "ahead mean_next draws", f""", dens AS (SELECT h.iter, h.node, h.b, sum(w * exp(-((m.x0 - y0) ** 2 + (m.x1 - y1) ** 2) / (2 * sigma)) / (2 * pi() * sigma)) AS f FROM ahead h JOIN mean_next m ON m.node = h.node GROUP BY h.iter, h.node, h.b)
 SELECT i, j, sum(w * 1 / (1 + exp(d - bb))) / sum(w) AS p FROM (SELECT p.i, p.j, p.d, f.b AS bb, f.f * g.f AS w FROM (SELECT a.node AS i, b.node AS j, {DIST} AS d FROM mean_next a JOIN mean_next b ON a.node < b.node) p
 JOIN dens f ON f.node = p.i JOIN dens g ON g.node = p.j AND g.iter = f.iter) GROUP BY i, j""")
def forecast_marginal(c):
    last, trans, clusters, intercepts = _model(c)
    target = forecast.mean_positions(forecast.next_positions(last, trans, clusters, ["iter"]))
    return forecast.marginal(target, last, trans, clusters, intercepts)


@query("k_from:i k_to:i iter:i w:d", "trans final draws", """, used AS (SELECT DISTINCT z FROM final)
 SELECT k_from, k_to, iter, w / sum(w) OVER (PARTITION BY iter, k_from) AS w FROM trans CROSS JOIN draws WHERE k_from IN (FROM used) AND k_to IN (FROM used)""")
def last_step_weights(c):
    last, trans, _, _ = _model(c)
    return forecast.among_active(last, trans, ["iter"])


def _uniform(k: int):
    """Numbers that SQL can repeat."""
    return (F.pmod(F.col("iter") * 7919 + F.col("node") * 104729 + F.lit(k) * 1299709, F.lit(997)) + F.lit(0.5)) / F.lit(997.0)


DRAWN = "((iter * 7919 + node * 104729 + {} * 1299709) % 997 + 0.5::DOUBLE) / 997.0::DOUBLE"
AHEAD = f""", onward AS (SELECT iter, node, x0, x1, lam, b, shift, k_to, sum(w) OVER (PARTITION BY iter, node ORDER BY k_to) AS upto, sum(w) OVER (PARTITION BY iter, node) AS whole
 FROM final JOIN trans ON k_from = z CROSS JOIN draws), taken AS (SELECT iter, node, x0, x1, lam, b, shift, min(k_to) AS z FROM onward WHERE upto >= {DRAWN.format(0)} * whole GROUP BY ALL),
 drawn AS (SELECT iter, node, b, z, lam * (m0 + shift) + (1 - lam) * x0 + r * cos(a) AS x0, lam * (m1 + shift) + (1 - lam) * x1 + r * sin(a) AS x1
 FROM (SELECT taken.*, m0, m1, sqrt(-2 * ln({DRAWN.format(1)}) * sigma * (1 + shift)) AS r, 2 * pi() * {DRAWN.format(2)} AS a FROM taken JOIN clusters ON k = z))"""


@query("iter:i node:i z:i x0:d x1:d", "final trans clusters draws", AHEAD + " SELECT iter, node, z, x0, x1 FROM drawn")
def forecast_draws(c):
    last, trans, clusters, _ = _model(c)
    return forecast.drawn_positions(last, trans, clusters, _uniform).select("iter", "node", "z", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query("i:i j:i p:d", "final trans clusters draws", AHEAD + f" SELECT a.node AS i, b.node AS j, avg(1 / (1 + exp({DIST} - a.b))) AS p FROM drawn a JOIN drawn b ON a.iter = b.iter AND a.node < b.node GROUP BY ALL")
def forecast_posterior_predictive(c):
    return forecast.posterior_predictive(*_model(c), _uniform)


# Missing dyads.


@query("t:i src:i dst:i y:i", "dyads", f"""SELECT t, src, dst, CASE WHEN gone THEN (mean > 0.5)::INT ELSE y END AS y FROM (SELECT *, {HASH} < 150 AS gone FROM dyads)
 JOIN (SELECT t, avg(CASE WHEN {HASH} >= 150 THEN y END) AS mean FROM dyads GROUP BY t) USING (t)""")
def impute_mode(c):
    gone = likelihood.distances(c.positions()).where(missing.arithmetic() < 150)
    return missing.imputed(likelihood.dyads(c.positions(), c.net(), missing=gone).select("t", "src", "dst", "y"))


@query("t:i n_test:i n_edges:i", "dyads", f"""SELECT t, count(*) AS n_test, sum(y) AS n_edges FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {HASH}, src, dst) AS place,
 count(*) OVER (PARTITION BY t) AS n FROM dyads) WHERE place <= ceil(0.1::DOUBLE * n) GROUP BY t""")
def split_counts(c):
    split = missing.train_test_split(_pairs(c), 0.1, missing.arithmetic())
    return split.where("held_out").groupBy("t").agg(F.count("*").alias("n_test"), F.sum("y").alias("n_edges"))


# Densities, and the moves of the simulators' groups.


@query("k_from:i value:d", "trans", """SELECT k_from, lgamma(sum(1.0::DOUBLE + k_to)) - sum(lgamma(1.0::DOUBLE + k_to)) + sum(k_to * ln(w)) AS value FROM trans GROUP BY k_from""")
def dirichlet_density(c):
    rows = trans_of(c).groupBy("k_from").agg(F.sort_array(F.collect_list(F.struct("k_to", "w"))).alias("s"))  # four by four
    alphas = F.transform("s", lambda v: F.lit(1.0) + v["k_to"])
    return rows.select("k_from", dirichlet_logpdf(F.transform("s", lambda v: v["w"]), alphas).alias("value"))


@query("t:i node:i value:d", "pos", "SELECT t, node, lgamma(2.5::DOUBLE) - lgamma(1.5::DOUBLE) - ln(3 * pi() * 1.5::DOUBLE) - 2.5::DOUBLE * ln(1 + ((x0 - 0.5::DOUBLE) ** 2 + (x1 + 0.5::DOUBLE) ** 2) / (1.5::DOUBLE * 3)) AS value FROM pos")
def t_density(c):
    mean = F.array(F.lit(0.5), F.lit(-0.5))
    return c.positions().select("t", "node", multivariate_t_logpdf(F.col("x"), F.lit(3.0), mean, F.lit(1.5)).alias("value"))


@query("phase:i k_from:i k_to:i w:d", "", """WITH six AS (SELECT * FROM (VALUES (0, -4, 0), (1, 4, 0), (2, -2, 0), (3, 2, 0), (4, 0, 5), (5, 0, -5)) v(k, x, y)),
 split AS (SELECT * FROM (VALUES (0, -2, 0), (1, 2, 0), (2, -4, 0), (3, 4, 0), (4, 0, 5), (5, 0, -5)) v(k, x, y)),
 pairs AS (SELECT 0 AS phase, 20 AS sticky, a.k AS k_from, b.k AS k_to, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM six a CROSS JOIN six b
 UNION ALL SELECT 1, 1, a.k, b.k, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) FROM split a CROSS JOIN split b WHERE a.k < 2
 UNION ALL SELECT 2, 20, a.k, b.k, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) FROM split a CROSS JOIN split b WHERE b.k < 4),
 weights AS (SELECT *, CASE WHEN d = 0 THEN sticky * max(1 / nullif(d, 0)) OVER (PARTITION BY phase, k_from) ELSE 1 / d END AS v FROM pairs)
 SELECT phase, k_from, k_to, v / sum(v) OVER (PARTITION BY phase, k_from) AS w FROM weights""")
def scenario_moves(c):
    """The chances of moving between six groups, from two groups into six, and from six into four."""
    import numpy as np

    from .plans import simulate

    split = np.array(simulate.TWO_FIRST)
    phases = [simulate.staying(np.array(simulate.SIX), 20.0), simulate.crossing(split[:2], split), simulate.crossing(split, split[:4], 20.0)]
    rows = [(phase, a, b, float(v)) for phase, w in enumerate(phases) for a, row in enumerate(w) for b, v in enumerate(row)]
    return c.spark.createDataFrame(rows, "phase int, k_from int, k_to int, w double")


# What SQL can't express: simulators, estimators and the operators of linear algebra. Tests hold them against dense forms.


def _scenario(name: str):
    def run(c):
        from .plans import simulate

        sim = simulate.simulate(c.spark, name, [1, 2, 3, 4])
        return sim.where("part = 'edge'").selectExpr("seed", "t", "i AS src", "j AS dst", "p")

    run.__name__ = f"simulate_{name}"
    query("seed:i t:i src:i dst:i p:d", "", None)(run)


for _name in ("splitting", "merging", "merging_blocks", "static_communities", "homogeneous", "inhomogeneous", "splitting_and_merging", "detection_limit"):
    _scenario(_name)


def _chain(name: str):
    """Two chains on the trade network, tuned once, as posterior link probabilities of the best sample."""

    def run(c):
        from .plans import models

        kind = {"lsm": models.LSM, "lpcm": models.LPCM, "hdp_lpcm": models.HDPLPCM}[name]
        net = c.net()
        first = net.agg(F.min("t").alias("first"))
        edges = network.symmetrised(net).join(F.broadcast(first), how="cross").select((F.col("t") - F.col("first")).alias("t"), "src", "dst")
        steps = edges.select("t").distinct()
        est = kind(c.spark, chains=2, n_components=4, n_iter=100, tune=100, burn=50, thin=2, start_iter=100, start_tune=100, start_burn=50)
        return est.fit(edges, c.nodes(), steps).probabilities().select("t", "src", "dst", "y", "p")

    run.__name__ = f"fit_{name}"
    query("t:i src:i dst:i y:i p:d", "", None)(run)


for _name in ("lsm", "lpcm", "hdp_lpcm"):
    _chain(_name)


@query("i:i j:i p:d", "", None)
def forecast_monte_carlo(c):
    last, trans, clusters, _ = _model(c)
    first = lambda df: df.where("iter = 0").drop("iter")
    return forecast.monte_carlo(first(last), first(trans), first(clusters), 1.0)


@query("z:d p:d", "", None)
def geweke_spectral(c):
    z, p = diagnostics.geweke(c.trace())
    return c.spark.createDataFrame([(z, p)], "z double, p double")


@query("t:i node:i x0:d x1:d", "", None)
def procrustes_alignment(c):
    """Positions turned by a right angle and brought back: the cross-product is summed in Spark, its SVD is the driver's."""
    import numpy as np

    pos = c.positions().select("t", "node", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")).withColumn("u0", -F.col("x1")).withColumn("u1", F.col("x0"))
    sums = pos.agg(*[F.sum(F.col(f"u{a}") * F.col(f"x{b}")).alias(f"m{a}{b}") for a in range(2) for b in range(2)]).first()
    m = np.array([[sums[f"m{a}{b}"] for b in range(2)] for a in range(2)])
    u, _, v = np.linalg.svd(m)
    r = u @ v
    turned = [F.col("u0") * F.lit(float(r[0, d])) + F.col("u1") * F.lit(float(r[1, d])) for d in range(2)]
    return pos.select("t", "node", turned[0].alias("x0"), turned[1].alias("x1"))


@query("node:i z:i", "", None)
def longitudinal_kmeans(c):
    """From seeded centres; nodes that miss steps keep their place. trajectory_kmeans takes the same rounds from given ones."""
    from .operators import trajectories

    return trajectories.kmeans(c.positions(), 4).labels


@query("t:i k:i diameter:d", "", None)
def contours(c):
    from .operators import plotdata

    return plotdata.normal_contours(clusters_of(c)).select(F.lit(0).alias("t"), "k", "diameter")


from . import catalog_models  # noqa: E402, F401  (registers its queries)
