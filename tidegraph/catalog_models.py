"""Queries of fits, draws, linkages and label paths, registered with those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import EVERY, LAMBDA, LOGPDF, PATHS, clusters_of, query, trans_of
from .functions import variates
from .functions.scalar import truncated_normal_logpdf
from .operators import draws, labelling, likelihood, linkage, maximum, metrics, network, ordered, posterior, scaling, spectra, trajectories
from .storage import written


# Maximum likelihood. The SQL takes the same Newton steps; these data need no halved ones.


def _newton_sql(dyads: str, z0: str, z1: str, start: tuple[float, float], rounds: int = 12) -> str:
    return f""", pts AS MATERIALIZED (SELECT y, ({z0})::DOUBLE AS z0, ({z1})::DOUBLE AS z1 FROM {dyads}),
 steps_taken AS (SELECT 0 AS round, {start[0]}::DOUBLE AS a, {start[1]}::DOUBLE AS b UNION ALL
 SELECT round, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
 SELECT round + 1 AS round, any_value(a) AS a, any_value(b) AS b, sum((y - p) * z0) AS ga, sum((y - p) * z1) AS gb, sum(p * (1 - p) * z0 * z0) AS haa, sum(p * (1 - p) * z0 * z1) AS hab, sum(p * (1 - p) * z1 * z1) AS hbb
 FROM (SELECT s.*, y, z0, z1, 1 / (1 + exp(-(a * z0 + b * z1))) AS p FROM steps_taken s CROSS JOIN pts) WHERE round < {rounds} GROUP BY round)),
 best AS (SELECT a, b FROM steps_taken WHERE round = {rounds})
 SELECT {{out}}, (SELECT sum(y * (a * z0 + b * z1) - greatest(a * z0 + b * z1, 0) - ln(1 + exp(-abs(a * z0 + b * z1)))) FROM pts) AS loglik FROM best"""


@query("scale:d intercept:d loglik:d", "dyads", _newton_sql("dyads", "-d", "1", (1.0, 1.0)).format(out="ln(a) AS scale, b AS intercept"))
def mle_undirected(c):
    fit = maximum.scale_and_intercept(c.positions(), c.net())
    return c.spark.createDataFrame([(*fit.values, fit.loglik)], "scale double, intercept double, loglik double")


@query("b_in:d b_out:d loglik:d", "ddyads", _newton_sql("ddyads", "1 - d / r_dst", "1 - d / r_src", (0.0, 0.0)).format(out="a AS b_in, b AS b_out"))
def mle_directed(c):
    fit = maximum.directed_intercepts(c.positions(), c.net(), network.initial_radii(c.net(), c.nodes()))
    return c.spark.createDataFrame([(*fit.values, fit.loglik)], "b_in double, b_out double, loglik double")


# Controls.


def _residue(*of):
    """A number in [0, 1) that SQL can repeat."""
    total = F.lit(0)
    for k, c in enumerate(of):
        total = total + c * (7919, 104729, 1299709)[k]
    return (F.pmod(total, F.lit(9973)) + F.lit(0.5)) / F.lit(9973.0)


def _floyd(name: str, free: str, keys: str, residue: str) -> str:
    """The sets drawn by Floyd's method of free (keys, available, size), a number a row."""
    pick = f"floor(((({residue}) % 9973 + 0.5::DOUBLE) / 9973.0::DOUBLE) * (j + 1))::BIGINT"
    return f""", {name}_steps AS (SELECT {keys}, available, greatest(available - size, 0) AS j, []::BIGINT[] AS got FROM {free} WHERE size > 0 AND available > 0
 UNION ALL SELECT {keys}, available, j + 1, list_append(got, CASE WHEN list_contains(got, {pick}) THEN j ELSE {pick} END) FROM {name}_steps WHERE j < available),
 {name} AS (SELECT {keys}, unnest(got) AS rank FROM {name}_steps WHERE j = available)"""


@query("t:i src:i dst:i", "net pos", """, others AS (SELECT p.t, p.node AS src, q.node AS dst, row_number() OVER (PARTITION BY p.t, p.node ORDER BY q.node) - 1 AS rank
 FROM pos p JOIN pos q ON q.t = p.t AND q.node <> p.node ANTI JOIN net n ON n.t = p.t AND n.src = p.node AND n.dst = q.node),
 free AS (SELECT t, src, count(*) AS available, least(count(*), 12) AS size FROM others GROUP BY t, src)""" + _floyd("drawn", "free", "t, src", "t * 7919 + src * 104729 + j * 1299709") + """
 SELECT t, src, dst FROM others JOIN drawn USING (t, src, rank)""")
def control_nodes_exact(c):
    return draws.exact_controls(c.positions(), c.net(), 12, _residue)


@query("src:i dst:i connected:i", "net nodes", """, ever AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM net UNION ALL SELECT dst, src FROM net) WHERE src <> dst),
 grid AS (SELECT i.node AS src, j.node AS dst, (e.src IS NOT NULL)::INT AS connected FROM nodes i JOIN nodes j ON i.node <> j.node LEFT JOIN ever e ON e.src = i.node AND e.dst = j.node),
 others AS (SELECT *, row_number() OVER (PARTITION BY src, connected ORDER BY dst) - 1 AS rank FROM grid),
 sums AS (SELECT src, sum(connected)::BIGINT AS m, (SELECT count(*) FROM nodes) AS n FROM grid GROUP BY src),
 near AS (SELECT src, m, n, CASE WHEN m > 0 THEN greatest(floor(m / n::DOUBLE * 8)::BIGINT, 1) ELSE 0 END AS size FROM sums),
 free AS (SELECT src, 1 AS connected, m AS available, least(size, m) AS size FROM near UNION ALL SELECT src, 0, n - 1 - m, least(8 - size, n - 1 - m) FROM near)""" + _floyd("drawn", "free", "src, connected", "src * 7919 + j * 104729 + connected * 1299709") + """
 SELECT src, dst, connected FROM others JOIN drawn USING (src, connected, rank)""")
def control_nodes_stratified(c):
    return draws.stratified_controls(c.nodes(), c.net(), 8, _residue)


# Label paths. The SQL lists all paths of every node.


RATED = f"SELECT t, node, k, {LOGPDF} AS value FROM ({EVERY})"
ALL_PATHS = f""", rated AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY node ORDER BY t) AS s FROM ({RATED})),
 walks AS (SELECT node, s, k, [k] AS ks, value + ln(0.25::DOUBLE) AS lp FROM rated WHERE s = 1
 UNION ALL SELECT r.node, r.s, r.k, list_append(w.ks, r.k), w.lp + ln(m.w) + r.value FROM walks w JOIN rated r ON r.node = w.node AND r.s = w.s + 1 JOIN trans m ON m.k_from = w.k AND m.k_to = r.k),
 whole AS MATERIALIZED (SELECT node, ks, lp, max(lp) OVER (PARTITION BY node) AS top FROM walks JOIN (SELECT node, max(s) AS s FROM rated GROUP BY node) USING (node, s)),
 seen AS (SELECT DISTINCT t, node, s FROM rated)"""


def _chain_parts(c):
    init = c.spark.range(4).select(F.col("id").cast("int").alias("k"), F.lit(0.25).alias("w"))
    return c.positions(), init, trans_of(c), clusters_of(c), LAMBDA


@query("t:i node:i k:i p:d", "steps clusters trans", ALL_PATHS + """ SELECT t, node, k, sum(coalesce(e, 0)) / any_value(total) AS p FROM rated
 LEFT JOIN (SELECT node, unnest(range(1, len(ks) + 1)) AS s, unnest(ks) AS k, exp(lp - top) AS e FROM whole) USING (node, s, k)
 JOIN (SELECT node, sum(exp(lp - top)) AS total FROM whole GROUP BY node) USING (node) GROUP BY t, node, k""")
def label_marginals(c):
    return labelling.marginals(*_chain_parts(c))


@query("t:i node:i z:i", "steps clusters trans", ALL_PATHS + " SELECT t, node, best[s] AS z FROM (SELECT node, arg_max(ks, lp) AS best FROM whole GROUP BY node) JOIN seen USING (node)")
def label_path(c):
    return labelling.best_path(*_chain_parts(c))


#: A draw goes on from the paths that begin with what is drawn so far: of their chances by the next label it takes the first that, cumulated, reaches the number.
DRAWS = ", chosen AS (SELECT node, 0 AS s, []::INT[] AS got FROM nodes UNION ALL SELECT node, s, list_append(got, min(k)::INT) FROM (" + """
 SELECT node, s, got, k, sum(e) OVER (PARTITION BY node ORDER BY k) AS upto, sum(e) OVER (PARTITION BY node) * ((((node * 7919 + t * 104729) % 9973) + 0.5::DOUBLE) / 9973.0::DOUBLE) AS aim FROM (
 SELECT c.node, c.s + 1 AS s, c.got, w.ks[c.s + 1] AS k, any_value(n.t) AS t, sum(exp(w.lp - w.top)) AS e FROM chosen c JOIN whole w ON w.node = c.node AND w.ks[1 : c.s] = c.got JOIN seen n ON n.node = c.node AND n.s = c.s + 1 GROUP BY ALL))
 WHERE upto >= aim GROUP BY node, s, got)"""


@query("t:i node:i z:i", "steps clusters trans nodes", ALL_PATHS + DRAWS + " SELECT t, node, got[s] AS z FROM seen JOIN (SELECT node, arg_max(got, s) AS got FROM chosen GROUP BY node) USING (node)")
def label_draw(c):
    return labelling.drawn_path(*_chain_parts(c), _residue)


# Average linkage. The SQL merges one nearest pair of a step at a time.


def _merged(rounds: int) -> str:
    """Likeness as whole numbers of samples, for all pairs; 25 nodes need 24 merges."""
    out = """, whole AS MATERIALIZED (SELECT t, count(DISTINCT iter) AS s FROM smp GROUP BY t), members AS MATERIALIZED (SELECT DISTINCT t, node FROM smp),
 counted AS (SELECT a.t, a.node AS i, b.node AS j, count(*) AS c FROM smp a JOIN smp b ON a.iter = b.iter AND a.t = b.t AND a.z = b.z AND a.node < b.node GROUP BY a.t, a.node, b.node),
 l0 AS MATERIALIZED (SELECT a.t, a.node AS i, b.node AS j, coalesce(c, 0)::BIGINT AS c, 1::BIGINT AS n_i, 1::BIGINT AS n_j FROM members a JOIN members b ON a.t = b.t AND a.node < b.node LEFT JOIN counted k ON k.t = a.t AND k.i = a.node AND k.j = b.node)"""
    for k in range(rounds):
        out += f""",
 b{k} AS MATERIALIZED (SELECT * FROM l{k} QUALIFY row_number() OVER (PARTITION BY t ORDER BY c::DOUBLE / (n_i * n_j) DESC, i, j) = 1),
 l{k + 1} AS MATERIALIZED (SELECT t, i, j, sum(c)::BIGINT AS c, max(n_i) AS n_i, max(n_j) AS n_j FROM (SELECT l.t, l.c,
  least(CASE WHEN l.i = b.j THEN b.i ELSE l.i END, CASE WHEN l.j = b.j THEN b.i ELSE l.j END) AS i, greatest(CASE WHEN l.i = b.j THEN b.i ELSE l.i END, CASE WHEN l.j = b.j THEN b.i ELSE l.j END) AS j,
  CASE WHEN (CASE WHEN l.i = b.j THEN b.i ELSE l.i END) < (CASE WHEN l.j = b.j THEN b.i ELSE l.j END) THEN si ELSE sj END AS n_i, CASE WHEN (CASE WHEN l.i = b.j THEN b.i ELSE l.i END) < (CASE WHEN l.j = b.j THEN b.i ELSE l.j END) THEN sj ELSE si END AS n_j
  FROM (SELECT l{k}.*, CASE WHEN l{k}.i IN (b{k}.i, b{k}.j) THEN b{k}.n_i + b{k}.n_j ELSE l{k}.n_i END AS si, CASE WHEN l{k}.j IN (b{k}.i, b{k}.j) THEN b{k}.n_i + b{k}.n_j ELSE l{k}.n_j END AS sj FROM l{k} JOIN b{k} USING (t)) l JOIN b{k} b USING (t)
  WHERE NOT (l.i = b.i AND l.j = b.j)) GROUP BY t, i, j)"""
    union = " UNION ALL ".join(f"SELECT t, i AS a, j AS b, 1 - c::DOUBLE / (n_i * n_j * s) AS height, n_i AS offset_a, n_i + n_j AS n FROM b{k} JOIN whole USING (t)" for k in range(rounds))
    return out + f", merges AS MATERIALIZED ({union})"


LINKED = _merged(24)
ORDERED = """, ways AS (SELECT t, node, node AS top, 0::BIGINT AS place, 0 AS hops FROM members UNION ALL SELECT w.t, w.node, m.a, w.place + m.offset_a, hops + 1 FROM ways w JOIN merges m ON m.t = w.t AND m.b = w.top {only})
 SELECT t, node, {out} FROM (SELECT t, node, arg_max(top, hops) AS top, max(place) AS place FROM ways GROUP BY t, node)"""


def _linkage(c):
    return linkage.average_linkage(c.samples(), posterior.cooccurrence(c.samples()))


@query("t:i a:i b:i height:d n:i", "smp", LINKED + " SELECT t, a, b, height, n FROM merges")
def cooccurrence_linkage(c):
    return _linkage(c)


@query("t:i node:i place:i", "smp", LINKED + ORDERED.format(only="", out="place"))
def cooccurrence_order(c):
    return linkage.leaf_order(c.samples(), _linkage(c))


@query("t:i node:i z:i", "smp", LINKED + ORDERED.format(only="AND m.height <= 0.75::DOUBLE", out="dense_rank() OVER (PARTITION BY t ORDER BY top) - 1 AS z"))
def cooccurrence_clusters(c):
    return linkage.flat_clusters(c.samples(), _linkage(c), 0.75)


# Scaling. The SQL takes the same two rounds of one step.


def _guttman(before: str, after: str) -> str:
    return f"""{after} AS MATERIALIZED (SELECT node, sum(ratio * (x0 - y0)) / 25 AS x0, sum(ratio * (x1 - y1)) / 25 AS x1, sum((apart - d) ** 2) / 2 AS stress FROM (
 SELECT *, CASE WHEN apart > 0 THEN d / apart ELSE 0 END AS ratio FROM (SELECT a.node, a.x0, a.x1, b.x0 AS y0, b.x1 AS y1, f.d::DOUBLE AS d, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2) AS apart
 FROM far f JOIN {before} a ON a.node = f.src JOIN {before} b ON b.node = f.dst WHERE f.src <> f.dst)) GROUP BY node)"""


FAR = PATHS.format(", far AS MATERIALIZED (SELECT src, dst, d FROM (") + ") WHERE t = (SELECT min(t) FROM pos)), m0 AS (SELECT node, x0, x1 FROM pos WHERE t = (SELECT min(t) FROM pos)), "


@query("node:i x0:d x1:d stress:d", "sboth nodes pos", FAR + _guttman("m0", "m1") + ", " + _guttman("m1", "m2") + " SELECT * FROM m2")
def stress_rounds(c):
    first = c.positions().agg(F.min("t").alias("first"))
    at_first = lambda df: df.join(F.broadcast(first), F.col("t") == F.col("first")).drop("t", "first")
    far, x = written(at_first(network.shortest_paths(c.net(), c.nodes())), "scaling-far"), at_first(c.positions())
    for _ in range(2):
        x = scaling.majorised(far, x, 25)
    return x.select("node", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "stress")


@query("t:i node:i x0:d x1:d", "", None)
def gmds_positions(c):
    """Tests hold it against dense algebra."""
    x = scaling.generalised_mds(c.net(), c.nodes())
    return x.select("t", "node", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


# Trajectories. The SQL takes the same rounds, from the paths of the first four nodes.


def _lloyd(rounds: int) -> str:
    out = ", g0 AS (SELECT t, node AS k, x0 AS c0, x1 AS c1 FROM pos WHERE node < 4)"
    for r in range(rounds + 1):
        out += f""", n{r} AS MATERIALIZED (SELECT node, arg_min(k, (apart, k)) AS z FROM (SELECT p.node, g.k, avg((x0 - c0) ** 2 + (x1 - c1) ** 2) AS apart FROM pos p JOIN g{r} g USING (t) GROUP BY p.node, g.k) GROUP BY node)"""
        if r < rounds:
            out += f""", g{r + 1} AS MATERIALIZED (SELECT t, k, coalesce(m0, c0) AS c0, coalesce(m1, c1) AS c1 FROM g{r} LEFT JOIN (SELECT t, z AS k, avg(x0) AS m0, avg(x1) AS m1 FROM pos JOIN n{r} USING (node) GROUP BY t, z) USING (t, k))"""
    return out


def _trajectories(c):
    pos = c.positions()
    first = trajectories.centres_of(trajectories.paths(pos.where("node < 4")), trajectories.means(pos, 2))
    return pos, trajectories.kmeans(pos, 4, first, rounds=8)


@query("node:i z:i", "pos", _lloyd(8) + " SELECT node, z FROM n8")
def trajectory_kmeans(c):
    return _trajectories(c)[1].labels


@query("k:i m0:d m1:d variance:d", "pos", _lloyd(8) + """ SELECT k, avg(c0) AS m0, avg(c1) AS m1, coalesce(nullif(any_value(v), 0), 0.001::DOUBLE) AS variance FROM g8
 LEFT JOIN (SELECT z AS k, sum(v) / (SELECT count(DISTINCT t) FROM pos) AS v FROM (SELECT t, z, (var_pop(x0) + var_pop(x1)) / 2 AS v FROM pos JOIN n8 USING (node) GROUP BY t, z) GROUP BY z) USING (k) GROUP BY k""")
def trajectory_clusters(c):
    return trajectories.summary(*_trajectories(c)).select("k", F.col("mu")[0].alias("m0"), F.col("mu")[1].alias("m1"), "variance")


# Traces side by side. The SQL solves the same equations by recursion.


TRACES = """WITH RECURSIVE tr AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS iter, value AS x FROM events),
 kept AS (SELECT *, iter - min(iter) OVER (PARTITION BY event_type) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM tr WHERE iter >= 20),
 parted AS (SELECT event_type, 0 AS part, iter, x FROM kept WHERE k < floor(n * 0.1::DOUBLE) UNION ALL SELECT event_type, 1, iter, x FROM kept WHERE k >= n - floor(n * 0.5::DOUBLE)),
 sized AS (SELECT *, x - avg(x) OVER g AS e, count(*) OVER g AS n, avg(x) OVER g AS mean FROM parted WINDOW g AS (PARTITION BY event_type, part)),
 lags AS (SELECT a.event_type, a.part, any_value(a.n) AS n, any_value(a.mean) AS mean, l.range AS lag, sum(a.e * b.e) / any_value(a.n) AS r FROM (SELECT * FROM range(60)) l CROSS JOIN sized a
  JOIN sized b ON b.event_type = a.event_type AND b.part = a.part AND b.iter = a.iter - l.range WHERE l.range <= least(floor(10 * log10(a.n))::INT, a.n - 1) GROUP BY a.event_type, a.part, l.range),
 corr AS (SELECT event_type, part, any_value(n)::DOUBLE AS n, any_value(mean) AS mean, list(r ORDER BY lag) AS r FROM lags GROUP BY event_type, part),
 ar AS (SELECT event_type, part, n, r, 1 AS k, [r[2] / r[1]] AS a, r[1] * (1 - (r[2] / r[1]) ** 2) AS v FROM corr
  UNION ALL SELECT event_type, part, n, r, k + 1, list_append([s[1] - turn * s[2] for s in list_zip(a, list_reverse(a))], turn), v * (1 - turn ** 2)
  FROM (SELECT *, (r[k + 2] - list_dot_product(a, list_reverse(r[2 : k + 1]))) / v AS turn FROM ar WHERE k + 1 < len(r))),
 dens AS (SELECT event_type, part, arg_min(v * n / greatest(1, n - k - 1) / (1 - list_sum(a)) ** 2 / n, n * ln(v) + 2 * k) AS s0 FROM ar GROUP BY event_type, part)"""


def _traces(c):
    ranked = ordered.placed(c.table("events").select("event_type", "event_id", F.col("value").alias("x")), ["event_type"], ["event_id"], "iter")
    return ranked.select("event_type", "iter", "x")


@query("event_type:s z:d", "", TRACES + """ SELECT event_type, (max(CASE WHEN part = 0 THEN mean END) - max(CASE WHEN part = 1 THEN mean END)) / sqrt(sum(s0)) AS z FROM corr JOIN dens USING (event_type, part) GROUP BY event_type""")
def geweke_by_trace(c):
    return spectra.geweke(_traces(c), ["event_type"], n_burn=20)


@query("event_type:s part:i spectrum0:d", "", TRACES + " SELECT event_type, part, s0 AS spectrum0 FROM dens")
def spectra_by_trace(c):
    kept = spectra.retained(_traces(c), 20)
    sizes = kept.groupBy("event_type").agg(F.count("*").alias("n"))
    at = F.col("iter") - 20
    parts = F.filter(F.array(F.when(at < F.floor(F.col("n") * F.lit(0.1)), F.lit(0)), F.when(at >= F.col("n") - F.floor(F.col("n") * F.lit(0.5)), F.lit(1))), lambda v: v.isNotNull())
    rows = written(kept.join(sizes, "event_type").select("event_type", F.explode(parts).alias("part"), "iter", "x"), "trace-parts")
    return spectra.spectra(rows, ["event_type", "part"])


@query("event_type:s parameter:s iter:i x:d", "", """WITH d AS (SELECT event_type, day(ts) AS iter, sum(value) AS logp, count(*)::DOUBLE AS n FROM events GROUP BY ALL)
 SELECT event_type, 'logp' AS parameter, iter, logp AS x FROM d UNION ALL SELECT event_type, 'n', iter, n FROM d""")
def trace_table(c):
    days = c.table("events").groupBy("event_type", F.dayofmonth("ts").alias("iter")).agg(F.sum("value").alias("logp"), F.count("*").alias("n"))
    return spectra.trace_table(days, ["event_type"], ["logp", "n"])


# Variates of counted uniforms, and the density of a cut normal.


ERF = "(2 / sqrt(pi()) * list_sum([(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(abs({x})) - lgamma(k + 1)) / (2 * k + 1) for k in range(0, 80)]) * sign({x}))"
CDF = "(0.5::DOUBLE * (1 + " + ERF.replace("{x}", "(({x}) / sqrt(2::DOUBLE))") + "))"


@query("t:i node:i value:d", "pos", f"""SELECT t, node, CASE WHEN x0 BETWEEN -1.5::DOUBLE AND 1.25::DOUBLE THEN -0.5::DOUBLE * ln(2 * pi() * 0.8::DOUBLE) - (x0 - 0.2::DOUBLE) ** 2 / 1.6::DOUBLE
 - ln({CDF.replace("{x}", "1.05 / sqrt(0.8::DOUBLE)")} - {CDF.replace("{x}", "-1.7 / sqrt(0.8::DOUBLE)")}) END AS value FROM pos""")
def truncated_density(c):
    value = truncated_normal_logpdf(F.col("x")[0], F.lit(0.2), F.lit(0.8), F.lit(-1.5), F.lit(1.25))
    return c.positions().select("t", "node", F.when(value > float("-inf"), value).alias("value"))


GAMMA_UNIFORM = "(((k_from * 7919 + k_to * 104729 + ({0}) * 1299709) % 9973 + 0.5::DOUBLE) / 9973.0::DOUBLE)"


@query("k_from:i k_to:i w:d", "dlab", f""", grid AS (SELECT node AS k_from, z AS k_to, 0.5::DOUBLE + count(*) AS alpha FROM dlab GROUP BY node, z),
 made AS (SELECT *, CASE WHEN alpha < 1 THEN alpha + 1 ELSE alpha END - 1 / 3.0::DOUBLE AS d FROM grid),
 tried AS (SELECT k_from, k_to, alpha, d, i, greatest(1 + x / sqrt(9 * d), 0) ** 3 AS v, x, u FROM (SELECT made.*, r.range AS i, sqrt(-2 * ln({GAMMA_UNIFORM.format("3 * r.range")})) * cos(2 * pi() * {GAMMA_UNIFORM.format("3 * r.range + 1")}) AS x,
  {GAMMA_UNIFORM.format("3 * r.range + 2")} AS u FROM made CROSS JOIN range(16) r)),
 got AS (SELECT k_from, k_to, any_value(alpha) AS alpha, arg_min(d * v, i) AS g FROM tried WHERE v > 0 AND ln(u) < 0.5::DOUBLE * x * x + d - d * v + d * ln(v) GROUP BY k_from, k_to),
 final AS (SELECT k_from, k_to, CASE WHEN alpha < 1 THEN g * {GAMMA_UNIFORM.format("48")} ** (1 / alpha) ELSE g END AS g FROM got) SELECT k_from, k_to, g / sum(g) OVER (PARTITION BY k_from) AS w FROM final""")
def dirichlet_draws(c):
    """Each node's shares of the labels it has had, given how often it had them."""
    had = c.dynamic_labels().groupBy(F.col("node").alias("k_from"), "z").agg(F.count("*").alias("n"))
    rows = had.groupBy("k_from").agg(F.sort_array(F.collect_list(F.struct("z", "n"))).alias("had"))  # as many as labels
    alphas = F.transform("had", lambda s: F.lit(0.5) + s["n"])
    drawn = variates.dirichlet(alphas, lambda i, k: _residue(F.col("k_from"), F.element_at("had", i + 1)["z"], k))
    return rows.select("k_from", F.explode(F.arrays_zip(F.transform("had", lambda s: s["z"]).alias("k_to"), drawn.alias("w"))).alias("s")).select("k_from", "s.k_to", "s.w")


@query("t:i z0:i z1:i m:i", "moves", """SELECT t, z0, z1, sum(((((t * 7919 + (z0 * 4 + z1) * 104729 + i * 1299709) % 9973) + 0.5::DOUBLE) / 9973.0::DOUBLE < mass / (mass + i))::INT) AS m
 FROM (SELECT t, z0, z1, unnest(range(n)) AS i, 0.5::DOUBLE + 0.25::DOUBLE * z1 + CASE WHEN z0 = z1 THEN 2 ELSE 0 END AS mass FROM moves) GROUP BY t, z0, z1""")
def table_counts(c):
    mass = F.lit(0.5) + F.lit(0.25) * F.col("z1") + F.when(F.col("z0") == F.col("z1"), 2.0).otherwise(0.0)
    opened = variates.tables("n", mass, lambda i: _residue(F.col("t"), F.col("z0") * 4 + F.col("z1"), i))
    return metrics.transition_counts(c.dynamic_labels()).select("t", "z0", "z1", opened.alias("m"))


# Weighted paths. The SQL squares the matrix of lengths five times, for paths of up to 32 edges.


def _squared_lengths(rounds: int) -> str:
    out = """, len AS (SELECT t, src, dst, min(w) AS w FROM (SELECT t, src, dst, 100.0::DOUBLE / w AS w FROM net UNION ALL SELECT t, dst, src, 100.0::DOUBLE / w FROM net) GROUP BY ALL),
 q0 AS MATERIALIZED (SELECT t, src, dst, w AS d FROM len UNION ALL SELECT DISTINCT t, src, src, 0.0::DOUBLE FROM len)"""
    for k in range(rounds):
        out += f", q{k + 1} AS MATERIALIZED (SELECT a.t, a.src, b.dst, min(a.d + b.d) AS d FROM q{k} a JOIN q{k} b ON a.t = b.t AND a.dst = b.src GROUP BY a.t, a.src, b.dst)"
    return out


@query("t:i src:i dst:i d:d", "net nodes", _squared_lengths(5) + """ SELECT p.t, p.src, p.dst, CASE WHEN p.src = p.dst THEN 0 ELSE coalesce(d, far) END AS d FROM (SELECT DISTINCT s.t, i.node AS src, j.node AS dst FROM len s CROSS JOIN nodes i CROSS JOIN nodes j) p
 LEFT JOIN q5 USING (t, src, dst) JOIN (SELECT t, max(d) + 1 AS far FROM q5 GROUP BY t) USING (t)""")
def sp_weighted(c):
    edges = c.net().select("t", "src", "dst", (F.lit(100.0) / F.col("w")).alias("w"))
    return network.weighted_shortest_paths(edges, c.nodes())


# Distances by other metrics.


def _metric(name: str, value: str):
    def run(c):
        return likelihood.distances(c.positions(), metric=name)

    run.__name__ = f"pairwise_{name}"
    query("t:i src:i dst:i d:d", "pos", f"SELECT a.t, a.node AS src, b.node AS dst, {value} AS d FROM pos a JOIN pos b ON a.t = b.t AND a.node < b.node")(run)


_metric("manhattan", "abs(a.x0 - b.x0) + abs(a.x1 - b.x1)")
_metric("chebyshev", "greatest(abs(a.x0 - b.x0), abs(a.x1 - b.x1))")
_metric("cosine", "1 - (a.x0 * b.x0 + a.x1 * b.x1) / nullif(sqrt(a.x0 ** 2 + a.x1 ** 2) * sqrt(b.x0 ** 2 + b.x1 ** 2), 0)")
