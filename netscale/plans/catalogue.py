"""Every registered query of the time-series engine, with SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.functions import columns
from netscale.operators import bipartite, cluster, corr, generators, graph, partitions, percolation, series, sparse, spectral, stats
from netscale.plans import views, workflow
from netscale.plans.views import CORR, EMB, EVENTS, LINKS, NATION, PVALS, USERS
from netscale.sources import readers
from netscale.sources.shared import put_text, shared_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Bands of event series in cycles an hour, and the threshold of the correlation network.
THRESHOLD = 0.25
#: Of the network whose spectrum is taken: it has all nations.
DENSE = 0.15
BANDS = [("day", 1 / 30, 1 / 20), ("half_day", 1 / 14, 1 / 10), ("fast", 0.2, 0.5)]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {sql}" if sql.lstrip()[:6] != "SELECT" else sql
        return f

    return add


def r(name: str, digits: int = 6):
    """Rounded, and never minus 0."""
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def band_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BANDS, "band string, lo double, hi double")


BAND_SQL = "bands(band, lo, hi) AS (VALUES " + ", ".join(f"('{b}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for b, lo, hi in BANDS) + ")"

# --- series --------------------------------------------------------------------------------------------------------------------


@query(f"{NATION} SELECT series_id, t, round(value, 4) + 0.0 AS value FROM nation_month")
def series_densify(spark, d):
    return views.nation_month(spark, d).select("series_id", "t", r("value", 4))


@query(f"{NATION} SELECT series_id, t, round(value - avg(value) OVER (PARTITION BY series_id), 6) + 0.0 AS value FROM nation_month")
def series_center(spark, d):
    return series.center(views.nation_month(spark, d)).select("series_id", "t", r("value"))


@query(f"{NATION} SELECT series_id, t, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0.0 AS value FROM nation_month WINDOW w AS (PARTITION BY series_id)")
def series_zscore(spark, d):
    return series.zscore(views.nation_month(spark, d)).select("series_id", "t", r("value"))


@query(f"{EVENTS} SELECT series_id, t, round(value, 4) + 0.0 AS value FROM event_hour WHERE series_id IN (SELECT series_id FROM event_hour GROUP BY 1 HAVING sum(value) <> 0)")
def drop_zero_series(spark, d):
    return series.drop_zero_series(views.event_hour(spark, d)).select("series_id", "t", r("value", 4))


@query(f"{EVENTS} SELECT t AS time, " + ", ".join(f"round(max(value) FILTER (series_id = {i}), 4) AS Signal{i}" for i in range(5)) + " FROM event_hour GROUP BY t")
def pivot_wide(spark, d):
    wide = series.pivot_wide(views.event_hour(spark, d), range(5))
    return wide.select("time", *[F.round(c, 4).alias(c) for c in wide.columns[1:]])


@query(f"{NATION} SELECT t AS series_id, series_id AS t, round(value, 4) + 0.0 AS value FROM nation_month")
def transpose(spark, d):
    return series.transpose(views.nation_month(spark, d)).select("series_id", "t", r("value", 4))


@query(f"{EVENTS} SELECT series_id, t, round(value, 4) + 0.0 AS value FROM event_hour WHERE t >= 100 AND t < 200 AND series_id IN (0, 2)")
def series_window(spark, d):
    return series.window_of(views.event_hour(spark, d), 100, 200, (0, 2)).select("series_id", "t", r("value", 4))


@query(f"{NATION} SELECT series_id, t, round(lead(value) OVER (PARTITION BY series_id ORDER BY t) - value, 4) + 0.0 AS diff FROM nation_month")
def first_difference(spark, d):
    return series.difference(views.nation_month(spark, d), "value", "t", ["series_id"]).select("series_id", "t", r("diff", 4))


@query(f"{NATION} SELECT series_id, t, round(value, 4) + 0.0 AS value FROM nation_month ORDER BY series_id, t LIMIT 5")
def series_head(spark, d):
    return series.head(views.nation_month(spark, d), 5, ["series_id", "t"]).select("series_id", "t", r("value", 4))


DFT = f"""{EVENTS},
dft AS (SELECT e.series_id, CAST(f.k AS INT) AS k, CASE WHEN 2 * f.k < 720 THEN f.k ELSE f.k - 720 END / 720.0::DOUBLE AS freq,
  sum(value * cos(2 * pi() * ((f.k * t) % 720) / 720)) AS re, -sum(value * sin(2 * pi() * ((f.k * t) % 720) / 720)) AS im
  FROM event_hour e CROSS JOIN range(720) f(k) GROUP BY 1, 2, 3)"""


@query(f"{DFT} SELECT series_id, k, round(freq, 9) + 0.0 AS freq, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM dft")
def dft(spark, d):
    return series.dft(views.event_hour(spark, d)).select("series_id", "k", r("freq", 9), r("re", 4), r("im", 4))


@query(f"{DFT} SELECT series_id, k, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM dft")
def dft_by_sums(spark, d):
    return series.dft_by_sums(views.event_hour(spark, d)).select("series_id", "k", r("re", 4), r("im", 4))


@query(f"{DFT} SELECT k, round(avg(sqrt(re * re + im * im)), 4) AS amplitude FROM dft WHERE freq >= 0 GROUP BY k")
def amplitude_spectrum(spark, d):
    return series.amplitude_spectrum(series.dft(views.event_hour(spark, d))).select("k", r("amplitude", 4))


@query(f"{DFT}, {BAND_SQL} SELECT band, series_id, k, round(sqrt(re * re + im * im), 4) AS magnitude FROM dft JOIN bands ON abs(freq) BETWEEN lo AND hi")
def band_spectrum(spark, d):
    return series.magnitude(series.spectrum_filter(series.dft(views.event_hour(spark, d)), band_table(spark))).select("band", "series_id", "k", r("magnitude", 4))


FILTERED = f"""{DFT}, {BAND_SQL},
filtered AS (SELECT band, series_id, CAST(h.t AS INT) AS t, sum(re * cos(2 * pi() * ((k * h.t) % 720) / 720) - im * sin(2 * pi() * ((k * h.t) % 720) / 720)) / 720 AS value
  FROM dft JOIN bands ON abs(freq) BETWEEN lo AND hi CROSS JOIN range(720) h(t) GROUP BY 1, 2, 3)"""


def _filtered(spark, d):
    return series.ideal_band_filter(views.event_hour(spark, d), band_table(spark))


@query(f"{FILTERED} SELECT band, series_id, t, round(value, 4) + 0.0 AS value FROM filtered")
def band_filter_ideal(spark, d):
    return _filtered(spark, d).select("band", "series_id", "t", r("value", 4))


@query(f"{FILTERED} SELECT band, round(avg(p), 4) AS power FROM (SELECT band, series_id, var_pop(value) AS p FROM filtered GROUP BY 1, 2) GROUP BY band")
def band_power(spark, d):
    return series.band_power(_filtered(spark, d)).select("band", r("power", 4))


@query(f"{FILTERED} SELECT a.band, a.series_id AS i, b.series_id AS j, round(corr(a.value, b.value), 6) + 0.0 AS r FROM filtered a JOIN filtered b ON a.band = b.band AND a.t = b.t AND a.series_id < b.series_id GROUP BY 1, 2, 3")
def band_corr(spark, d):
    return corr.correlation(_filtered(spark, d), ["band"]).select("band", "i", "j", r("r"))


@query()
def butterworth_band(spark, d):
    return series.butterworth(views.event_hour(spark, d), 1 / 30, 1 / 20).select("series_id", "t", r("value"))


@query()
def hilbert_frequency(spark, d):
    return series.hilbert(_filtered(spark, d), keys=["band"]).select("band", "series_id", "t", r("phase"), r("frequency"), r("amplitude"))


@query()
def empirical_modes(spark, d):
    return series.modes(views.event_hour(spark, d), 5).select("series_id", "mode", "t", r("value"))


@query()
def same_mode(spark, d):
    return series.same_mode(series.modes(views.event_hour(spark, d), 5), 1).select("series_id", "t", r("value"))


@query(f"""{NATION}, g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - row_number() OVER (PARTITION BY series_id, value ORDER BY t) AS grp FROM nation_month),
runs AS (SELECT series_id, value, min(t) AS a, max(t) AS b FROM g GROUP BY series_id, value, grp),
n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY a)),
tops AS (SELECT series_id, (a + b) // 2 AS t FROM n WHERE p < value AND q < value),
gaps AS (SELECT series_id, lead(t) OVER (PARTITION BY series_id ORDER BY t) - t AS gap FROM tops)
SELECT series_id, count(*) AS n_peaks, round(avg(gap) / 12.0::DOUBLE, 9) AS period FROM gaps GROUP BY series_id""")
def peak_period(spark, d):
    return series.peak_period(views.nation_month(spark, d), 12.0).select("series_id", "n_peaks", r("period", 9))


# --- correlation ---------------------------------------------------------------------------------------------------------------


@query(f"{CORR} SELECT i, j, round(r, 9) + 0.0 AS r FROM corr")
def corr_matrix(spark, d):
    return views.nation_corr(spark, d).select("i", "j", r("r", 9))


@query(f"{CORR} SELECT i, j, round(r, 9) + 0.0 AS r FROM corr")
def corr_by_sums(spark, d):
    return corr.correlation_by_sums(views.nation_month(spark, d)).select("i", "j", r("r", 9))


@query(f"{NATION} SELECT a.t AS i, b.t AS j, round(corr(a.value, b.value), 6) + 0.0 AS r FROM nation_month a JOIN nation_month b ON a.series_id = b.series_id AND a.t < b.t GROUP BY 1, 2")
def corr_time_axis(spark, d):
    return corr.correlation_of_times(views.nation_month(spark, d)).select("i", "j", r("r"))


@query(f"{EMB} SELECT a.series_id AS i, b.series_id AS j, round(corr(a.value, b.value), 6) + 0.0 AS r FROM emb a JOIN emb b ON a.t = b.t AND a.series_id < b.series_id GROUP BY 1, 2")
def corr_embeddings(spark, d):
    return corr.correlation(views.emb_signal(spark, d).drop("label")).select("i", "j", r("r"))


@query(f"{CORR} SELECT i AS src, j AS dst, round(r, 6) AS weight FROM corr WHERE r > 0")
def corr_clean_edges(spark, d):
    return corr.edges_of(corr.clean(views.nation_corr(spark, d))).select("src", "dst", r("weight"))


@query(f"{CORR} SELECT i AS src, j AS dst, round(r, 6) AS weight FROM corr WHERE r >= {THRESHOLD}::DOUBLE")
def corr_threshold_edges(spark, d):
    return corr.edges_of(corr.clean(views.nation_corr(spark, d), threshold=THRESHOLD)).select("src", "dst", r("weight"))


HALVES = f"""{NATION}, halves AS (SELECT *, t // 40 AS half, t % 40 AS u FROM nation_month),
hc AS (SELECT a.half, a.series_id AS i, b.series_id AS j, CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN round(corr(a.value, b.value), 12) END AS r FROM halves a JOIN halves b ON a.half = b.half AND a.u = b.u AND a.series_id < b.series_id GROUP BY 1, 2, 3)"""


def _halves(spark, d):
    return views.nation_month(spark, d).withColumns({"half": F.expr("t div 40"), "t": F.expr("t % 40")})


@query(f"{HALVES} SELECT i, j, CASE WHEN count(r) = count(*) THEN round(avg(r), 6) + 0.0 END AS r FROM hc GROUP BY 1, 2")
def corr_group_mean(spark, d):
    return corr.mean_matrix(corr.correlation(_halves(spark, d), ["half"]), []).select("i", "j", r("r"))


@query(f"{HALVES} SELECT series_id, u AS t, round(avg(value), 4) + 0.0 AS value FROM halves GROUP BY 1, 2")
def mean_signal(spark, d):
    return corr.mean_signal(_halves(spark, d)).select("series_id", F.col("t").cast("long"), r("value", 4))


@query(f"{CORR} SELECT round(min(r), 6) AS r_min, round(avg(r), 6) AS r_mean, round(max(r), 6) AS r_max, round(stddev_pop(r), 6) AS r_std FROM corr")
def matrix_summary(spark, d):
    return corr.summary(views.nation_corr(spark, d)).select(r("r_min"), r("r_mean"), r("r_max"), r("r_std"))


@query(f"{CORR} SELECT count(*) FILTER (r <= 0) AS n_zero, count(*) AS n_cells FROM corr")
def triu_zero_count(spark, d):
    return corr.count_zeros(corr.clean(views.nation_corr(spark, d)))


# --- graphs --------------------------------------------------------------------------------------------------------------------

REACH = """ids AS (SELECT DISTINCT series_id AS node FROM nation_month),
ways AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
reach(a, b) AS (SELECT node, node FROM ids UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
giant AS (SELECT node FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)),
inner_edges AS (SELECT * FROM edges WHERE src IN (FROM giant) AND dst IN (FROM giant))"""
EDGES = f"{CORR}, edges AS (SELECT i AS src, j AS dst, r AS weight FROM corr WHERE r >= {THRESHOLD}::DOUBLE), {REACH}"


def _network(spark, d, threshold=THRESHOLD):
    return graph.correlation_network(views.nation_month(spark, d), threshold=threshold)


def _edges(spark, d):
    return corr.edges_of(corr.clean(views.nation_corr(spark, d), threshold=THRESHOLD))


def _ids(spark, d):
    return views.nation_month_sparse(spark, d).select(F.col("series_id").alias("node")).distinct()


@query(f"{EDGES} SELECT node::BIGINT AS node, component::BIGINT AS component FROM comp")
def graph_components(spark, d):
    return graph.components(_ids(spark, d), _edges(spark, d))


@query(f"{EDGES} SELECT node::BIGINT AS node, component::BIGINT AS component FROM comp")
def graph_components_distributed(spark, d):
    return graph.components_of_large(_ids(spark, d), _edges(spark, d))


@query(f"{EDGES}, s AS (SELECT component::BIGINT AS component, count(*) AS n FROM comp GROUP BY 1) SELECT component, n, CAST(row_number() OVER (ORDER BY n DESC, component) AS INT) AS rank FROM s")
def components_by_size(spark, d):
    return graph.largest_first(graph.components(_ids(spark, d), _edges(spark, d)))


@query(f"{EDGES} SELECT node::BIGINT AS node FROM giant")
def giant_component(spark, d):
    return graph.giant_component(_ids(spark, d), _edges(spark, d))[0]


@query(f"{EDGES} SELECT node::BIGINT AS node FROM ids WHERE node NOT IN (FROM giant)")
def leftoff_nodes(spark, d):
    return _network(spark, d)[2]


@query(f"{EDGES} SELECT src, dst, round(weight, 6) AS weight FROM inner_edges")
def corr_network(spark, d):
    return _network(spark, d)[1].select("src", "dst", r("weight"))


@query(f"{EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE src % 2 = 0 AND dst % 2 = 0")
def induced_subgraph(spark, d):
    return graph.induced(_edges(spark, d), _ids(spark, d).where("node % 2 = 0")).select("src", "dst", r("weight"))


@query(f"""{CORR}, p AS (SELECT i, j, r FROM corr UNION ALL SELECT j, i, r FROM corr UNION ALL SELECT DISTINCT series_id, series_id, 1.0::DOUBLE FROM nation_month),
second AS (SELECT a.i AS src, b.i AS dst, round(corr(a.r, b.r), 12) AS weight FROM p a JOIN p b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2),
edges AS (SELECT * FROM second WHERE weight >= 0.1::DOUBLE), {REACH} SELECT src, dst, round(weight, 6) AS weight FROM inner_edges""")
def second_order_network(spark, d):
    nation = views.nation_month(spark, d)
    first = written(corr.correlation(nation), "nation_corr")
    return graph.second_order_network(first, nation.select("series_id").distinct(), threshold=0.1)[1].select("src", "dst", r("weight"))


@query(f"{EDGES} SELECT a AS node, count(*) AS degree, round(sum(weight), 6) AS strength FROM (SELECT src AS a, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY a")
def degree_strength(spark, d):
    return graph.degree(_edges(spark, d)).select("node", "degree", r("strength"))


@query(f"{EDGES} SELECT (SELECT count(*) FROM ids) AS n_nodes, count(*) AS n_edges, round(min(weight), 6) AS w_min, round(max(weight), 6) AS w_max FROM edges")
def graph_totals(spark, d):
    return graph.totals(_ids(spark, d), _edges(spark, d)).select("n_nodes", "n_edges", r("w_min"), r("w_max"))


@query(f"{EDGES}, ends AS (SELECT src AS i, dst AS j, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) SELECT i, j, round(-weight, 6) AS val FROM ends UNION ALL SELECT i, i, round(sum(weight), 6) FROM ends GROUP BY i")
def laplacian(spark, d):
    return graph.laplacian(_edges(spark, d)).select("i", "j", r("val"))


@query(f"{EDGES}, moved AS (SELECT src + 10 AS src, dst + 10 AS dst, weight FROM edges) SELECT src, dst, round(max(weight), 6) AS weight FROM (SELECT * FROM edges UNION ALL SELECT * FROM moved) GROUP BY 1, 2")
def compose_graphs(spark, d):
    return graph.compose(_edges(spark, d), graph.relabel(_edges(spark, d), 10)).select("src", "dst", r("weight"))


@query(f"{EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE NOT (src < 5)")
def remove_edges(spark, d):
    gone = _edges(spark, d).where("src < 5").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return graph.remove_edges(_edges(spark, d), gone).select("src", "dst", r("weight"))


@query(f"""{EDGES}, asked AS (SELECT DISTINCT c_nationkey AS u, s_nationkey AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT u, v, EXISTS (FROM edges e WHERE e.src = least(u, v) AND e.dst = greatest(u, v)) AS found FROM asked""")
def has_edge(spark, d):
    """Of each two nations between which something was sold, whether the network has them."""
    t = lambda name: views.table(spark, d, name)
    sold = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).join(t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
    sold = sold.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("u")), "c_custkey").join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("v")), "s_suppkey")
    return graph.has_edge(sold.select("u", "v").distinct(), _edges(spark, d)).select("u", "v", "found")


# --- percolation ---------------------------------------------------------------------------------------------------------------

PERCOLATION = f"""{CORR}, edges AS (SELECT i AS src, j AS dst, r AS weight FROM corr WHERE r > 0), {REACH},
ends AS (SELECT min(weight) AS mn, max(weight) AS mx, count(*) AS m FROM inner_edges),
grid AS (SELECT CAST(k AS INT) AS idx, CASE k WHEN 0 THEN mn WHEN 399 THEN mx ELSE power(10.0::DOUBLE, log10(mn) + k * ((log10(mx) - log10(mn)) / 399)) END AS th, m FROM range(400) g(k), ends),
walk(idx, a, b) AS (SELECT idx, node, node FROM grid, giant UNION
  SELECT w.idx, w.a, CASE WHEN e.src = w.b THEN e.dst ELSE e.src END FROM walk w JOIN grid g ON g.idx = w.idx JOIN inner_edges e ON e.weight >= g.th AND (e.src = w.b OR e.dst = w.b)),
pc AS (SELECT idx, a AS node, min(b) AS component FROM walk GROUP BY 1, 2),
ps AS (SELECT idx, component, count(*) AS n FROM pc GROUP BY 1, 2),
top AS (SELECT idx, n, component, row_number() OVER (PARTITION BY idx ORDER BY n DESC, component) AS rn FROM ps),
curve AS (SELECT g.idx, g.th, (SELECT count(*) FROM inner_edges e JOIN pc p ON p.idx = g.idx AND p.node = e.src WHERE e.weight >= g.th AND p.component = t.component) / g.m::DOUBLE AS einf,
  t.n / (SELECT count(*) FROM giant)::DOUBLE AS pinf FROM grid g JOIN top t ON t.idx = g.idx AND t.rn = 1)"""


def _curve(spark, d):
    own, edges, _ = graph.correlation_network(views.nation_month(spark, d))
    return percolation.percolation_curve(own, edges)


@query(f"{PERCOLATION} SELECT idx, round(th, 9) AS th, round(einf, 9) AS einf, round(pinf, 9) AS pinf FROM curve")
def percolation_curve(spark, d):
    return _curve(spark, d).select("idx", r("th", 9), r("einf", 9), r("pinf", 9))


@query(f"""{PERCOLATION}, n AS (SELECT *, th - lag(th) OVER w AS hs, lead(th) OVER w - th AS hd, lag(pinf) OVER w AS fb, lead(pinf) OVER w AS fa FROM curve WINDOW w AS (ORDER BY idx)),
s AS (SELECT idx, th, CASE WHEN hs IS NULL THEN (fa - pinf) / hd WHEN hd IS NULL THEN (pinf - fb) / hs ELSE (hs * hs * fa + (hd * hd - hs * hs) * pinf - hd * hd * fb) / (hs * hd * (hd + hs)) END AS g FROM n)
SELECT round(th, 9) AS th FROM s ORDER BY g, idx LIMIT 1""")
def th_elbow(spark, d):
    return percolation.elbow(_curve(spark, d)).select(r("th", 9))


@query(f"{PERCOLATION} SELECT round(coalesce((SELECT th FROM curve WHERE pinf < 0.95::DOUBLE * (SELECT pinf FROM curve WHERE idx = 0) ORDER BY idx LIMIT 1), (SELECT th FROM curve WHERE idx = 399)), 9) AS th")
def th_fraction(spark, d):
    return percolation.by_fraction(_curve(spark, d)).select(r("th", 9))


@query(f"{PERCOLATION} SELECT round(coalesce((SELECT th FROM curve WHERE pinf >= (SELECT max(pinf) FROM curve) - 0.07::DOUBLE ORDER BY idx DESC LIMIT 1), (SELECT th FROM curve WHERE idx = 0)), 9) AS th")
def th_plateau(spark, d):
    return percolation.by_plateau(_curve(spark, d), tolerance=0.07).select(r("th", 9))


@query(f"{PERCOLATION} SELECT round(th, 9) AS th FROM curve ORDER BY abs(100 * pinf - 80), idx LIMIT 1")
def th_target80(spark, d):
    return percolation.by_target(_curve(spark, d)).select(r("th", 9))


@query(f"""{PERCOLATION}, n AS (SELECT *, lead(th) OVER (ORDER BY idx) AS th2, lead(pinf) OVER (ORDER BY idx) AS p2 FROM curve)
SELECT round(greatest(coalesce((SELECT th + (0.99::DOUBLE - pinf) * (th2 - th) / (p2 - pinf) FROM n WHERE pinf >= 0.99::DOUBLE AND p2 < 0.99::DOUBLE ORDER BY idx LIMIT 1), 0.1::DOUBLE), 0.1::DOUBLE), 9) AS th""")
def th_crossing(spark, d):
    return percolation.by_crossing(_curve(spark, d)).select(r("th", 9))


# --- spectra and diffusion -----------------------------------------------------------------------------------------------------


def _cycle(spark, d):
    """The spectrum of the ring of all suppliers by their keys."""
    ring = views.table(spark, d, "supplier").select("s_suppkey").distinct()
    n = ring.count()
    return ring.select(F.col("s_suppkey").alias("k"), (2 - 2 * F.cos(2 * np.pi * F.col("s_suppkey") / n)).alias("lambda"))


@query("""ring AS (SELECT DISTINCT s_suppkey AS k FROM supplier), lam AS (SELECT 2 - 2 * cos(2 * pi() * k / (SELECT count(*) FROM ring)) AS l FROM ring),
grid AS (SELECT CAST(k AS INT) AS idx, power(10.0::DOUBLE, -2 + k * (7 / 599.0::DOUBLE)) AS tau FROM range(600) g(k)), low AS (SELECT min(l) AS low, count(*) AS n FROM lam),
z AS (SELECT idx, tau, n, sum(exp(-tau * (l - low))) AS z, sum((l - low) * exp(-tau * (l - low))) AS u1, sum((l - low) * (l - low) * exp(-tau * (l - low))) AS u2 FROM lam, low, grid GROUP BY 1, 2, 3),
e AS (SELECT idx, tau, n, 1 - (tau * u1 / z + ln(z)) / ln(n) AS s, u2 / z - (u1 / z) * (u1 / z) AS v FROM z)
SELECT idx, round(tau, 6) AS tau, round(s, 6) + 0.0 AS one_minus_s, round(ln(n) * (lead(s) OVER w - s) / (ln(lead(tau) OVER w) - ln(tau)), 5) + 0.0 AS c, round(v, 6) + 0.0 AS var_l FROM e WINDOW w AS (ORDER BY idx)""")
def entropy_curve(spark, d):
    return spectral.entropy_curve(_cycle(spark, d)).select("idx", r("tau"), r("one_minus_s"), r("c", 5), r("var_l"))


@query()
def laplacian_spectrum(spark, d):
    own, edges, _ = _network(spark, d, DENSE)
    return spectral.laplacian_spectrum(own, edges).select("k", r("lambda"))


DENSE_EDGES = EDGES.replace(f"r >= {THRESHOLD}::DOUBLE", f"r >= {DENSE}::DOUBLE")


@query(f"""{DENSE_EDGES}, s AS (SELECT node, sum(weight) AS s FROM (SELECT src AS node, weight FROM inner_edges UNION ALL SELECT dst, weight FROM inner_edges) GROUP BY 1)
SELECT (SELECT count(*) FROM giant) AS n, round((SELECT sum(s) FROM s), 5) AS first, round((SELECT sum(s * s) FROM s) + 2 * (SELECT sum(weight * weight) FROM inner_edges), 5) AS second""")
def laplacian_moments(spark, d):
    """Of the Laplacian's eigenvalues: their number, sum (its trace) and sum of squares."""
    own, edges, _ = _network(spark, d, DENSE)
    lam = spectral.laplacian_spectrum(own, edges)
    return lam.agg(F.count("*").alias("n"), F.sum("lambda").alias("first"), F.sum(F.col("lambda") ** 2).alias("second")).select("n", r("first", 5), r("second", 5))


@query(f"""{CORR}, p AS (SELECT i, j, r FROM corr UNION ALL SELECT j, i, r FROM corr UNION ALL SELECT DISTINCT series_id, series_id, 1.0::DOUBLE FROM nation_month)
SELECT (SELECT count(*) FROM p WHERE i = j) AS n, (SELECT round(sum(r * r), 5) FROM p) AS second, (SELECT round(sum(a.r * b.r * c.r), 5) FROM p a JOIN p b ON a.j = b.i JOIN p c ON b.j = c.i AND c.j = a.i) AS third""")
def corr_spectrum_moments(spark, d):
    """Of the correlation matrix's eigenvalues: their number (and sum), and sums of squares and cubes."""
    lam = spectral.matrix_spectrum(views.nation_corr(spark, d))
    return lam.agg(F.round(F.sum("lambda"), 6).cast("long").alias("n"), F.sum(F.col("lambda") ** 2).alias("second"), F.sum(F.col("lambda") ** 3).alias("third")).select("n", r("second", 5), r("third", 5))


def _times(a: str, b: str, scale: str = "1") -> str:
    return f"SELECT p.tau, p.i, q.j, sum(p.x * q.x) / {scale} AS x FROM {a} p JOIN {b} q ON p.tau = q.tau AND p.j = q.i GROUP BY 1, 2, 3"


# exp(-tau L) in SQL: a sum of powers at tau / 4096, squared 12 times
RHO = f"""{DENSE_EDGES}, lap AS (SELECT i, j, sum(v) AS v FROM (SELECT src AS i, dst AS j, -weight AS v FROM inner_edges UNION ALL SELECT dst, src, -weight FROM inner_edges UNION ALL SELECT src, src, weight FROM inner_edges UNION ALL SELECT dst, dst, weight FROM inner_edges) GROUP BY 1, 2),
taus(tau) AS (VALUES (0.1::DOUBLE), (1.0::DOUBLE)), l1 AS MATERIALIZED (SELECT tau, i, j, -tau / 4096 * v AS x FROM taus, lap),
l2 AS MATERIALIZED ({_times("l1", "l1", "2")}), l3 AS MATERIALIZED ({_times("l2", "l1", "3")}), l4 AS MATERIALIZED ({_times("l3", "l1", "4")}),
s0 AS MATERIALIZED (SELECT tau, i, j, sum(x) AS x FROM (SELECT tau, node AS i, node AS j, 1.0::DOUBLE AS x FROM taus, giant UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3 UNION ALL FROM l4) GROUP BY 1, 2, 3),
{", ".join(f"s{k + 1} AS MATERIALIZED ({_times(f's{k}', f's{k}')})" for k in range(12))},
z AS (SELECT tau, sum(x) AS z FROM s12 WHERE i = j GROUP BY tau), rho AS (SELECT tau, i, j, x / z AS rho FROM s12 JOIN z USING (tau))"""


@query(f"{RHO} SELECT tau, round(sum(rho) FILTER (i = j), 9) AS trace, round(sum(rho * rho), 9) AS purity, round(min(rho), 9) + 0.0 AS least FROM rho GROUP BY tau")
def rho_trace(spark, d):
    """Of each diffusion density its trace, the sum of its squares and its smallest cell."""
    rho = _rho(spark, d).groupBy("tau").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("rho"))).alias("trace"), F.sum(F.col("rho") * F.col("rho")).alias("purity"), F.min("rho").alias("least"))
    return rho.select("tau", F.round("trace", 9).alias("trace"), r("purity", 9), r("least", 9))


@query()
def network_entropy(spark, d):
    own, edges, _ = _network(spark, d, DENSE)
    return spectral.entropy_curve(spectral.laplacian_spectrum(own, edges)).select("idx", r("tau"), r("one_minus_s"), r("c"), r("var_l"))


def _user_graph(spark, d):
    """Users that share an (event type, hour) more often than a sparse model has it, weighted by how often."""
    links = written(views.user_kind_hours(spark, d), "links")
    edges = bipartite.sparse_pvalues(links).where("p < 0.5").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("common").cast("double").alias("weight"))
    return bipartite.linked(links), edges


@query()
def sparse_entropy(spark, d):
    """The entropy curve of the users' graph by stochastic quadrature, in tiles; tests hold it against the dense one and against that of its edges."""
    links = written(views.user_kind_hours(spark, d), "links")
    return spectral.entropy_curve(sparse.lanczos_of_pairs(bipartite.linked(links), links, 0.5)).select("idx", r("tau"), r("one_minus_s"), r("c"), r("var_l"))


@query(f"{RHO} SELECT tau, i, j, round(rho, 9) + 0.0 AS rho FROM rho")
def sparse_densities(spark, d):
    """Diffusion densities of the nations' network by Chebyshev's expansion, all nodes being sources."""
    own, edges, _ = _network(spark, d, DENSE)
    own, edges = written(own, "nodes"), written(edges, "edges")
    ids = [x.node for x in own.collect()]  # nations
    rows = written(sparse.diffused(own, edges, ids, [0.1, 1.0]), "columns")
    traces = rows.where("i = j").groupBy("tau").agg(F.sum("k").alias("trace"))
    return rows.join(F.broadcast(traces), "tau").select("tau", "i", "j", F.round(F.col("k") / F.col("trace"), 9).alias("rho")).withColumn("rho", F.col("rho") + F.lit(0.0))


@query()
def corr_spectrum(spark, d):
    return spectral.matrix_spectrum(views.nation_corr(spark, d)).select("k", r("lambda"))


@query()
def eigenvalue_histogram(spark, d):
    return stats.histogram(spectral.matrix_spectrum(views.nation_corr(spark, d)), "lambda", 50).select("bin", r("low"), r("high"), r("density"))


@query(f"""{CORR}, e AS (SELECT min(r) AS a, max(r) AS b, count(*) AS n FROM corr), h AS (SELECT CAST(least(floor((r - a) / (b - a) * 10), 9) AS INT) AS bin, count(*) AS c FROM corr, e GROUP BY 1)
SELECT CAST(g.k AS INT) AS bin, round(a + g.k * ((b - a) / 10), 6) + 0.0 AS low, round(a + (g.k + 1) * ((b - a) / 10), 6) + 0.0 AS high, round(coalesce(c, 0) / (n * ((b - a) / 10)), 6) AS density FROM range(10) g(k) CROSS JOIN e LEFT JOIN h ON h.bin = g.k""")
def corr_histogram(spark, d):
    return stats.histogram(views.nation_corr(spark, d), "r").select("bin", r("low"), r("high"), r("density"))


@query(f"""{CORR}, p AS (SELECT (SELECT count(DISTINCT series_id) FROM nation_month) / (SELECT count(DISTINCT t) FROM nation_month)::DOUBLE AS g), x AS (SELECT i, j, round(1 + r, 9) AS x FROM corr)
SELECT i, j, x, round(sqrt(greatest((1 + sqrt(g)) * (1 + sqrt(g)) - x, 0) * greatest(x - (1 - sqrt(g)) * (1 - sqrt(g)), 0)) / (2 * pi() * g * x), 9) + 0.0 AS density, x > (1 + sqrt(g)) * (1 + sqrt(g)) AS beyond FROM x, p""")
def marchenko_pastur(spark, d):
    """What random correlations would have, at the larger eigenvalue 1 + r of each pair of nations."""
    nation = views.nation_month(spark, d)
    values = views.nation_corr(spark, d).select("i", "j", F.round(1 + F.col("r"), 9).alias("x"))
    size = nation.agg(F.countDistinct("series_id").alias("n"), F.countDistinct("t").alias("t")).first()
    return spectral.random_matrix_density(values, size.n, size.t).select("i", "j", "x", r("density", 9), "beyond")


def _rho(spark, d):
    own, edges, _ = _network(spark, d, DENSE)
    return spectral.densities(own, edges, [0.1, 1.0])


@query(f"{RHO} SELECT tau, i, j, round(rho, 9) + 0.0 AS rho FROM rho")
def rho_kernel(spark, d):
    return _rho(spark, d).select("tau", "i", "j", r("rho", 9))


@query(f"{RHO} SELECT tau, i, j, round(log10(1 / rho), 6) + 0.0 AS log_d FROM rho WHERE i < j")
def diffusion_distance(spark, d):
    """Distances by their logarithms, as they go over many powers of ten."""
    return spectral.diffusion_distance(_rho(spark, d)).select("tau", "i", "j", F.log10("d").alias("log_d")).select("tau", "i", "j", r("log_d"))


def _distance(spark, d):
    return spectral.diffusion_distance(_rho(spark, d)).where("tau = 1").select("i", "j", "d")


@query()
def linkage_ward(spark, d):
    return cluster.normalized_linkage(_distance(spark, d), method="ward").select("step", "a", "b", r("height"), "size", r("tmax", 3))


@query()
def linkage_average(spark, d):
    return cluster.normalized_linkage(_distance(spark, d)).select("step", "a", "b", r("height"), "size")


@query()
def linkage_complete(spark, d):
    return cluster.linkage(_distance(spark, d), method="complete").select("step", "a", "b", r("height", 3), "size")


@query(f"""{CORR}, dist AS (SELECT i, j, round(1 - r, 12) AS d FROM corr),
ways AS (SELECT i, j, d FROM dist UNION ALL SELECT j, i, d FROM dist),
levels AS (SELECT DISTINCT d FROM dist),
walk(lv, a, b) AS (SELECT lv.d, s.series_id, s.series_id FROM levels lv, (SELECT DISTINCT series_id FROM nation_month) s UNION SELECT w.lv, w.a, e.j FROM walk w JOIN ways e ON e.i = w.b AND e.d <= w.lv),
k AS (SELECT lv, count(DISTINCT c) AS n FROM (SELECT lv, a, min(b) AS c FROM walk GROUP BY 1, 2) GROUP BY lv)
SELECT round(lv, 6) AS height, lag(n, 1, 25) OVER (ORDER BY lv) - n AS merges FROM k QUALIFY merges > 0""")
def linkage_single(spark, d):
    dist = views.nation_corr(spark, d).select("i", "j", F.round(1 - F.col("r"), 12).alias("d"))
    return cluster.linkage(dist, method="single").groupBy(r("height")).agg(F.count("*").alias("merges"))


@query()
def fclusters(spark, d):
    return cluster.flat_clusters(cluster.normalized_linkage(_distance(spark, d), method="ward"), 0.5)


@query()
def dendrogram(spark, d):
    return cluster.dendrogram(cluster.normalized_linkage(_distance(spark, d), method="ward"), 0.5)


# single linkage in SQL: in each step the nearest two clusters merge; l has each node's cluster
SINGLE = f"""{CORR}, dist AS (SELECT i, j, round(1 - r, 12) AS d FROM corr), leaf AS (SELECT series_id AS node, row_number() OVER (ORDER BY series_id) - 1 AS leaf FROM (SELECT DISTINCT series_id FROM nation_month)),
pr AS (SELECT x.leaf AS i, y.leaf AS j, d FROM dist JOIN leaf x ON x.node = i JOIN leaf y ON y.node = j), size AS (SELECT count(*) AS n FROM leaf),
state(step, l, a, b, height) AS (SELECT -1, (SELECT list(leaf ORDER BY leaf) FROM leaf), NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE
  UNION ALL SELECT step + 1, list_transform(l, lambda c: CASE WHEN c = p.x OR c = p.y THEN len(l) + step + 1 ELSE c END), least(p.x, p.y), greatest(p.x, p.y), p.d
  FROM (SELECT s.step, s.l, arg_min({{'x': s.l[i + 1], 'y': s.l[j + 1], 'd': d}}, d) AS p FROM state s, pr WHERE s.l[i + 1] <> s.l[j + 1] GROUP BY 1, 2)),
links AS (SELECT step, a, b, height, len(list_filter(l, lambda c: c = len(l) + step)) AS size FROM state WHERE step >= 0),
part AS (SELECT a AS id, step AS parent, 0 AS side FROM links UNION ALL SELECT b, step, 1 FROM links),
one AS (SELECT p.id, parent, side, coalesce(k.height, -1) AS height, coalesce(k.size, 1) AS size FROM part p LEFT JOIN links k ON k.step = p.id - (SELECT n FROM size)),
tree(id, height, size, first) AS (SELECT (SELECT n FROM size) + step, height, size, 0::BIGINT FROM links WHERE step = (SELECT max(step) FROM links)
  UNION ALL SELECT o.id, o.height, o.size, t.first + CASE o.side WHEN 1 THEN (SELECT q.size FROM one q WHERE q.parent = o.parent AND q.side = 0) ELSE 0 END FROM tree t JOIN one o ON o.parent = t.id - (SELECT n FROM size)),
cutat AS (SELECT quantile_cont(height, 0.6) AS h FROM links),
roots AS (SELECT t.* FROM tree t LEFT JOIN one o USING (id) LEFT JOIN links up ON up.step = o.parent, cutat WHERE t.height <= h AND (up.height IS NULL OR up.height > h)),
counted AS (SELECT t.id, o.parent, t.size = 1 AS leaf, (SELECT count(*) FROM roots r WHERE r.first >= t.first AND r.first < t.first + t.size) AS n FROM tree t LEFT JOIN one o USING (id), cutat WHERE t.height > h OR t.id IN (SELECT id FROM roots)),
before AS (SELECT id, parent, coalesce((SELECT n FROM counted q WHERE q.parent = c.parent AND q.id <> c.id AND (q.leaf, q.id) < (c.leaf, c.id)), 0) AS ahead FROM counted c),
named(id, label) AS (SELECT id, 1::BIGINT FROM before WHERE parent IS NULL UNION ALL SELECT b.id, n.label + b.ahead FROM named n JOIN before b ON b.parent = n.id - (SELECT n FROM size)),
flat AS (SELECT t.id AS leaf, t.first AS position, label AS cluster, r.size AS members FROM tree t JOIN roots r ON t.size = 1 AND t.first >= r.first AND t.first < r.first + r.size JOIN named m ON m.id = r.id)"""


def _single(spark, d):
    dist = views.nation_corr(spark, d).select("i", "j", F.round(1 - F.col("r"), 12).alias("d"))
    links = written(cluster.linkage(dist, method="single"), "links")
    return links, links.agg(F.percentile("height", 0.6)).first()[0]


@query(f"{SINGLE} SELECT step::INT AS step, a::INT AS a, b::INT AS b, round(height, 9) AS height, size::INT AS size FROM links")
def linkage_single_tree(spark, d):
    return _single(spark, d)[0].select("step", "a", "b", r("height", 9), "size")


@query(f"{SINGLE} SELECT leaf::INT AS leaf, cluster::INT AS cluster FROM flat")
def fclusters_single(spark, d):
    return cluster.flat_clusters(*_single(spark, d))


@query(f"{SINGLE} SELECT position::INT AS position, leaf::INT AS leaf, CASE WHEN members > 1 THEN cluster ELSE 0 END::INT AS cluster FROM flat")
def dendrogram_single(spark, d):
    return cluster.dendrogram(*_single(spark, d))


@query()
def leaf_labels(spark, d):
    return cluster.leaf_labels(_distance(spark, d))


@query()
def multi_tau_partitions(spark, d):
    own, edges, _ = _network(spark, d, DENSE)
    return cluster.multi_tau_partitions(own, edges, [(0.01, 0.4), (None, 0.4), (1.0, 0.4)]).select("stage", r("tau", 9), "node", "community")


@query()
def diffusion_switching(spark, d):
    own, edges, _ = _network(spark, d, DENSE)
    part = cluster.multi_tau_partitions(own, edges, [(0.01, 0.4), (None, 0.4), (1.0, 0.4)])
    return partitions.switching_nodes(part).select("node", F.explode("history").alias("h")).select("node", "h.stage", r("h.tau", 9).alias("tau"), "h.community")


def _heights(spark, d):
    """The prices of each month's orders as heights, from low to high."""
    month = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("int").alias("month")
    orders = views.table(spark, d, "orders").select(month, "o_totalprice", "o_orderkey")
    step = F.row_number().over(Window.partitionBy("month").orderBy("o_totalprice", "o_orderkey")) - 1
    return orders.select("month", step.cast("int").alias("step"), F.col("o_totalprice").alias("height"))


MONTH = ["month"]
HEIGHTS = "o AS (SELECT CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INT) AS month, o_totalprice, o_orderkey FROM orders), h AS (SELECT month, CAST(row_number() OVER (PARTITION BY month ORDER BY o_totalprice, o_orderkey) - 1 AS INT) AS step, o_totalprice AS height FROM o)"
GAPS = f"{HEIGHTS}, g AS (SELECT month, CAST(row_number() OVER (PARTITION BY month ORDER BY step DESC) - 1 AS INT) AS idx, height, lead(height) OVER (PARTITION BY month ORDER BY step DESC) AS lower, max(height) OVER (PARTITION BY month) AS top, min(height) OVER (PARTITION BY month) AS low FROM h), s AS (SELECT month, idx, height AS upper, lower, (log10(height) - log10(lower)) / nullif(log10(top) - log10(low), 0) AS stability FROM g WHERE lower IS NOT NULL)"


@query(f"{GAPS} SELECT month, idx, upper, lower, round(stability, 9) AS stability FROM s")
def gap_stability(spark, d):
    return cluster.gap_stability(_heights(spark, d), MONTH).select("month", "idx", "upper", "lower", r("stability", 9))


@query(f"{GAPS} SELECT month, idx, lower AS threshold, round(lower * 0.9::DOUBLE, 6) AS flat_threshold, round(stability, 9) AS stability FROM s WHERE stability IS NOT NULL QUALIFY row_number() OVER (PARTITION BY month ORDER BY s.stability DESC, idx) = 1")
def optimal_threshold(spark, d):
    return cluster.optimal_threshold(_heights(spark, d), MONTH, scaling=0.9).select("month", "idx", "threshold", r("flat_threshold"), r("stability", 9))


@query(f"{HEIGHTS} SELECT month, round((height + nxt) / 2, 6) AS threshold FROM (SELECT month, height, lead(height) OVER (PARTITION BY month ORDER BY height) AS nxt FROM h) WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY month ORDER BY nxt - height DESC, height) = 1")
def optimal_threshold_std(spark, d):
    return cluster.optimal_threshold_std(_heights(spark, d), MONTH).select("month", r("threshold"))


@query(f"{HEIGHTS}, s AS (SELECT month, height / 1000000 AS height FROM h), e AS (SELECT month, CAST(trunc(log10(min(height))) AS INT) AS lo, CAST(trunc(log10(list_sort(list(height))[-2])) AS INT) AS hi FROM s GROUP BY month) SELECT month, CAST(k AS INT) AS cut, round(power(10.0::DOUBLE, lo + k * (hi - lo) / 7.0::DOUBLE), 9) AS height FROM e, range(8) g(k)")
def cut_grid(spark, d):
    return cluster.cut_grid(_heights(spark, d).withColumn("height", F.col("height") / 1000000), MONTH).select("month", "cut", r("height", 9))


@query(f"{HEIGHTS} SELECT month, 0.5::DOUBLE * height AS tmin FROM h WHERE step = 0")
def axis_lower_bound(spark, d):
    return cluster.lower_bound(_heights(spark, d), MONTH)


# --- partition dynamics --------------------------------------------------------------------------------------------------------


def _history(spark, d):
    return partitions.histories(views.user_week(spark, d))


@query(f"{USERS} SELECT node, stage, tau, community FROM part WHERE node IN (SELECT node FROM part GROUP BY node HAVING count(DISTINCT community) > 1)")
def switching_nodes(spark, d):
    return partitions.switching_nodes(views.user_week(spark, d)).select("node", F.explode("history").alias("h")).select("node", "h.*")


@query(f"""{USERS}, f AS (SELECT node FROM part WHERE stage = 0 AND community = 1),
m AS (SELECT node, tau, community, row_number() OVER (PARTITION BY node ORDER BY stage) AS rn FROM part WHERE community <> 1 AND node IN (FROM f)) SELECT node, tau AS tau_move, community AS new_cluster FROM m WHERE rn = 1""")
def moved_nodes(spark, d):
    return partitions.moved_nodes(_history(spark, d), 1).select("node", "tau_move", "new_cluster")


@query(f"{USERS} SELECT a.node, a.community AS tau_i_cluster, b.community AS tau_f_cluster FROM part a JOIN part b USING (node) WHERE a.stage = 0 AND b.stage = 3 AND a.community = 1 AND b.community <> 1")
def moved_nodes_interval(spark, d):
    return partitions.moved_nodes_interval(_history(spark, d), 1, 0.01, 10.0).select("node", "tau_i_cluster", "tau_f_cluster")


@query(f"{USERS} SELECT stage, community, count(*) AS size FROM part GROUP BY 1, 2")
def cluster_sizes(spark, d):
    return partitions.sizes(views.user_week(spark, d))


FLOWS = f"{USERS}, fl AS (SELECT a.stage, a.community AS source, b.community AS target, count(*) AS count FROM part a JOIN part b ON a.node = b.node AND b.stage = a.stage + 1 GROUP BY 1, 2, 3), ids AS (SELECT stage, community, CAST(row_number() OVER (ORDER BY stage, community) - 1 AS INT) AS id FROM part GROUP BY 1, 2)"


@query(f"{FLOWS} SELECT stage, source, target, count FROM fl")
def flow_counts(spark, d):
    return partitions.flows(views.user_week(spark, d))


@query(f"{FLOWS} SELECT fl.stage, a.id AS source_id, b.id AS target_id, count FROM fl JOIN ids a ON a.stage = fl.stage AND a.community = source JOIN ids b ON b.stage = fl.stage + 1 AND b.community = target")
def sankey_links(spark, d):
    return partitions.sankey(views.user_week(spark, d))[1]


@query(f"{FLOWS} SELECT id, stage, community, 'τ=' || CAST(power(10.0::DOUBLE, stage - 2) AS VARCHAR) || ': Cluster ' || community AS label FROM ids")
def sankey_nodes(spark, d):
    return partitions.sankey(views.user_week(spark, d))[0]


LAYOUT = f"{USERS}, bl AS (SELECT stage, community, count(*) AS size FROM part GROUP BY 1, 2), bb AS (SELECT *, sum(size) OVER (PARTITION BY stage) AS n, sum(size) OVER (PARTITION BY stage ORDER BY community) AS upto FROM bl)"


@query(f"{LAYOUT} SELECT stage, community, size, stage * 1.0::DOUBLE AS x, round((upto - size) / n::DOUBLE, 9) AS bottom, round(upto / n::DOUBLE, 9) AS top FROM bb")
def sankey_layout(spark, d):
    return partitions.sankey_layout(views.user_week(spark, d))[0].select("stage", "community", "size", "x", r("bottom", 9), r("top", 9))


@query(f"""{LAYOUT}, pl AS (SELECT p.node, p.stage, (upto - size + row_number() OVER (PARTITION BY p.stage, p.community ORDER BY p.node) - 1) / n::DOUBLE AS low, 1 / n::DOUBLE AS unit FROM part p JOIN bb USING (stage, community))
SELECT a.node, a.stage, round(a.low, 9) AS low0, round(a.low + a.unit, 9) AS high0, round(b.low, 9) AS low1, round(b.low + b.unit, 9) AS high1 FROM pl a JOIN pl b ON a.node = b.node AND b.stage = a.stage + 1""")
def sankey_ribbons(spark, d):
    return partitions.ribbons(views.user_week(spark, d)).select("node", "stage", r("low0", 9), r("high0", 9), r("low1", 9), r("high1", 9))


@query(f"{USERS} SELECT node, stage, tau, min(node) OVER (PARTITION BY stage, community) AS community FROM part")
def canonical_labels(spark, d):
    return partitions.canonical(views.user_week(spark, d))


@query(f"""{USERS}, so AS (SELECT stage, row_number() OVER (ORDER BY stage) AS o FROM (SELECT DISTINCT stage FROM part)), po AS (SELECT part.*, o FROM part JOIN so USING (stage)),
st AS (SELECT *, o - lag(o) OVER w AS gap FROM po WINDOW w AS (PARTITION BY node ORDER BY stage)), rn AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY stage) AS run FROM st)
SELECT stage, node, community, first_value(community) OVER (PARTITION BY node, run ORDER BY stage) AS colour FROM rn""")
def carried_colours(spark, d):
    return partitions.carried(views.user_week(spark, d))


@query(f"""{USERS}, so AS (SELECT stage, row_number() OVER (ORDER BY stage) AS o FROM (SELECT DISTINCT stage FROM part)), po AS (SELECT node, community, o FROM part JOIN so USING (stage)),
sh AS (SELECT a.o, a.community AS source, b.community AS target, count(*) AS n FROM po a JOIN po b ON a.node = b.node AND b.o = a.o + 1 GROUP BY 1, 2, 3),
bt AS (SELECT o, source, target FROM sh QUALIFY row_number() OVER (PARTITION BY o, target ORDER BY n DESC, source) = 1), bs AS (SELECT o, source, target FROM sh QUALIFY row_number() OVER (PARTITION BY o, source ORDER BY n DESC, target) = 1),
pr AS (SELECT * FROM bt INTERSECT SELECT * FROM bs), cm AS (SELECT DISTINCT o, community FROM po),
ch(o, community, ro, rc) AS (SELECT o, community, o, community FROM cm WHERE NOT EXISTS (FROM pr WHERE pr.o + 1 = cm.o AND target = community) UNION ALL SELECT pr.o + 1, target, ro, rc FROM ch JOIN pr ON pr.o = ch.o AND pr.source = ch.community)
SELECT stage, community, dense_rank() OVER (ORDER BY ro, rc) AS lineage FROM ch JOIN so USING (o)""")
def community_lineages(spark, d):
    return partitions.lineages(views.user_week(spark, d))


# --- validation ----------------------------------------------------------------------------------------------------------------

BH = f"{PVALS}, k AS (SELECT *, row_number() OVER (ORDER BY p, i, j) AS rank, count(*) OVER () AS n FROM pvals), x AS (SELECT max(rank * 0.3::DOUBLE / n) AS threshold FROM k WHERE p <= rank * 0.3::DOUBLE / n)"


@query(f"{BH} SELECT i, j, p, rank, round(threshold, 9) AS threshold, coalesce(p <= threshold, false) AS accepted FROM k, x")
def bh_fdr(spark, d):
    return stats.fdr(views.pair_pvals(spark, d), 0.3).select("i", "j", "p", "rank", r("threshold", 9), "accepted")


@query(f"{PVALS} SELECT i, j, p FROM pvals WHERE p < 0.01::DOUBLE UNION ALL SELECT j, i, p FROM pvals WHERE p < 0.01::DOUBLE")
def pvalue_pairs(spark, d):
    """Of the full matrix, both triangles."""
    upper = views.pair_pvals(spark, d)
    return stats.below(upper.union(upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "p")), 0.01)


@query(f"{BH} SELECT i, j, p, CASE WHEN p <= threshold THEN 1 ELSE 0 END AS valid FROM k, x")
def validation_mask(spark, d):
    p = views.pair_pvals(spark, d)
    return stats.mask(p, stats.fdr(p, 0.3).where("accepted"))


def _model(spark, d):
    return bipartite.configuration_model(views.user_kind_hours(spark, d))


@query(f"{LINKS} SELECT 'a' AS side, a AS node, count(*) AS degree, count(*)::DOUBLE AS expected FROM links GROUP BY a UNION ALL SELECT 'b', b, count(*), count(*)::DOUBLE FROM links GROUP BY b")
def bicm_degrees(spark, d):
    """Expected degrees of the fitted model, which are those observed."""
    model = _model(spark, d)
    both = [bipartite.expected_degrees(model, of).select(F.lit(of).alias("side"), "node", "degree", r("expected")) for of in "ab"]
    return both[0].unionByName(both[1])


@query()
def bicm_pvalues(spark, d):
    """Pairs of users by the (event type, hour) that they share; SQL can't fit the model, and tests do it by brute force."""
    return bipartite.pair_pvalues(_model(spark, d)).select("i", "j", "common", r("p", 9))


SPARSE = f"""{LINKS}, da AS (SELECT a, count(*) AS d FROM links GROUP BY a), tot AS (SELECT sum(k * (k - 1.0::DOUBLE)) AS twice, sum(k)::DOUBLE AS e FROM (SELECT count(*) AS k FROM links GROUP BY b)),
co AS (SELECT x.a AS i, y.a AS j, count(*) AS common FROM links x JOIN links y ON x.b = y.b AND x.a < y.a GROUP BY 1, 2),
me AS (SELECT i, j, common, p.d * q.d * twice / (e * e) AS mean FROM co JOIN da p ON p.a = i JOIN da q ON q.a = j, tot),
sp AS (SELECT i, j, common, round(greatest(0, 1 - (SELECT sum(exp(k * ln(mean) - mean - lgamma(k + 1))) FROM range(0, common) g(k))), 9) + 0.0 AS p FROM me)"""


@query(f"{SPARSE} SELECT i, j, common, p FROM sp")
def sparse_pvalues(spark, d):
    return bipartite.sparse_pvalues(views.user_kind_hours(spark, d)).select("i", "j", "common", r("p", 9))


@query(f"{SPARSE}, n AS (SELECT count(*) * (count(*) - 1) / 2 AS n FROM da), k AS (SELECT *, row_number() OVER (ORDER BY p, i, j) AS rank FROM sp) SELECT i, j, p, rank, round(max(rank * 0.9::DOUBLE / n) FILTER (p <= rank * 0.9::DOUBLE / n) OVER (), 9) AS threshold, coalesce(p <= max(rank * 0.9::DOUBLE / n) FILTER (p <= rank * 0.9::DOUBLE / n) OVER (), false) AS accepted FROM k, n")
def sparse_fdr(spark, d):
    """Validated pairs among all pairs of users, of which those without a common neighbour aren't listed."""
    links = written(views.user_kind_hours(spark, d), "links")
    n = links.select("a").distinct().count()
    return bipartite.sparse_fdr(links, 0.9, n * (n - 1) // 2).select("i", "j", "p", "rank", r("threshold", 9), "accepted")


# --- generators ----------------------------------------------------------------------------------------------------------------

SPEC = ([5, 3, 2, 7, 1], [10, 7, 10, 10, 5])


@query("SELECT 5 AS iterations, 2 + 2 * ((power(4, 5) - 1) / 3)::BIGINT AS n_nodes, power(4, 5)::BIGINT AS n_edges")
def flower_graph(spark, d):
    return graph.totals(*generators.flower(spark, 2, 2, 5)).select(F.lit(5).alias("iterations"), "n_nodes", "n_edges")


@query("""l(h, m, k, s) AS (VALUES (0, 5, 10, 0), (1, 3, 7, 50), (2, 2, 10, 71), (3, 7, 10, 91), (4, 1, 5, 161)),
f AS (SELECT h, k, c, s + c * k AS first FROM l, range(7) g(c) WHERE c < m)
SELECT CAST(first + a AS BIGINT) AS src, CAST(first + b AS BIGINT) AS dst FROM f, range(10) x(a), range(10) y(b) WHERE a < b AND b < k
UNION ALL SELECT CAST(p.s + (f.c % p.m) * p.k AS BIGINT), CAST(f.first AS BIGINT) FROM f JOIN l p ON p.h = f.h - 1""")
def hier_modular_network(spark, d):
    return generators.layered_cliques(spark, *SPEC)[1].select("src", "dst")


@query("SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM range(32) x(a), range(32) y(b) WHERE a < b AND a // 4 = b // 4")
def hmn(spark, d):
    return generators.hierarchical_modular(spark, 3, 4, 1.0, 0.0)[1].select("src", "dst")


@query("SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM range(40) x(a), range(40) y(b) WHERE a < b AND a // 10 = b // 10")
def multiscale_graph(spark, d):
    return generators.multiscale(spark, 4, 10, 1.0, 0.0)[1].select("src", "dst")


@query("SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM range(24) x(a), range(24) y(b) WHERE a < b AND (a // 6 = b // 6 OR a // 8 = b // 8 OR a // 12 = b // 12)")
def hier_multiscale_graph(spark, d):
    return generators.hierarchical_multiscale(spark, (4, 3, 2), 1.0, 1.0)[1].select("src", "dst")


@query()
def pa_network(spark, d):
    return generators.preferential_modular(spark, seed=7)[1]


@query()
def modular_network(spark, d):
    return generators.recursive_modular(spark, 4, 30, 0.3, 0.05, 3, 3, 0.5, 42)[1]


@query()
def brain_ts_mixed(spark, d):
    return generators.mixed_signals(spark, seed=1).select("series_id", "t", r("seconds"), r("value"))


@query()
def brain_ts_modular(spark, d):
    return generators.modular_signals(spark, 3, [4, 3, 2], seed=1).select("series_id", "region", "t", r("value"))


@query()
def brain_ts_band(spark, d):
    return generators.band_limited_signals(spark, 3, 4, seed=1).select("series_id", "region", "t", r("value"))


@query()
def recurrent_signals(spark, d):
    return generators.recurrent_signals(spark, [4, 4], n_samples=100).select("series_id", "t", r("value"))


@query("SELECT CAST(n AS INT) AS node, CAST(CASE WHEN n < 4 THEN 0 WHEN n < 7 THEN 1 ELSE 2 END AS INT) AS region FROM range(9) g(n)")
def region_labels(spark, d):
    return generators.region_labels(spark, 3, [4, 3, 2])


@query("SELECT n_name, 'Hello, ' || n_name || '!' AS greeting FROM nation")
def greeting(spark, d):
    return views.table(spark, d, "nation").select("n_name", columns.greeting(F.col("n_name")).alias("greeting"))


# --- sources and the batch workflow -----------------------------------------------------------------------------------------------

#: The recording that is left out, and the first band's workflow.
ABSENT, WORKFLOW = ("sub-1", "BOLD_RS"), "comparison"


def _folder(spark, d):
    """Recordings of two subjects as text matrices (hours by event types), a file for each contrast but the absent one."""
    path = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"
    wide = series.pivot_wide(views.event_hour(spark, d), range(5)).orderBy("time")
    cells = [[F.round(F.col(f"Signal{i}"), 4) for i in range(5)], [F.round(F.col(f"Signal{i}") * F.col(f"Signal{i}") / 100, 4) for i in range(5)]]
    for subject, own in enumerate(cells):
        lines = ["\t" + "\t".join(map(repr, row)) for row in wide.select(*own).collect()]  # 720 hours of 5 types, whatever the input is
        for contrast, suffix, _ in readers.CONTRASTS:
            if (f"sub-{subject}", contrast) != ABSENT:
                put_text(spark, f"{path}/sub-{subject}/x_{suffix}", "\n".join(lines) + "\n")
    return path


def _recordings(spark, d):
    return readers.subjects(readers.text_matrix(spark, f"{_folder(spark, d)}/sub-*/*.1D"), readers.contrasts(spark))


RECORDED = f"""{EVENTS}, contr(contrast, fs) AS (VALUES {", ".join(f"('{c}', {fs!r}::DOUBLE)" for c, _, fs in readers.CONTRASTS)}),
rec AS (SELECT 'sub-0' AS subject, series_id, t, round(value, 4) AS value FROM event_hour UNION ALL SELECT 'sub-1', series_id, t, round(value * value / 100, 4) FROM event_hour),
have AS (SELECT subject, contrast, fs FROM (VALUES ('sub-0'), ('sub-1')) v(subject), contr WHERE NOT (subject = '{ABSENT[0]}' AND contrast = '{ABSENT[1]}'))"""
HZ = "hz(band, lo, hi) AS (VALUES " + ", ".join(f"('{b}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for w, b, lo, hi in readers.BANDS if w == WORKFLOW) + ")"
BATCH = f"""{RECORDED}, {HZ},
dft AS (SELECT subject, series_id, CAST(f.k AS INT) AS k, CASE WHEN 2 * f.k < 720 THEN f.k ELSE f.k - 720 END / 720.0::DOUBLE AS freq,
  sum(value * cos(2 * pi() * ((f.k * t) % 720) / 720)) AS re, -sum(value * sin(2 * pi() * ((f.k * t) % 720) / 720)) AS im FROM rec CROSS JOIN range(720) f(k) GROUP BY 1, 2, 3, 4),
filt AS (SELECT subject, contrast, band, series_id, CAST(h.t AS INT) AS t, sum(re * cos(2 * pi() * ((k * h.t) % 720) / 720) - im * sin(2 * pi() * ((k * h.t) % 720) / 720)) / 720 AS value
  FROM dft JOIN have USING (subject) JOIN hz ON abs(freq * fs) BETWEEN lo AND hi CROSS JOIN range(720) h(t) GROUP BY 1, 2, 3, 4, 5),
each AS (SELECT a.subject, a.contrast, a.band, a.series_id AS i, b.series_id AS j, corr(a.value, b.value) AS r FROM filt a JOIN filt b ON a.subject = b.subject AND a.contrast = b.contrast AND a.band = b.band AND a.t = b.t AND a.series_id < b.series_id GROUP BY 1, 2, 3, 4, 5)"""


@query(f"{RECORDED} SELECT subject, contrast, round(fs, 9) AS fs_hz, series_id, t, value FROM rec JOIN have USING (subject)")
def source_recordings(spark, d):
    return _recordings(spark, d).select("subject", "contrast", r("fs_hz", 9), "series_id", "t", "value")


LEFT = readers.CONTRASTS[0][0]


@query(f"{RECORDED} SELECT subject, contrast, series_id, count(*) AS n, round(sum(value), 3) AS total FROM rec JOIN have USING (subject) WHERE contrast <> '{LEFT}' GROUP BY 1, 2, 3")
def source_without_contrast(spark, d):
    """The recordings without one contrast."""
    found = readers.subjects(readers.text_matrix(spark, f"{_folder(spark, d)}/sub-*/*.1D"), readers.contrasts(spark, without=[LEFT]))
    return found.groupBy("subject", "contrast", "series_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("subject", "contrast", "series_id", "n", F.round("total", 3).alias("total"))


@query(f"""{RECORDED}, every AS (SELECT DISTINCT subject, contrast FROM rec, contr), there AS (SELECT DISTINCT subject, contrast FROM rec JOIN have USING (subject)) SELECT subject, contrast FROM every EXCEPT SELECT subject, contrast FROM there""")
def source_missing(spark, d):
    return readers.missing(_recordings(spark, d), readers.contrasts(spark))


@query("SELECT 'Nations' AS atlas, n_nationkey AS idx, n_nationkey + 1 AS x, n_regionkey AS y, 2 * n_nationkey AS z, n_name AS label FROM nation")
def source_atlas(spark, d):
    path = f"{shared_dir(spark)}/atlas-{uuid.uuid4().hex}/Nations.xml"
    rows = views.table(spark, d, "nation").collect()  # 25 rows
    labels = "\n".join(f'<label index="{x.n_nationkey}" x="{x.n_nationkey + 1}" y="{x.n_regionkey}" z="{2 * x.n_nationkey}">{x.n_name}</label>' for x in rows)
    put_text(spark, path, f"<atlas><data>\n{labels}\n</data></atlas>")
    return readers.atlas(spark, path)


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN 1000 + s_nationkey ELSE s_nationkey END AS region FROM supplier")
def source_recode(spark, d):
    path = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    put_text(spark, path, "\n".join(str(1000 + k) for k in range(20)) + "\n")
    voxels = views.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("region"))
    return readers.recode(voxels, readers.codes(spark, path))


@query(f"{RECORDED} SELECT subject, contrast FROM have WHERE subject = 'sub-1'")
def store_resume(spark, d):
    """What is left to do once the first subject is stored."""
    found, store = written(_recordings(spark, d), "recordings"), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    readers.save(found.where("subject = 'sub-0'"), store, workflow.KEYS)
    return readers.not_done(found.select(*workflow.KEYS).distinct(), store, workflow.KEYS)


@query(f"{BATCH} SELECT contrast, band, i, j, round(avg(CASE WHEN r < 0 THEN 0 ELSE r END), 5) + 0.0 AS r FROM each GROUP BY 1, 2, 3, 4")
def batch_connectivity(spark, d):
    """All recordings, the second subject in a second call that resumes."""
    found, store = written(_recordings(spark, d), "recordings"), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    args = readers.contrasts(spark), readers.bands(spark, WORKFLOW), store
    workflow.connectivity(found.where("subject = 'sub-0'"), *args)
    return workflow.group_mean(workflow.connectivity(found, *args)).select("contrast", "band", "i", "j", r("r", 5))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation network of nations' monthly orders."""
    return corr_network(spark, sf_dir)


