"""Operators on small frames with known answers, and on the sample-like shapes they meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netscale.operators import cluster, corr, generators, graph, partitions, percolation, series, spectral, stats
from netscale.sources import readers


def frame(spark, values):
    return spark.createDataFrame([(i, t, float(v)) for i, row in enumerate(values) for t, v in enumerate(row)], "series_id int, t int, value double")


def test_correlation_and_constant_series(spark):
    df = frame(spark, [[1, 2, 3], [2, 4.5, 5], [7, 7, 7]])
    got = {(r.i, r.j): r.r for r in corr.correlation(df).collect()}
    assert got == {(0, 1): pytest.approx(0.933256525257), (0, 2): None, (1, 2): None}
    assert got == {(r.i, r.j): r.r for r in corr.correlation_by_sums(df).collect()}


def test_correlation_of_many_series_has_few_blocks(spark, monkeypatch):
    """Blocks grow with a key, so that its series are sent a fixed number of times."""
    monkeypatch.setattr(corr, "BLOCKS", 3)
    rng, sent = np.random.default_rng(2), {}
    mapped = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, *a, **b: sent.setdefault(n, df) and mapped(df, *a, **b))
    for n in (12, 60):
        values = rng.standard_normal((n, 5))
        df = spark.createDataFrame([(i, t, float(v)) for i, row in enumerate(values) for t, v in enumerate(row)], "series_id int, t int, value double")
        got = {(r.i, r.j): r.r for r in corr.correlation(df, rows=4).collect()}
        want = np.corrcoef(values)
        assert len(got) == n * (n - 1) // 2 and all(i < j and abs(r - want[i, j]) < 1e-9 for (i, j), r in got.items())
    assert sent[12].count() == sent[60].count() == 6  # each two blocks of three


def test_correlation_sends_series_nine_times_at_most(spark, monkeypatch):
    """Each of eight blocks goes to nine tasks."""
    sent, mapped = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, *a, **b: sent.append(df) or mapped(df, *a, **b))
    values = np.random.default_rng(3).standard_normal((80, 5))
    df = spark.createDataFrame([(i, t, float(v)) for i, row in enumerate(values) for t, v in enumerate(row)], "series_id int, t int, value double")
    got = {(r.i, r.j): r.r for r in corr.correlation(df, rows=4).collect()}
    want = np.corrcoef(values)
    assert len(got) == 80 * 79 // 2 and all(abs(r - want[i, j]) < 1e-9 for (i, j), r in got.items())
    assert sent[0].count() == 36


def test_clean_order(spark):
    df = spark.createDataFrame([(0, 1, -0.5), (0, 2, float("nan")), (1, 2, 0.3), (1, 3, 0.2), (2, 3, None)], "i int, j int, r double")
    assert [r.r for r in corr.clean(df, threshold=0.3).orderBy("i", "j").collect()] == [0, 0, 0.3, 0, 0]
    assert [r.r for r in corr.clean(df, remove_negative=False, regularize=False).orderBy("i", "j").collect()] == [-0.5, None, 0.3, 0.2, None]


def test_zscore_of_constant_is_null(spark):
    assert {r.value for r in series.zscore(frame(spark, [[2, 2]])).collect()} == {None}


def test_ideal_filter_is_idempotent(spark):
    rng = np.random.default_rng(0)
    bands = spark.createDataFrame([("b", 0.1, 0.3)], "band string, lo double, hi double")
    once = series.ideal_band_filter(frame(spark, rng.normal(size=(2, 40))), bands).drop("band")
    twice = series.ideal_band_filter(once, bands).drop("band")
    a, b = ([r.value for r in x.orderBy("series_id", "t").collect()] for x in (once, twice))
    assert np.allclose(a, b)


def test_peaks_with_plateau(spark):
    got = [r.t for r in series.peaks(frame(spark, [[0, 1, 0, 2, 2, 2, 1, 3]])).orderBy("t").collect()]
    assert got == [1, 4]


EDGES = [(0, 1, 0.9), (1, 2, 0.5), (0, 2, 0.4), (2, 3, 0.1), (5, 5, 1.0)]


def tables(spark):
    return spark.range(6).withColumnRenamed("id", "node"), spark.createDataFrame(EDGES, "src long, dst long, weight double")


def test_giant_and_left_off(spark):
    own, edges, left = graph.giant_and_left_off(*tables(spark))
    assert sorted(r.node for r in own.collect()) == [0, 1, 2, 3] and edges.count() == 4 and sorted(r.node for r in left.collect()) == [4, 5]


def test_ties_go_to_the_smallest_node(spark):
    edges = spark.createDataFrame([(2, 3, 1.0), (0, 1, 1.0)], "src long, dst long, weight double")
    assert sorted(r.node for r in graph.giant_nodes(spark.range(4).withColumnRenamed("id", "node"), edges).collect()) == [0, 1]


def test_directed(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 3, 1.0)], "src long, dst long, weight double")
    nodes = spark.range(5).withColumnRenamed("id", "node")
    assert sorted(r.node for r in graph.giant_nodes(nodes, edges, strongly=True).collect()) == [3, 4]
    assert sorted(r.node for r in graph.giant_nodes(nodes, edges).collect()) == [0, 1, 2]


def test_percolation_by_key(spark):
    nodes, edges = tables(spark)
    keyed = lambda df: df.withColumn("key", F.explode(F.array(F.lit("a"), F.lit("b"))))
    own, inner, _ = graph.giant_and_left_off(keyed(nodes), keyed(edges), ["key"])
    curve = percolation.percolation_curve(own, inner, ["key"])
    assert curve.groupBy("key").count().collect()[0]["count"] == 400
    rows = curve.where("key = 'b'").orderBy("idx").collect()
    assert (rows[0].pinf, rows[0].einf, rows[0].th, rows[-1].th, rows[-1].pinf) == (1, 1, 0.1, 0.9, 0.5)
    assert all(a.pinf >= b.pinf for a, b in zip(rows, rows[1:], strict=False))
    assert {r.key for r in percolation.elbow(curve, ["key"]).collect()} == {"a", "b"}


def test_crossing_without_a_hit_is_the_floor(spark):
    curve = spark.createDataFrame([(0, 0.2, 0.0, 0.5), (1, 0.3, 0.0, 0.4)], "idx int, th double, einf double, pinf double")
    assert percolation.by_crossing(curve).first().th == 0.1
    assert percolation.by_fraction(curve, fraction=0.1).first().th == 0.3


def test_heat_is_the_variance(spark):
    curve = spectral.entropy_curve(spark.range(12).select(F.col("id").alias("k"), (2 - 2 * F.cos(2 * np.pi * F.col("id") / 12)).alias("lambda")))
    rows = [r for r in curve.orderBy("idx").collect() if 0.05 < r.tau < 20]
    assert max(abs(r.c - r.tau**2 * r.var_l) for r in rows) < 0.05


def test_diffusion_distance_and_linkage(spark):
    nodes, edges = tables(spark)
    own, inner, _ = graph.giant_and_left_off(nodes, edges)
    d = spectral.diffusion_distance(spectral.densities(own, inner, [1.0]))
    assert d.count() == 6 and d.where("d <= 0 or d is null").count() == 0
    z = cluster.normalized_linkage(d.drop("tau"), method="ward")
    assert z.agg(F.max("height")).first()[0] == pytest.approx(1 / 1.01)
    assert cluster.flat_clusters(z, 2.0).select("cluster").distinct().count() == 1
    part = cluster.multi_tau_partitions(own, inner, [(0.01, 0.4), (None, 0.4)])
    assert part.count() == 8


def test_thresholds_from_heights(spark):
    z = spark.createDataFrame([(0, 1.0), (1, 2.5), (2, 17 / 3)], "step int, height double")
    best = cluster.optimal_threshold(z).first()
    assert (best.idx, best.threshold) == (1, 1.0) and best.stability == pytest.approx(0.5282, abs=1e-4)
    assert cluster.optimal_threshold_std(z).first().threshold == pytest.approx(4.083333, abs=1e-6)
    assert cluster.gap_stability(z).agg(F.sum("stability")).first()[0] == pytest.approx(1)
    assert cluster.optimal_threshold(z.withColumn("height", F.lit(1.0))).count() == 0


STAGES = [[1, 1, 2, 2], [1, 2, 2, 2], [1, 2, 2, 1]]


def partition(spark):
    taus = (0.01, 0.1, 1.0)
    return spark.createDataFrame([(s, taus[s], n, c) for s, row in enumerate(STAGES) for n, c in enumerate(row)], "stage int, tau double, node long, community int")


def test_moves(spark):
    part = partition(spark)
    assert sorted(r.node for r in partitions.switching_nodes(part).collect()) == [1, 3]
    history = partitions.histories(part)
    assert [(r.node, r.tau_move, r.new_cluster) for r in partitions.moved_nodes(history, 1).collect()] == [(1, 0.1, 2)]
    assert [(r.node, r.tau_f_cluster) for r in partitions.moved_nodes_interval(history, 1).collect()] == [(1, 2)]
    flows = {(r.stage, r.source, r.target, r["count"]) for r in partitions.flows(part).collect()}
    assert flows == {(0, 1, 1, 1), (0, 1, 2, 1), (0, 2, 2, 2), (1, 1, 1, 1), (1, 2, 2, 2), (1, 2, 1, 1)}
    with pytest.raises(ValueError):
        partitions.moved_nodes_interval(history.limit(0), 1)
    assert partitions.moved_nodes_interval(history.limit(0), 1, 0.1, 1.0).count() == 0


def test_fdr(spark):
    p = [0.001, 0.01, 0.02, 0.04, 0.2, 0.9]
    pairs = spark.createDataFrame([(i, j, p.pop(0)) for i in range(4) for j in range(i + 1, 4)], "i int, j int, p double")
    got = stats.fdr(pairs, 0.05).where("accepted").collect()
    assert len(got) == 3 and got[0].threshold == pytest.approx(0.025)
    assert stats.fdr(pairs, 1e-6).where("accepted").count() == 0 and stats.fdr(pairs.limit(0), 0.05).count() == 0


def test_generators(spark):
    count = lambda made: (made[0].count(), made[1].count())
    assert [count(generators.flower(spark, 2, 2, n)) for n in (0, 1, 3)] == [(2, 1), (4, 4), (44, 64)]
    assert count(generators.flower(spark, 1, 2, 1)) == (3, 3) and count(generators.flower(spark, 1, 1, 2)) == (2, 1)
    assert count(generators.layered_cliques(spark, [5, 3, 2, 7, 1], [10, 7, 10, 10, 5])) == (166, 716)
    assert count(generators.hierarchical_modular(spark, 3, 4, 1.0, 0.0)) == (32, 48)
    nodes, edges = generators.multiscale(spark, 4, 25, 0.8, 0.05, seed=3)
    inside = edges.where("floor(src / 25) = floor(dst / 25)").count()
    assert abs(inside / 1200 - 0.8) < 0.05 and abs((edges.count() - inside) / 3750 - 0.05) < 0.02
    assert edges.exceptAll(generators.multiscale(spark, 4, 25, 0.8, 0.05, seed=3)[1]).count() == 0
    nodes, edges = generators.recursive_modular(spark, 4, 30, 0.3, 0.05, 3, 3, 0.5, 42)
    assert nodes.count() == 120 and nodes.select("module").distinct().count() == 36
    assert generators.preferential_modular(spark, 6, 2, 1.0, 2, seed=1)[1].count() >= 4 * 15 + 3
    with pytest.raises(ValueError):
        generators.modular_signals(spark, 3, [1, 2])


def test_readers(spark, tmp_path):
    for sub in ("sub-01", "sub-02"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "x_kwCBF4D.ts.1D").write_text("\t1.5\t0\t2\n\t3 4e1\t5\n")
    table = readers.contrasts(spark, without=["BOLD"])
    found = readers.subjects(readers.text_matrix(spark, f"{tmp_path}/sub-*/*.1D"), table)
    rows = sorted((r.series_id, r.t, r.value) for r in found.where("subject = 'sub-01'").collect())
    assert rows == [(0, 0, 1.5), (0, 1, 3), (1, 0, 0), (1, 1, 40), (2, 0, 2), (2, 1, 5)]
    assert readers.missing(found, table).count() == 4
    keys = ["subject", "contrast"]
    assert readers.not_done(found.select(*keys).distinct(), f"{tmp_path}/out", keys).count() == 2
    readers.save(found.where("subject = 'sub-01'"), f"{tmp_path}/out", keys)
    assert [r.subject for r in readers.not_done(found.select(*keys).distinct(), f"{tmp_path}/out", keys).collect()] == ["sub-02"]
    (tmp_path / "A.xml").write_text('<atlas><data>\n<label index="0" x="48" y="94" z="35">Frontal Pole</label>\n<label index="1" x="2" y="3" z="4">B</label></data></atlas>')
    assert [(r.idx, r.x, r.label) for r in readers.atlas(spark, f"{tmp_path}/A.xml").orderBy("idx").collect()] == [(0, 48, "Frontal Pole"), (1, 2, "B")]
    (tmp_path / "codes").write_text("2\n3\n")
    voxels = spark.createDataFrame([(0, 1), (1, 9)], "x int, region int")
    assert [r.region for r in readers.recode(voxels, readers.codes(spark, f"{tmp_path}/codes")).orderBy("x").collect()] == [3, 9]


def test_linkage_by_definition(spark):
    """Merges by brute force over all members, for average, complete and single; missing and null pairs come last."""
    import random

    import numpy as np

    from netscale.operators import cluster

    rng = random.Random(3)
    n, d = 9, {}
    for i in range(n):
        for j in range(i + 1, n):
            d[i, j] = rng.uniform(1, 5)
    rows = spark.createDataFrame([(i, j, x) for (i, j), x in d.items()], "i int, j int, d double")
    for method, of in (("average", np.mean), ("complete", max), ("single", min)):
        groups, want = [{i} for i in range(n)], []
        while len(groups) > 1:
            best = min((float(of([d[min(x, y), max(x, y)] for x in a for y in b])), k, m) for k, a in enumerate(groups) for m, b in enumerate(groups) if k < m)
            want.append(best[0])
            groups = [g for k, g in enumerate(groups) if k not in best[1:]] + [groups[best[1]] | groups[best[2]]]
        assert [x.height for x in cluster.linkage(rows, method=method).orderBy("step").collect()] == pytest.approx(want)
    part = spark.createDataFrame([(0, 1, 1.0), (2, 3, 2.0), (0, 2, None)], "i int, j int, d double")
    assert [x.height for x in cluster.linkage(part, method="single").orderBy("step").collect()] == [1.0, 2.0, 20.0]


def test_one_odd_key_spoils_no_other(spark):
    from netscale.operators import cluster, percolation, series

    rows = spark.createDataFrame([("a", 0, t, float(t % 7)) for t in range(60)] + [("b", 0, t, 1.0) for t in range(5)], "k string, series_id int, t int, value double")
    out = series.butterworth(rows, 0.1, 0.2, keys=["k"]).groupBy("k").agg({"value": "count"}).collect()
    assert dict(map(tuple, out)) == {"a": 60, "b": 0}
    nodes = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1)], "k string, node long")
    edges = spark.createDataFrame([("a", 0, 1, 0.5), ("b", 0, 1, -0.5)], "k string, src long, dst long, weight double")
    curve = percolation.percolation_curve(nodes, edges, ["k"], 4).collect()
    assert all((x.th is None) == (x.k == "b") for x in curve) and len(curve) == 8
    heights = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 10.0), ("a", 2, 100.0), ("b", 0, 5.0), ("c", 0, 0.0), ("c", 1, 1.0)], "k string, step int, height double")
    grid = {k: [x.height for x in cluster.cut_grid(heights, ["k"], 2).where(f"k = '{k}'").orderBy("cut").collect()] for k in "abc"}
    assert grid == {"a": [1.0, 10.0], "b": [None, None], "c": [None, None]}


def test_ranks_without_keys_are_those_with_one(spark):
    rows = [(i, j, ((i * 7 + j * 13) % 17) / 100) for i in range(30) for j in range(i + 1, 30)]
    one = spark.createDataFrame(rows, "i int, j int, p double")
    other = stats.fdr(one.withColumn("k", F.lit(1)), 0.05, ["k"]).drop("k")
    assert sorted(map(tuple, stats.fdr(one, 0.05).collect())) == sorted(map(tuple, other.collect()))


def test_components_of_a_large_graph(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60) if i % 13 != 12] + [(5, 5), (0, 1)], "src int, dst int").withColumn("weight", F.lit(1.0))
    nodes = spark.createDataFrame([(i,) for i in range(70)], "node int")
    assert sorted(map(tuple, graph.components_of_large(nodes, edges).collect())) == sorted(map(tuple, graph.components(nodes, edges).collect()))
    assert graph.components_of_large(nodes, edges.limit(0)).where("node != component").count() == 0


def test_attachment_prefers_the_sure_edge(spark):
    """Without edges inside modules, the first sure edge has all the degree, so all further targets are its ends."""
    for seed in range(6):
        nodes, edges = generators.preferential_modular(spark, 8, 1, 0.0, 3, seed=seed)
        rows = [(x.src, x.dst) for x in edges.collect()]
        ends = [v for v in range(16) if sum(v in x for x in rows) == len(rows)] or sorted({v for x in rows for v in x}, key=lambda v: -sum(v in x for x in rows))[:2]
        assert all(set(x) & set(ends) for x in rows)


def test_distance_of_another_density(spark):
    nodes, edges = spark.createDataFrame([(0,), (1,), (2,)], "node int"), spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src int, dst int, weight double")
    own = spectral.densities(nodes, edges, [2.0], density=lambda tau, m: np.abs(m) / tau)
    assert {(r.i, r.j): r.d for r in spectral.diffusion_distance(own).collect()} == {(0, 1): 2.0, (1, 2): 2.0, (0, 2): None}


def test_pvalues_of_correlations(spark):
    """Against the integral of (1 - x^2)^((n - 4) / 2), for even and odd numbers of samples."""
    rows = [(n, r) for n in (3, 4, 5, 6, 9, 30, 81) for r in (-0.9, -0.2, 0.0, 0.35, 0.99, 1.0)] + [(2, 0.5)]
    df = spark.createDataFrame(rows, "n int, r double").withColumn("p", stats.correlation_pvalue(F.col("r"), F.col("n")))
    angle = np.linspace(0, np.pi / 2, 200_001)  # x = sin(angle)
    for x in df.collect():
        if x.n < 3:
            assert x.p is None
            continue
        f = np.cos(angle) ** (x.n - 3)
        whole = np.r_[0, np.cumsum((f[1:] + f[:-1]) / 2)]
        assert x.p == pytest.approx(1 - np.interp(np.arcsin(abs(x.r)), angle, whole) / whole[-1], abs=1e-7)


def test_fdr_of_pairs_that_are_not_all_listed(spark):
    rows = [(i, j, ((i * 7 + j * 13) % 17 + 1) / 400) for i in range(20) for j in range(i + 1, 20)]
    every = spark.createDataFrame(rows + [(100 + i, 200, 1.0) for i in range(300)], "i int, j int, p double")
    want = {(r.i, r.j): (r.rank, r.threshold, r.accepted) for r in stats.fdr(every, 0.05).where("p < 1").collect()}
    got = {(r.i, r.j): (r.rank, r.threshold, r.accepted) for r in stats.fdr(spark.createDataFrame(rows, "i int, j int, p double"), 0.05, total=len(rows) + 300).collect()}
    assert got == want


def test_ranks_of_many_ties(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("double").alias("p"), (59_999 - F.col("id")).alias("i")).cache()
    ranked, n = stats.ranked_by(rows, ["p", "i"], ranges=16, sample=2000)
    got = ranked.orderBy("rank").collect()
    assert n == 60_000 and [r.rank for r in got] == list(range(1, n + 1)) and [(r.p, r.i) for r in got] == sorted((r.p, r.i) for r in got)
    sizes = stats.ranked_by(rows, ["p", "i"], ranges=16, sample=2000)[0]
    assert sizes.columns == ["p", "i", "rank"]
