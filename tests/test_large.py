"""Operators for what is too large for a task, against the dense or whole ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netscale.functions import kernels
from netscale.operators import longseries, partitions, series, sparse, spectral


def network(spark, n, degree, seed=0):
    rng = np.random.default_rng(seed)
    pairs = {(i, i + 1) for i in range(n - 1)}
    while len(pairs) < n * degree // 2:
        a, b = sorted(rng.integers(0, n, 2).tolist())
        if a != b:
            pairs.add((a, b))
    src, dst = np.array(sorted(pairs)).T
    weight = rng.uniform(0.2, 1, len(src))
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node int")
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(src, dst, weight, strict=True)], "src int, dst int, weight double")
    return nodes, edges, kernels.dense_laplacian(np.arange(n), src, dst, weight)


def test_entropy_of_a_sparse_graph(spark):
    nodes, edges, dense = network(spark, 600, 6)
    found = sparse.lanczos_spectrum(nodes, edges, probes=40, steps=14).cache()
    lam = np.linalg.eigvalsh(dense)
    assert found.agg(F.sum("weight")).first()[0] == pytest.approx(600) and found.agg(F.max("lambda")).first()[0] <= lam[-1] + 1e-6
    a = spectral.entropy_curve(found, steps=60).orderBy("idx").collect()
    b = spectral.entropy_curve(spark.createDataFrame([(float(x),) for x in np.maximum(lam, 0)], "lambda double"), steps=60).orderBy("idx").collect()
    assert max(abs(x.one_minus_s - y.one_minus_s) for x, y in zip(a, b, strict=True)) < 0.01
    two = nodes.union(nodes.select(F.col("node") + 1000)), edges  # 600 nodes alone
    assert sparse.lanczos_spectrum(*two, probes=2, steps=3).where("lambda = 0").agg(F.max("weight")).first()[0] == 601
    assert sparse.lanczos_spectrum(nodes.limit(0), edges.limit(0)).count() == 0


def test_diffusion_from_chosen_nodes(spark):
    nodes, edges, dense = network(spark, 40, 5, 1)
    lam, vec = np.linalg.eigh(dense)
    got = sparse.diffused(nodes, edges, [0, 7, 99], [0.5, 0.01]).collect() + sparse.diffused(nodes, edges, [1, 39], [0.02], block=1).collect()
    assert len(got) == 2 * 2 * 40 + 2 * 40
    for tau in (0.01, 0.02, 0.5):
        want = (vec * np.exp(-tau * lam)) @ vec.T
        assert max(abs(r.k - want[r.i, r.j]) for r in got if r.tau == tau) < 1e-12
    traces = sparse.partition_sums(spark.createDataFrame([(float(x),) for x in lam], "lambda double"), [0.05])
    rho = {(r.i, r.j): r.rho for r in sparse.densities_from(nodes, edges, [3], [0.05], traces).collect()}
    want = kernels.density(0.05, dense)
    assert max(abs(x - want[i, j]) for (i, j), x in rho.items()) < 1e-9
    assert sparse.diffused(nodes, edges, [], [1.0]).count() == 0


def rows_of(spark, series_):
    rows = [(key, i, 5 * t + 3, float(v)) for (key, i), x in series_.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "key string, series_id int, t int, value double").repartition(4)


@pytest.mark.parametrize("segment", [10_000, 400, 22])
def test_filter_by_segments(spark, segment):
    rng = np.random.default_rng(2)
    own = {("a", 1): rng.normal(size=1000).cumsum(), ("a", 2): rng.normal(size=333), ("b", 1): np.ones(20), ("b", 2): rng.normal(size=28)}
    b, a = kernels.butter_bandpass(0.05, 0.2)
    got = longseries.filtered(rows_of(spark, own), b, a, ["key"], segment).orderBy("t").collect()
    for (key, i), x in own.items():
        mine = [r.value for r in got if (r.key, r.series_id) == (key, i)]
        if len(x) <= 27:
            assert mine == [None] * len(x)
        else:
            assert np.abs(np.array(mine) - kernels.filtfilt(b, a, x)[0]).max() < 1e-9


def test_transform_in_four_steps(spark):
    rng = np.random.default_rng(3)
    own = {("a", 1): rng.normal(size=720), ("a", 2): rng.normal(size=127), ("b", 1): rng.normal(size=1), ("b", 2): rng.normal(size=64), ("b", 3): rng.normal(size=2 * 101)}
    df = rows_of(spark, own)
    for even in (4,):
        got = longseries.transformed(df, ["key"], even).orderBy("k").collect()
        for (key, i), x in own.items():
            mine = np.array([r.re + 1j * r.im for r in got if (r.key, r.series_id) == (key, i)])
            assert np.abs(mine - np.fft.fft(x)).max() < 1e-9 * max(1, np.abs(x).sum())
    mixed = series.dft(df, ["key"], whole=200).orderBy("k").collect()
    whole = series.dft(df, ["key"]).orderBy("k").collect()
    key = lambda r: (r.key, r.series_id, r.k)
    for p, q in zip(sorted(mixed, key=key), sorted(whole, key=key), strict=True):
        assert key(p) == key(q) and p.n == q.n and p.freq == q.freq and abs(p.re - q.re) < 1e-9 and abs(p.im - q.im) < 1e-9
    parts = series.butterworth(df, 0.05, 0.2, keys=["key"], whole=200).groupBy("key", "series_id").agg(F.count("value").alias("n")).collect()
    assert {(r.key, r.series_id): r.n for r in parts} == {("a", 1): 720, ("a", 2): 127, ("b", 1): 0, ("b", 2): 64, ("b", 3): 202}


def test_lineages_and_colours(spark):
    stages = {0: {1: 1, 2: 1, 3: 1, 4: 2, 5: 2}, 1: {1: 7, 2: 7, 3: 9, 4: 9, 5: 9}, 3: {1: 1, 2: 2, 3: 2, 4: 2, 6: 5}, 4: {2: 2, 5: 4, 6: 4, 7: 8}}
    part = spark.createDataFrame([(s, n, c) for s, own in stages.items() for n, c in own.items()], "stage int, node int, community int")
    got = {(r.stage, r.community): r.lineage for r in partitions.lineages(part).collect()}
    # 1 goes on in 7, 2 in 9; then 9 in 2, 7 in 1; 5 is new; then 2 in 2, 5 in 4; 8 is new
    assert got == {(0, 1): 1, (0, 2): 2, (1, 7): 1, (1, 9): 2, (3, 1): 1, (3, 2): 2, (3, 5): 3, (4, 2): 2, (4, 4): 3, (4, 8): 4}
    colour = {(r.stage, r.node): r.colour for r in partitions.carried(part).collect()}
    assert colour == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 2, (0, 5): 2, (1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 2, (3, 1): 1, (3, 2): 1, (3, 3): 1, (3, 4): 2, (3, 6): 5, (4, 2): 1, (4, 5): 4, (4, 6): 5, (4, 7): 8}
