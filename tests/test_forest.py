"""Forests, merge trees, linkages, cuts, percolation and components as tables, against kernels and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netscale.functions import kernels
from netscale.operators import cluster, forest, graph, percolation


def frame(spark, rows, keys=("key",)):
    return spark.createDataFrame(rows, ", ".join([f"{k} string" for k in keys] + ["i int", "j int", "d double"]))


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(5)
    out = {}
    for key, n in {"a": 2, "b": 9, "c": 23, "chain": 14, "star": 12}.items():
        m = rng.uniform(1, 5, (n, n))
        if key == "chain":
            m += 50
            for i in range(n - 1):
                m[i, i + 1] = 1 + i + rng.random() / 10
        if key == "star":
            m += 50
            m[0, 1:] = 1 + rng.permutation(n - 1) + rng.random(n - 1) / 10
        m = np.triu(m, 1)
        out[key] = m + m.T
    return out


def rows_of(matrices):
    return [(key, 3 * int(i), 3 * int(j), float(m[i, j])) for key, m in matrices.items() for i, j in zip(*np.triu_indices(len(m), 1), strict=True)]


@pytest.mark.parametrize("method", ["single", "average", "complete", "ward"])
def test_linkage_as_tables(spark, matrices, method):
    rows = frame(spark, rows_of(matrices))
    got = cluster.linkage(rows, ["key"], method, dense=0).orderBy("key", "step").collect()
    one = cluster.linkage(rows.where("key = 'c'").drop("key"), (), method, dense=0).orderBy("step").collect()
    for key, m in matrices.items():
        want = kernels.linkage(m, method)
        for found in ([r for r in got if r.key == key], *([one] if key == "c" else [])):
            assert [(r.a, r.b, r.size) for r in found] == [(int(a), int(b), int(s)) for a, b, _, s in want]
            assert np.allclose([r.height for r in found], want[:, 2], rtol=1e-9)
    mixed = cluster.linkage(rows, ["key"], method, dense=10).orderBy("key", "step").collect()
    assert [(r.key, r.step, r.a, r.b, r.size) for r in mixed] == [(r.key, r.step, r.a, r.b, r.size) for r in got]


@pytest.mark.parametrize("method", ["single", "average"])
def test_missing_distances_merge_last(spark, method):
    part = frame(spark, [("x", 0, 1, 1.0), ("x", 2, 3, 2.0), ("x", 0, 2, None), ("y", 5, 6, None), ("z", 0, 1, float("nan")), ("z", 1, 2, 4.0)])
    want = {"x": [1.0, 2.0, 20.0], "y": [1.0], "z": [4.0, 40.0]}
    for dense in (0, 100):
        got = cluster.linkage(part, ["key"], method, dense=dense).orderBy("step").collect()
        assert {k: [r.height for r in got if r.key == k] for k in want} == want


def test_cuts_without_a_walk(spark, matrices):
    links = cluster.linkage(frame(spark, rows_of(matrices)), ["key"], "average").cache()
    tables = {k: links.where(f"key = '{k}'").orderBy("step").select("a", "b", "height", "size").toPandas().to_numpy(float) for k in matrices}
    for height in (0.0, 2.2, 2.9, 4.0, 54.0, 99.0):
        flat = cluster.flat_clusters(links, height, ["key"]).collect()
        drawn = cluster.dendrogram(links, height, ["key"]).collect()
        for key, z in tables.items():
            label = kernels.flat_clusters(z, height)
            assert {r.leaf: r.cluster for r in flat if r.key == key} == dict(enumerate(label.tolist()))
            order = [r.leaf for r in sorted((r for r in drawn if r.key == key), key=lambda r: r.position)]
            assert order == kernels.leaves(z)
            count = np.bincount(label)
            assert {r.leaf: r.cluster for r in drawn if r.key == key} == {i: int(c) if count[c] > 1 else 0 for i, c in enumerate(label)}
    alone = cluster.flat_clusters(links.where("key = 'c'").drop("key"), 2.9).collect()
    assert {r.leaf: r.cluster for r in alone} == dict(enumerate(kernels.flat_clusters(tables["c"], 2.9).tolist()))


def test_running_sums_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "SMALL", 100)
    rows = spark.range(30_000).select((F.pmod(F.xxhash64("id"), F.lit(7)) == 0).cast("long").alias("v"), (29_999 - F.col("id")).alias("o")).cache()
    got = forest.running(rows, ["o"], "v").orderBy("o").collect()
    assert [r.rank for r in got] == list(range(1, 30_001)) and [r.upto for r in got] == np.cumsum([r.v for r in got]).tolist()


@pytest.mark.parametrize("levels", [0, 3])
def test_percolation_as_the_sweep(spark, levels):
    rng = np.random.default_rng(levels)
    rows, nodes, want = [], [], {}
    for key, n, m in (("a", 30, 60), ("b", 40, 30), ("c", 2, 1), ("d", 25, 300)):
        pairs = rng.permutation(n * (n - 1) // 2)[:m]
        src, dst = (x[pairs] for x in np.triu_indices(n, 1))
        w = rng.random(m) + 0.01 if not levels else rng.integers(1, levels + 1, m) / levels
        rows += [(key, int(a), int(b), float(x)) for a, b, x in zip(src, dst, w, strict=True)]
        nodes += [(key, i) for i in range(n)]
        grid = 10 ** (np.log10(w.min()) + np.arange(40) * ((np.log10(w.max()) - np.log10(w.min())) / 39))
        grid[0], grid[-1] = w.min(), w.max()
        grid = np.clip(grid, w.min(), w.max())
        want[key] = kernels.percolation(n, src, dst, w, grid)
    edges, nodes = spark.createDataFrame(rows, "key string, src int, dst int, weight double"), spark.createDataFrame(nodes, "key string, node int")
    got = percolation.percolation_curve(nodes, edges, ["key"], 40).orderBy("key", "idx").collect()
    alone = percolation.percolation_curve(nodes.where("key = 'b'").drop("key"), edges.where("key = 'b'").drop("key"), (), 40).orderBy("idx").collect()
    for key, (e, p) in want.items():
        for found in ([r for r in got if r.key == key], *([alone] if key == "b" else [])):
            assert np.allclose([r.einf for r in found], e) and np.allclose([r.pinf for r in found], p)


def test_strong_components_of_random_graphs(spark):
    rng = np.random.default_rng(6)
    rows, nodes, want = [], [], {}
    for key in range(200):
        n, m = int(rng.integers(1, 12)), int(rng.integers(0, 25))
        reach = np.eye(n, dtype=bool)
        for a, b in rng.integers(0, n, (m, 2)):
            rows.append((key, int(a), int(b), 1.0))
            reach[a, b] = True
        for c in range(n):
            reach |= reach[:, c : c + 1] & reach[c]
        both = reach & reach.T
        nodes += [(key, i) for i in range(n)]
        want |= {(key, i): int(np.flatnonzero(both[i])[0]) for i in range(n)}
    edges, nodes = spark.createDataFrame(rows, "key long, src int, dst int, weight double"), spark.createDataFrame(nodes, "key long, node int")
    assert {(r.key, r.node): r.component for r in graph.components(nodes, edges, ["key"], strongly=True).collect()} == want
    weak = {(r.key, r.node): r.component for r in graph.components(nodes, edges, ["key"]).collect()}
    assert all(weak[k] <= c for k, c in want.items()) and all(weak[k, a] == weak[k, b] for k, a, b, _ in rows)
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)] + [(12, 10, 1.0), (30, 28, 1.0)], "src int, dst int, weight double")
    got = {r.node: r.component for r in graph.components(path.select(F.col("src").alias("node")), path, strongly=True).collect()}
    assert {i: c for i, c in got.items() if i != c} == {11: 10, 12: 10, 29: 28, 30: 28}
