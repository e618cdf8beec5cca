"""Synthetic networks and signals. Networks come as (nodes, edges); random ones are drawn per row with seeded columns, or in one task
where each draw depends on those before it. Counts and structure follow the parameters; streams of random numbers are our own."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netscale.functions import kernels

EDGES = "src long, dst long, weight double"


def _draw(seed: int | None, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only, whatever the partitioning."""
    return (F.xxhash64(F.lit(0 if seed is None else int(seed)), *parts).bitwiseAND(F.lit(2**52 - 1))).cast("double") / float(2**52)


def _normal(seed: int | None, *parts: Column | str) -> Column:
    u, v = _draw(seed, F.lit("u"), *parts), _draw(seed, F.lit("v"), *parts)
    return F.sqrt(-2 * F.ln(F.lit(1.0) - u)) * F.cos(2 * np.pi * v)


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """All (src, dst) with src < dst < n, dealt by src."""
    return spark.range(n).select(F.col("id").alias("src")).where(F.col("src") < n - 1).select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1).cast("long"))).alias("dst"))


def _nodes(spark: SparkSession, n: int, **columns: Column) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"), *[c.alias(k) for k, c in columns.items()])


def _edges(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", F.lit(1.0).alias("weight"))


def hierarchical_modular(spark: SparkSession, levels: int = 3, base_size: int = 4, p_in: float = 1.0, p_out: float = 0.05, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """2^levels modules of base_size nodes: p_in inside a module, p_out (the same at every level) between sibling groups."""
    n = 2**levels * base_size
    module = lambda c: F.floor(F.col(c) / base_size)
    p = F.when(module("src") == module("dst"), p_in).otherwise(p_out)
    return _nodes(spark, n, module=F.floor(F.col("id") / base_size)), _edges(_pairs(spark, n).where(_draw(seed, "src", "dst") < p))


def flower(spark: SparkSession, u: int = 2, v: int = 2, iterations: int = 3) -> tuple[DataFrame, DataFrame]:
    """Each edge gives way to two paths of u and v edges between its ends, again and again, from one edge. Growth is by rows."""
    if u < 1 or v < 1:
        raise ValueError("paths have an edge at least")
    edges, n, m = spark.createDataFrame([(0, 1)], "src long, dst long"), 2, 1
    for _ in range(iterations):
        numbered = edges.select(F.row_number().over(_by("src", "dst")).alias("e"), "src", "dst") if m <= 100_000 else _dense(edges)
        parts = []
        for base, length in ((0, u), (u - 1, v)):
            first = F.lit(n) + (F.col("e") - 1) * (u + v - 2) + base  # of the path's inner nodes
            step = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("s")
            rows = numbered.select("src", "dst", first.alias("f"), step)
            a = F.when(F.col("s") == 0, F.col("src")).otherwise(F.col("f") + F.col("s") - 1)
            b = F.when(F.col("s") == length - 1, F.col("dst")).otherwise(F.col("f") + F.col("s"))
            parts.append(rows.select(F.least(a, b).cast("long").alias("src"), F.greatest(a, b).cast("long").alias("dst")))
        edges = parts[0].unionByName(parts[1]).distinct()
        n, m = n + m * (u + v - 2), m * (u + v) if u > 1 and v > 1 else edges.count()
    return _nodes(spark, n), _edges(edges)


def _by(*columns: str):
    from pyspark.sql.window import Window

    return Window.orderBy(*columns)


def _dense(edges: DataFrame) -> DataFrame:
    """Edges numbered from 1 without one task for all: counts of range partitions give offsets."""
    ranged = edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").withColumn("p", F.spark_partition_id()).persist()
    counts = {r.p: r["count"] for r in ranged.groupBy("p").count().collect()}
    offset, total = {}, 0
    for p in sorted(counts):
        offset[p], total = total, total + counts[p]
    from pyspark.sql.window import Window

    at = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])
    return ranged.withColumn("e", F.row_number().over(Window.partitionBy("p").orderBy("src", "dst")) + at[F.col("p")]).select("e", "src", "dst")


def multiscale(spark: SparkSession, n_clusters: int = 4, cluster_size: int = 10, p_in: float = 0.8, p_out: float = 0.05, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Planted partition: p_in inside clusters, p_out between any two."""
    own = lambda c: F.floor(F.col(c) / cluster_size)
    p = F.when(own("src") == own("dst"), p_in).otherwise(p_out)
    n = n_clusters * cluster_size
    return _nodes(spark, n, cluster=F.floor(F.col("id") / cluster_size)), _edges(_pairs(spark, n).where(_draw(seed, "src", "dst") < p))


def hierarchical_multiscale(spark: SparkSession, levels: Sequence[int] = (4, 3, 2), p_in: float = 0.9, p_decay: float = 0.4, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every level cuts all nodes into its number of even blocks and links nodes of a block with p_in * p_decay^level."""
    n = int(np.prod(levels))
    hit = F.lit(False)
    for level, groups in enumerate(levels):
        size = n // groups
        same = F.floor(F.col("src") / size) == F.floor(F.col("dst") / size)
        hit = hit | (same & (_draw(seed, F.lit(level), "src", "dst") < p_in * p_decay**level))
    return _nodes(spark, n), _edges(_pairs(spark, n).where(hit))


def layered_cliques(spark: SparkSession, modules: Sequence[int], sizes: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Layer h has modules[h] cliques of sizes[h] nodes; a clique's first node is linked to that of clique (m mod count) of the layer above."""
    if len(modules) != len(sizes):
        raise ValueError("one size for each layer")
    starts = np.r_[0, np.cumsum([m * k for m, k in zip(modules, sizes, strict=True)])].tolist()
    layers = spark.createDataFrame([(h, m, k, starts[h], modules[h - 1] if h else 0, sizes[h - 1] if h else 0, starts[h - 1] if h else 0) for h, (m, k) in enumerate(zip(modules, sizes, strict=True))], "hierarchy long, m long, k long, start long, m0 long, k0 long, start0 long")
    each = layers.where("m > 0 and k > 0").withColumn("module", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).withColumn("first", F.col("start") + F.col("module") * F.col("k"))
    inside = F.sequence(F.lit(0).cast("long"), F.col("k") - 1)
    nodes = each.select("first", "hierarchy", "module", F.explode(inside).alias("a")).select((F.col("first") + F.col("a")).alias("node"), "hierarchy", "module")
    cliques = each.where("k > 1").select("first", "k", F.explode(inside).alias("a")).where("a < k - 1").select("first", "a", F.explode(F.sequence(F.col("a") + 1, F.col("k") - 1)).alias("b"))
    ups = each.where("hierarchy > 0 and m0 > 0").select((F.col("start0") + F.pmod("module", "m0") * F.col("k0")).alias("src"), F.col("first").alias("dst"))
    return nodes, _edges(cliques.select((F.col("first") + F.col("a")).alias("src"), (F.col("first") + F.col("b")).alias("dst")).unionByName(ups))


def _frame(spark: SparkSession, make, schema: str, **args) -> DataFrame:
    """make(**args) -> frame, run in one task on an executor."""
    return spark.range(1).groupBy("id").applyInPandas(lambda _: make(**args), schema)


def _as_edges(pairs: set[tuple[int, int]]) -> pd.DataFrame:
    rows = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return pd.DataFrame({"src": rows[:, 0], "dst": rows[:, 1], "weight": 1.0})


def _attached(base_size: int, levels: int, intra_p: float, inter_edges: int, seed: int | None) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    pairs: set[tuple[int, int]] = set()
    groups = [list(range(m * base_size, (m + 1) * base_size)) for m in range(2**levels)]
    for g in groups:
        pairs |= {(a, b) for i, a in enumerate(g) for b in g[i + 1 :] if rng.random() < intra_p}
    degree = np.zeros(2**levels * base_size)
    for a, b in pairs:
        degree[[a, b]] += 1
    while len(groups) > 1:
        merged = []
        for one, two in zip(groups[::2], groups[1::2], strict=True):
            both = one + two
            first = (int(rng.choice(one)), int(rng.choice(two)))
            new = {(min(first), max(first))}
            degree[list(first)] += 1
            snapshot = degree[both]  # with the sure edge, before all others
            chance = snapshot / snapshot.sum() if snapshot.sum() else None
            tries = 0
            while len(new) < 1 + inter_edges and tries < 10 * inter_edges:
                tries += 1
                a, b = int(rng.choice(one)), int(rng.choice(both, p=chance))
                edge = (min(a, b), max(a, b))
                if a != b and edge not in pairs:
                    new.add(edge)
            for a, b in new - {(min(first), max(first))}:
                degree[[a, b]] += 1
            pairs |= new
            merged.append(both)
        groups = merged
    return _as_edges(pairs)


def preferential_modular(spark: SparkSession, base_size: int = 10, levels: int = 3, intra_p: float = 0.8, inter_edges: int = 2, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """2^levels random modules; siblings are joined by one edge and up to inter_edges more, their targets by degree in the merged group."""
    edges = _frame(spark, _attached, EDGES, base_size=base_size, levels=levels, intra_p=intra_p, inter_edges=inter_edges, seed=seed)
    return _nodes(spark, 2**levels * base_size, module=F.floor(F.col("id") / base_size)), edges


def _recursive(num_top: int, size: int, inter_p: float, intra_p: float, depth: int, splitting: int, multiplier: float, seed: int | None, once: bool, want: str) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    pairs: set[tuple[int, int]] = set()
    name: dict[int, str] = {}

    def draw(many: list[tuple[int, int]], p: float, trials: float = 1) -> None:
        hit = rng.random(len(many)) < 1 - (1 - p) ** trials
        pairs.update((min(x, y), max(x, y)) for (x, y), h in zip(many, hit, strict=True) if h)

    def module(own: list[int], label: str, level: int) -> list[list[int]]:
        """Base modules below this one."""
        draw([(a, b) for i, a in enumerate(own) for b in own[i + 1 :]], intra_p)
        if level == depth:
            name.update(dict.fromkeys(own, label))
            return [own] if own else []
        parts = np.array_split(np.array(own, int), splitting)  # the first ones take what is left over
        bases = [x for i, part in enumerate(parts) for x in module(part.tolist(), f"{label}-{i}", level + 1)]
        p = inter_p * multiplier ** (level - 1)
        for i, a in enumerate(bases):
            for b in bases[i + 1 :]:
                draw([(x, y) for x in a for y in b], p, 1 if once else len(a) * len(b))
            if not once:
                n = len(a) * (len(a) - 1)
                draw([(x, y) for k, x in enumerate(a) for y in a[k + 1 :]], p, n)
                draw([(x, x) for x in a], p, n / 2)
        return bases

    nodes = rng.permutation(num_top * size).tolist()
    for m in range(num_top):
        module(nodes[m * size : (m + 1) * size], str(m), 1)
    return _as_edges(pairs) if want == "edges" else pd.DataFrame({"node": sorted(name), "module": [name[n] for n in sorted(name)]})


def recursive_modular(spark: SparkSession, num_top: int, nodes_per_module: int, inter_p: float, intra_p: float, depth: int = 2, splitting: int = 3, multiplier: float = 0.5, seed: int | None = 0, dedupe_trials: bool = False) -> tuple[DataFrame, DataFrame]:
    """Modules of shuffled nodes that are split again and again; a node's module is its path, like 0-2-1.

    Every module at every level draws its pairs with intra_p, and those of its base modules with inter_p * multiplier^(level - 1).
    Between two modules a pair of nodes is drawn as often as the product of their sizes says, and pairs within a base module (loops too) are
    drawn again likewise. dedupe_trials: one such draw for a pair of nodes instead.
    """
    args = {"num_top": num_top, "size": nodes_per_module, "inter_p": inter_p, "intra_p": intra_p, "depth": depth, "splitting": splitting, "multiplier": multiplier, "seed": 0 if seed is None else seed, "once": dedupe_trials}
    return _frame(spark, _recursive, "node long, module string", want="nodes", **args), _frame(spark, _recursive, EDGES, want="edges", **args)


def _regions(sizes: int | Sequence[int], n_regions: int) -> list[int]:
    sizes = [sizes] * n_regions if isinstance(sizes, int) else list(sizes)
    if len(sizes) != n_regions:
        raise ValueError("one size for each region")
    return sizes


def _labels(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    starts = np.r_[0, np.cumsum(sizes)].tolist()
    rows = spark.createDataFrame([(r, starts[r], k) for r, k in enumerate(sizes)], "region int, start int, k int").where("k > 0")
    return rows.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("k") - 1)).alias("node"), "region")


def _clock(spark: SparkSession, n: int, rate: float) -> DataFrame:
    """(t, seconds): n samples from 0 to n / rate, both ends included."""
    return spark.range(n).select(F.col("id").cast("int").alias("t"), (F.col("id") * (n / rate / max(1, n - 1))).alias("seconds"))


def _waves(seed: int | None, part: str) -> Column:
    """Waves of 5, 10 and 20 Hz and a drift of 0.1 Hz, each with random amplitude and phase."""
    total = F.lit(0.0)
    for f in (0.1, 5, 10, 20):
        amplitude = 0.5 + _draw(seed, F.lit(f"a{f}"), part)
        total = total + amplitude * F.sin(2 * np.pi * f * F.col("seconds") + 2 * np.pi * _draw(seed, F.lit(f"p{f}"), part))
    return total


def mixed_signals(spark: SparkSession, n_regions: int = 5, n_samples: int = 500, rate: float = 100, noise: float = 0.2, seed: int | None = None) -> DataFrame:
    """(series_id, t, seconds, value): waves with drift and noise, mixed by a random matrix."""
    base = spark.range(n_regions).select(F.col("id").cast("int").alias("source")).crossJoin(_clock(spark, n_samples, rate))
    base = base.withColumn("x", _waves(seed, "source") + noise * _normal(seed, F.lit("n"), "source", "t"))
    mixing = spark.range(n_regions).select(F.col("id").cast("int").alias("series_id")).crossJoin(spark.range(n_regions).select(F.col("id").cast("int").alias("source")))
    mixing = mixing.withColumn("w", _normal(seed, F.lit("m"), "series_id", "source"))
    return base.join(F.broadcast(mixing), "source").groupBy("series_id", "t", "seconds").agg(F.sum(F.col("w") * F.col("x")).alias("value"))


def modular_signals(spark: SparkSession, n_regions: int = 5, region_sizes: int | Sequence[int] = 4, n_samples: int = 500, rate: float = 100, noise: float = 0.2, seed: int | None = None) -> DataFrame:
    """(series_id, region, t, seconds, value): nodes of a region share its waves, each with its own noise."""
    nodes = _labels(spark, _regions(region_sizes, n_regions)).withColumnRenamed("node", "series_id")
    return nodes.crossJoin(F.broadcast(_clock(spark, n_samples, rate))).withColumn("value", _waves(seed, "region") + noise * _normal(seed, F.lit("n"), "series_id", "t"))


def _band_limited(region: int, sizes: Sequence[int], first: int, n: int, rate: float, noise: float, low: float, high: float, seed: int | None) -> pd.DataFrame:
    base = kernels.band_filter(np.random.default_rng([region, 1, seed or 0]).normal(size=n), low, high, rate)[0]
    base, parts = (base - base.mean()) / base.std(), []
    for node in range(first, first + sizes[region]):
        own = np.random.default_rng([node, 2, seed or 0]).normal(size=n)
        parts.append(pd.DataFrame({"series_id": np.int32(node), "region": np.int32(region), "t": np.arange(n, dtype=np.int32), "value": base + noise * own}))
    return pd.concat(parts) if parts else pd.DataFrame({"series_id": [], "region": [], "t": [], "value": []})


def band_limited_signals(spark: SparkSession, n_regions: int = 5, region_sizes: int | Sequence[int] = 4, n_samples: int = 500, rate: float = 100, noise: float = 0.2, low: float = 1, high: float = 30, seed: int | None = None) -> DataFrame:
    """(series_id, region, t, value): nodes of a region share noise of a band, normalised, each with its own noise. A task makes a region."""
    sizes = _regions(region_sizes, n_regions)
    starts = np.r_[0, np.cumsum(sizes)].tolist()

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        return _band_limited(int(key[0]), sizes, starts[int(key[0])], n_samples, rate, noise, low, high, seed)

    return spark.range(n_regions).groupBy("id").applyInPandas(run, "series_id int, region int, t int, value double")


def region_labels(spark: SparkSession, n_regions: int, region_sizes: int | Sequence[int]) -> DataFrame:
    """(node, region) of the modular signals."""
    return _labels(spark, _regions(region_sizes, n_regions))


def _recurrent(n: int, sizes: Sequence[int], alpha: float, least: float, steps: int, dt: float, seed: int | None) -> pd.DataFrame:
    from netscale.operators.series import euler

    rng = np.random.default_rng(seed)
    region = np.repeat(np.arange(len(sizes)), sizes)
    j = rng.uniform(0, least, (n, n))
    inner = region[:, None] == region[None, :]
    j[inner] = ((rng.pareto(alpha - 1, (n, n)) + 1) * least)[inner]
    np.fill_diagonal(j, 0)
    x = euler(j, rng.normal(size=n), steps, dt)
    return pd.DataFrame({"series_id": np.tile(np.arange(n, dtype=np.int32), steps), "t": np.repeat(np.arange(steps, dtype=np.int32), n), "value": x.reshape(-1)})


def recurrent_signals(spark: SparkSession, region_sizes: Sequence[int], alpha: float = 2.5, least: float = 0.1, n_samples: int = 500, dt: float = 0.1, seed: int | None = 0) -> DataFrame:
    """(series_id, t, value): linear dynamics with heavy-tailed couplings inside regions and weak ones between; it may diverge."""
    return _frame(spark, _recurrent, "series_id int, t int, value double", n=int(sum(region_sizes)), sizes=list(region_sizes), alpha=alpha, least=least, steps=n_samples, dt=dt, seed=seed)
