"""Hierarchical clustering of distance tables (keys..., i, j, d), and what is read off its heights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.functions import kernels
from netscale.operators.forest import cut, merge_tree, spanning_forest, with_row
from netscale.operators.graph import split, with_nodes
from netscale.operators.series import per_key
from netscale.operators.stats import ranked_by
from netscale.sources.shared import written

#: Nodes of a key whose matrix (32 MB) one task may hold.
DENSE = 2000
LINKAGE = "step int, a int, b int, height double, size int"


def _square(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.r_[frame["i"].to_numpy(), frame["j"].to_numpy()])
    m = np.full((len(ids), len(ids)), np.nan)
    a, b = np.searchsorted(ids, frame["i"]), np.searchsorted(ids, frame["j"])
    m[a, b] = m[b, a] = frame["d"].to_numpy(float)
    np.fill_diagonal(m, 0)
    known = m[np.isfinite(m)].max(initial=0.0)
    m[~np.isfinite(m)] = 10 * known if known > 0 else 1.0
    return ids, m


def _rows(z: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"step": np.arange(len(z), dtype=np.int32), "a": z[:, 0].astype(np.int32), "b": z[:, 1].astype(np.int32)})
    return out.assign(height=z[:, 2], size=z[:, 3].astype(np.int32))


def linkage(distance: DataFrame, keys: Sequence[str] = (), method: str = "average", dense: int = DENSE) -> DataFrame:
    """(keys..., step, a, b, height, size): leaves by ascending node are 0 .. n - 1, later clusters n + step.

    A pair that is missing, null or infinite is ten times as far as the farthest known one (1.0 if none is over 0), so it merges last. Single
    linkage is read off a spanning forest of smallest distance. For the other methods a task works on the matrix of a key of at most
    `dense` nodes; larger keys go through rounds of tables, in each of which all clusters that are nearest to one another merge. Equal heights
    may merge in another order there.
    """
    if method not in ("single", "complete", "average", "ward"):
        raise ValueError(f"unknown method: {method}")
    k = list(keys)
    rows = distance.select(*k, F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), F.col("d").cast("double").alias("d")).where("i <> j")
    rows = rows.withColumn("d", F.when(~F.isnan("d") & (F.abs("d") < float("inf")), F.col("d")))
    if method == "single":
        return _single(written(rows, "distances"), k)
    rows = written(rows, "distances")
    n = rows.select(*k, F.explode(F.array("i", "j")).alias("node")).distinct().groupBy(*k).agg(F.count("*").alias("__n"))
    sized = with_row(rows, n, k)
    small = per_key(sized.where(F.col("__n") <= dense).drop("__n"), keys, lambda f: _rows(kernels.linkage(_square(f)[1], method)), LINKAGE)
    large = written(sized.where(F.col("__n") > dense).drop("__n"), "large")
    return small if large.isEmpty() else small.unionByName(_by_rounds(large, k, method))


def _far(rows: DataFrame, k: list[str]) -> DataFrame:
    """How far pairs without a distance are, for each key."""
    return rows.groupBy(*k).agg(F.coalesce(F.nullif(10 * F.max("d"), F.lit(0.0)), F.lit(1.0)).alias("far"))


def _single(rows: DataFrame, k: list[str]) -> DataFrame:
    """Single linkage; trees that no known distance joins are joined by their smallest nodes, as far as _far says."""
    nodes = written(rows.select(*k, F.explode(F.array("i", "j")).alias("node")).distinct(), "nodes")
    known = rows.where("d is not null").select(*k, F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("weight"))
    found = spanning_forest(known, k, largest=False)
    trees = nodes.withColumn("top", F.col("node"))
    for up in found.tops:
        trees = trees.join(up.select(*k, F.col("c").alias("top"), F.col("top").alias("__next")), [*k, "top"], "left").withColumn("top", F.coalesce("__next", "top")).drop("__next")
    tops = written(trees.groupBy(*k, "top").agg(F.min("node").alias("node")), "trees")
    if not tops.groupBy(*k).count().where("count > 1").isEmpty():
        ranked = written(ranked_by(tops.select(*k, "node"), [*k, "node"])[0], "trees")
        after = ranked.select(*k, F.col("node").alias("dst"), (F.col("rank") - 1).alias("rank"))
        joins = with_row(ranked.join(after, [*k, "rank"]), _far(rows, k), k).select(*k, F.col("node").alias("src"), "dst", F.col("far").alias("weight"))
        found = spanning_forest(known.unionByName(joins), k, largest=False)
    links, _ = merge_tree(nodes, found)
    return links.select(*k, "step", "a", "b", "height", "size")


def _by_rounds(rows: DataFrame, k: list[str], method: str) -> DataFrame:
    """Average, complete and Ward linkage in rounds of tables: pairs of clusters that are nearest to one another merge, which gives the same
    merges as one after the other would, as none of these methods lets a merged cluster come nearer than its parts were.

    Of two clusters the sum of distances (squared for Ward) between their members is kept, or the largest; so a merge is a sum too. Ward's
    distance is 2 n m / (n + m) (sum / nm - own / n^2 - own' / m^2), own being the sum within a cluster, which is what the usual recursion gives.
    """
    nodes = written(rows.select(*k, F.explode(F.array("i", "j")).alias("node")).distinct(), "nodes")
    leaves = written(ranked_by(nodes, [*k, "node"])[0], "leaves")
    low = leaves.groupBy(*k).agg(F.min("rank").alias("__low"), F.count("*").alias("__n"))
    leaves = written(with_row(leaves, low, k).select(*k, "node", (F.col("rank") - F.col("__low")).alias("c"), "__n"), "leaves")
    for end in ("i", "j"):
        rows = rows.join(leaves.select(*k, F.col("node").alias(end), F.col("c").alias(f"__{end}")), [*k, end]).drop(end)
    pairs = rows.groupBy(*k, F.col("__i").alias("i"), F.col("__j").alias("j")).agg(F.last("d", ignorenulls=True).alias("d"))
    every = leaves.select(*k, F.col("c").alias("i"), F.explode(F.expr("sequence(c + 1, __n - 1)")).alias("j"), F.col("c"), F.col("__n")).where("c < __n - 1").select(*k, "i", "j")
    pairs = with_row(every.join(pairs, [*k, "i", "j"], "left"), _far(rows, k), k).withColumn("s", F.coalesce("d", "far"))
    if method == "ward":
        pairs = pairs.withColumn("s", F.col("s") * F.col("s"))
    own = F.struct(F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("own"), F.lit(-1).alias("made"), F.lit(0.0).alias("height"))
    pairs = written(pairs.select(*k, "i", "j", "s", own.alias("x"), own.alias("y")), "pairs")
    n, m = F.col("x.n"), F.col("y.n")
    if method == "average":
        d = F.col("s") / (n * m)
    elif method == "complete":
        d = F.col("s")
    else:
        d = F.sqrt(F.greatest(F.lit(0.0), 2 * n * m / (n + m) * (F.col("s") / (n * m) - F.col("x.own") / (n * n) - F.col("y.own") / (m * m))))
    merges, turn = None, 0
    while not pairs.isEmpty():
        each = pairs.select(*k, "i", "j", F.struct(d.alias("d"), "i", "j", "s", "x", "y").alias("p"))
        nearest = each.select(*k, F.explode(F.array("i", "j")).alias("c"), "p").groupBy(*k, "c").agg(F.min("p").alias("p"))
        both = nearest.groupBy(*k, F.col("p.i").alias("a"), F.col("p.j").alias("b")).agg(F.count("*").alias("times"), F.first("p").alias("p")).where("times = 2")
        size = F.col("p.x.n") + F.col("p.y.n")
        height = F.greatest("p.d", "p.x.height", "p.y.height")  # never below its parts by rounding
        new = F.struct(size.alias("n"), (F.col("p.x.own") + F.col("p.y.own") + F.col("p.s")).alias("own"), F.lit(turn).alias("made"), height.alias("height"))
        both = written(both.select(*k, "a", "b", height.alias("height"), size.alias("size"), F.col("p.x.made").alias("made_a"), F.col("p.y.made").alias("made_b"), F.lit(turn).alias("turn"), new.alias("new")), "merged")
        merges = both.drop("new") if merges is None else merges.unionByName(both.drop("new"))
        to = both.select(*k, F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("to"), "new")
        for end, what in (("i", "x"), ("j", "y")):
            pairs = pairs.join(to.select(*k, F.col("c").alias(end), "to", "new"), [*k, end], "left").withColumns({end: F.coalesce("to", end), what: F.coalesce("new", what)}).drop("to", "new")
        pairs = pairs.where("i <> j")
        first = F.when(F.col("i") < F.col("j"), F.struct("i", "j", "x", "y")).otherwise(F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("y").alias("x"), F.col("x").alias("y")))
        pairs = pairs.select(*k, first.alias("f"), "s").select(*k, "f.i", "f.j", "f.x", "f.y", "s").groupBy(*k, "i", "j")
        pairs = written(pairs.agg((F.max("s") if method == "complete" else F.sum("s")).alias("s"), F.first("x").alias("x"), F.first("y").alias("y")), "pairs")
        turn += 1
    ranked = written(ranked_by(written(merges, "merges"), [*k, "height", "turn", "a"])[0], "merges")
    ranked = with_row(ranked, low, k).join(ranked.groupBy(*k).agg(F.min("rank").alias("__first")), k) if k else with_row(with_row(ranked, low, k), ranked.agg(F.min("rank").alias("__first")), k)
    ranked = written(ranked.withColumn("step", F.col("rank") - F.col("__first")), "merges")
    for part in ("a", "b"):
        child = ranked.select(*k, F.col("a").alias(part), F.col("turn").alias(f"made_{part}"), F.col("step").alias("__child"))
        ranked = ranked.join(child, [*k, part, f"made_{part}"], "left").withColumn(f"id_{part}", F.coalesce(F.col("__n") + F.col("__child"), part)).drop("__child")
    ends = [f("id_a", "id_b").cast("int").alias(name) for f, name in ((F.least, "a"), (F.greatest, "b"))]
    return ranked.select(*k, F.col("step").cast("int").alias("step"), *ends, "height", F.col("size").cast("int").alias("size"))


def normalized_linkage(distance: DataFrame, keys: Sequence[str] = (), method: str = "average") -> DataFrame:
    """linkage with heights over 1.01 times the largest, and that divisor as tmax."""
    found = linkage(distance, keys, method)
    return found.withColumn("tmax", 1.01 * F.max("height").over(Window.partitionBy(*keys))).withColumn("height", F.col("height") / F.col("tmax"))


def leaf_labels(distance: DataFrame, keys: Sequence[str] = (), label_list: str = "names") -> DataFrame:
    """(keys..., leaf, label): the node of each leaf, or numbers from 1."""
    if label_list not in ("names", "numbers"):
        raise ValueError("label_list is names or numbers")
    nodes = distance.select(*keys, F.explode(F.array("i", "j")).alias("node")).distinct()
    leaf = F.row_number().over(Window.partitionBy(*keys).orderBy("node")) - 1
    return nodes.withColumn("leaf", leaf).select(*keys, "leaf", (F.col("node") if label_list == "names" else F.col("leaf") + 1).alias("label"))


def flat_clusters(links: DataFrame, height: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., leaf, cluster): merges up to the height hold; clusters are numbered from 1 through the tree, as forest.cut says, without a walk."""
    found, _ = cut(written(links.select(*keys, "step", "a", "b", "height", "size"), "links"), height, keys)
    return found.select(*keys, F.col("leaf").cast("int").alias("leaf"), "cluster")


def dendrogram(links: DataFrame, color_height: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., position, leaf, cluster): leaves from left to right, and the cluster below color_height (0: a single leaf)."""
    found, _ = cut(written(links.select(*keys, "step", "a", "b", "height", "size"), "links"), color_height, keys)
    alone = F.when(F.col("members") > 1, F.col("cluster")).otherwise(0)
    return found.select(*keys, F.col("position").cast("int").alias("position"), F.col("leaf").cast("int").alias("leaf"), alone.alias("cluster"))


def lower_bound(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Half of the first height."""
    return links.groupBy(*keys).agg((0.5 * F.min_by("height", "step")).alias("tmin"))


def gap_stability(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., idx, upper, lower, stability): share of the log span of each gap between heights, from the top. Null for equal or zero heights."""
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.desc("step"))
    rows = links.select(*keys, "step", "height").withColumns({"idx": F.row_number().over(down) - 1, "lower": F.lead("height").over(down), "top": F.max("height").over(w), "end": F.min("height").over(w)})
    log = lambda c: F.when(F.col(c) > 0, F.log10(c))
    share = F.try_divide(log("height") - log("lower"), log("top") - log("end"))
    return rows.where("lower is not null").select(*keys, "idx", F.col("height").alias("upper"), "lower", share.alias("stability"))


def optimal_threshold(links: DataFrame, keys: Sequence[str] = (), scaling: float = 1.0) -> DataFrame:
    """The lower edge of the widest log gap (the first from the top of equal ones), and that scaled."""
    gaps = gap_stability(links, keys).where("stability is not null")
    best = gaps.groupBy(*keys).agg(F.max_by(F.struct("idx", "lower", "stability"), F.struct("stability", -F.col("idx"))).alias("b"))
    return best.where("b is not null").select(*keys, F.col("b.idx").alias("idx"), F.col("b.lower").alias("threshold"), (F.col("b.lower") * scaling).alias("flat_threshold"), "b.stability")


def optimal_threshold_std(heights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The middle of the widest gap between sorted heights (the first of equal ones)."""
    w = Window.partitionBy(*keys).orderBy("height")
    gaps = heights.select(*keys, "height").withColumns({"next": F.lead("height").over(w), "idx": F.row_number().over(w)}).where("next is not null")
    best = F.max_by((F.col("height") + F.col("next")) / 2, F.struct(F.col("next") - F.col("height"), -F.col("idx")))
    return gaps.groupBy(*keys).agg(best.alias("threshold"))


def cut_grid(links: DataFrame, keys: Sequence[str] = (), cuts: int = 8) -> DataFrame:
    """(keys..., cut, height): log-spaced from the smallest to the last but one height, exponents cut off towards 0.

    Null heights where there are fewer than two heights, or one that counts isn't positive."""
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("height")))
    log = lambda c: F.when(c > 0, F.log10(c)).cast("int")
    ends = links.where("height is not null").withColumn("down", down).groupBy(*keys)
    ends = ends.agg(log(F.min("height")).alias("lo"), log(F.max(F.when(F.col("down") == 2, F.col("height")))).alias("hi"))
    each = ends.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    return each.select(*keys, "cut", F.pow(F.lit(10.0), F.col("lo") + F.col("cut") * (F.col("hi") - F.col("lo")) / (cuts - 1)).alias("height"))


def multi_tau_partitions(nodes: DataFrame, edges: DataFrame, cuts: Sequence[tuple[float | None, float]], keys: Sequence[str] = (), method: str = "ward") -> DataFrame:
    """(keys..., stage, tau, node, community) of each (tau, cut): diffusion distance at tau, linkage over 1.01 times its top, cut.

    A tau of None is 1 over the largest eigenvalue. A pair that diffusion doesn't reach is as far as the farthest that it does, times 10.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own, src, dst, weight = split(frame)
        m, parts = kernels.dense_laplacian(own, src, dst, weight), []
        for stage, (tau, cut) in enumerate(cuts):
            at = 1 / np.linalg.eigvalsh(m)[-1] if tau is None else tau
            rho = kernels.density(at, m)
            with np.errstate(divide="ignore"):
                d = np.where(rho > 0, 1 / np.maximum(rho, 0), np.inf)
            d = np.maximum(d, d.T)
            np.fill_diagonal(d, 0)
            d[np.isinf(d)] = 10 * d[np.isfinite(d)].max()
            z = kernels.linkage(d, method)
            z[:, 2] /= 1.01 * z[:, 2].max()
            parts.append(pd.DataFrame({"stage": np.int32(stage), "tau": float(at), "node": own, "community": kernels.flat_clusters(z, cut).astype(np.int32)}))
        return pd.concat(parts)

    return per_key(with_nodes(nodes, edges, keys), keys, run, "stage int, tau double, node long, community int")
