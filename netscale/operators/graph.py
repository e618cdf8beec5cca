"""Graphs as tables: nodes (keys..., node) and edges (keys..., src, dst, weight)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.operators.corr import as_series, clean, correlation, edges_of, full_matrix
from netscale.operators.series import SERIES, per_key
from netscale.operators.stats import ranked_by
from netscale.sources.shared import written


def with_nodes(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes and edges in one table, for kernels: a node is a row with a null dst."""
    n = nodes.select(*keys, F.col("node").cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("weight"))
    return n.unionByName(edges.select(*keys, F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")))


def split(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted nodes, and ends and weights of edges, of one key of with_nodes()."""
    e = frame[frame["dst"].notna()].sort_values(["src", "dst"])
    src, dst = e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64)
    return np.unique(np.r_[frame["src"].to_numpy(np.int64), dst]), src, dst, e["weight"].to_numpy(float)


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), strongly: bool = False) -> DataFrame:
    """(keys..., node, component), a component being its smallest node; graphs are tables of any size.

    Weak ones by alternating large and small stars: each round is a table in the shared folder, and only its count and checksum reach the driver.
    Strong ones by trimming, and colouring forwards and backwards. Null nodes and edges with a null end don't count.
    """
    k = list(keys)
    edges = edges.where("src is not null and dst is not null").select(*k, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    own = nodes.select(*k, F.col("node").cast("long").alias("node")).where("node is not null").union(edges.select(*k, F.explode(F.array("src", "dst")))).distinct()
    found = _strong(edges, k) if strongly else _weak(edges, k)
    return own.join(found, [*k, "node"], "left").select(*k, "node", F.coalesce("component", "node").alias("component"))


def components_of_large(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of one graph, as components() gives them."""
    return components(nodes, edges)


def _weak(edges: DataFrame, k: list[str]) -> DataFrame:
    """(keys..., node, component) of the nodes that aren't the smallest of their component."""

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64(*k, "a", "b").cast("decimal(38,0)"))).first())

    ends = edges.where("src != dst").select(*k, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    ends = written(ends, "stars")
    was, now = None, state(ends)
    while now[0] and now != was:
        both = ends.union(ends.select(*k, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*k, "a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, [*k, "a"]).where("b > a and b != m").select(*k, F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy(*k, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*k, "a"]).where("b != m").select(*k, F.col("b").alias("a"), F.col("m").alias("b"))
        ends = written(small.union(least).distinct(), "stars")
        was, now = now, state(ends)
    return ends.select(*k, F.col("a").alias("node"), F.col("b").alias("component"))


def _strong(edges: DataFrame, k: list[str]) -> DataFrame:
    """(keys..., node, component) of the nodes in strong components of more than one node.

    In each round nodes that no edge enters, or none leaves, are trimmed: each is a component of its own. Then the smallest node that reaches a
    node colours it, and what its colour's node is reached from within the colour is that node's component. What's left goes on, only along
    edges within a colour; each round finds a component in each colour.
    """
    left = written(edges.where("src != dst").distinct(), "edges")
    found = left.limit(0).select(*k, F.col("src").alias("node"), F.col("dst").alias("component"))
    while not left.isEmpty():
        left = _trimmed(left, k)
        if left.isEmpty():
            break
        colour = _spread(left, left.select(*k, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), k)
        tail, head = (colour.select(*k, F.col("node").alias(end), F.col("colour").alias(f"__{end}")) for end in ("src", "dst"))
        inner = left.join(tail, [*k, "src"]).join(head, [*k, "dst"]).where("__src = __dst").select(*k, "src", "dst", F.col("__src").alias("colour"))
        inner = written(inner, "edges")
        # backwards from each colour's node, edges within the colour only
        reached = written(colour.where("node = colour"), "reached")
        new = reached
        while True:
            step = inner.join(new.select(*k, F.col("node").alias("dst"), "colour"), [*k, "dst", "colour"]).select(*k, F.col("src").alias("node"), "colour").distinct()
            new = written(step.join(reached, [*k, "node", "colour"], "left_anti"), "reached")
            if new.isEmpty():
                break
            reached = reached.union(new)
        reached = written(reached.select(*k, "node", F.col("colour").alias("component")), "components")
        found = found.union(reached)
        for end in ("src", "dst"):
            inner = inner.join(reached.select(*k, F.col("node").alias(end)), [*k, end], "left_anti")
        left = written(inner.select(*k, "src", "dst"), "edges")
    return found


def _trimmed(edges: DataFrame, k: list[str], rounds: int = 3) -> DataFrame:
    """Edges without those at nodes that no edge enters or none leaves; a few rounds at a time, as a long path takes many."""
    for _ in range(rounds):
        edges = edges.join(edges.select(*k, F.col("dst").alias("src")).distinct(), [*k, "src"], "left_semi")
        edges = edges.join(edges.select(*k, F.col("src").alias("dst")).distinct(), [*k, "dst"], "left_semi")
        edges = written(edges, "trimmed")
    return edges


def _spread(edges: DataFrame, colours: DataFrame, k: list[str]) -> DataFrame:
    """The smallest colour that reaches each node along directed edges; only nodes whose colour changed spread it on."""
    colours = written(colours, "colours")
    new = colours
    while True:
        told = edges.join(new.select(*k, F.col("node").alias("src"), "colour"), [*k, "src"]).groupBy(*k, F.col("dst").alias("node")).agg(F.min("colour").alias("__new"))
        both = colours.join(told, [*k, "node"], "left")
        colours = written(both.select(*k, "node", F.least("colour", "__new").alias("colour"), (F.coalesce(F.col("__new") < F.col("colour"), F.lit(False))).alias("__changed")), "colours")
        new, colours = colours.where("__changed").select(*k, "node", "colour"), colours.drop("__changed")
        if new.isEmpty():
            return colours


def giant_nodes(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), strongly: bool = False) -> DataFrame:
    """Nodes of the largest component of each key; of equal ones, that with the smallest node."""
    found = written(components(nodes, edges, keys, strongly), "components")
    return found.join(_largest(found, keys), [*keys, "component"], "left_semi").select(*keys, "node")


def _largest(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    sizes = found.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    return sizes.groupBy(*keys).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))


def induced(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(*keys, F.col("node").alias(end)), [*keys, end], "left_semi")
    return edges


def giant_component(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), strongly: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the giant component."""
    own = giant_nodes(nodes, edges, keys, strongly)
    return own, induced(edges, own, keys)


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def giant_and_left_off(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the giant component after loops are dropped, and the nodes outside it. Components are worked out once, as a table."""
    edges = written(without_loops(edges).select(*keys, "src", "dst", "weight"), "edges")
    found = written(components(nodes, edges, keys), "components")
    best = _largest(found, keys)
    inside = found.join(best, [*keys, "component"], "left_semi").select(*keys, "node")
    return inside, induced(edges, inside, keys), found.join(best, [*keys, "component"], "left_anti").select(*keys, "node")


def correlation_network(df: DataFrame, keys: Sequence[str] = (), threshold: float | None = None, remove_negative: bool = True, regularize: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the giant component of a correlation network of series, and the nodes left off."""
    least = threshold if threshold is not None and threshold > 0 else None  # what is below becomes 0, which is no edge
    edges = edges_of(clean(correlation(df, keys, least=least), remove_negative, regularize, threshold), keys)
    return giant_and_left_off(df.select(*keys, F.col(SERIES).alias("node")).distinct(), edges, keys)


def second_order_network(corr: DataFrame, ids: DataFrame, keys: Sequence[str] = (), threshold: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The network of correlations between the rows of a correlation matrix, which is read twice: best a table."""
    return correlation_network(as_series(full_matrix(corr, ids, keys), keys), keys, threshold)


def undirected(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each edge once, from its smaller to its larger end; of repeated ones the largest weight."""
    ends = edges.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return ends.groupBy(*keys, "src", "dst").agg(F.max("weight").alias("weight"))


def relabel(edges: DataFrame, offset: int) -> DataFrame:
    return edges.withColumns({"src": F.col("src") + offset, "dst": F.col("dst") + offset})


def compose(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges of either graph, each once."""
    return undirected(a.unionByName(b), keys)


def remove_edges(edges: DataFrame, gone: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Undirected edges without those of another table."""
    return undirected(edges, keys).join(undirected(gone, keys), [*keys, "src", "dst"], "left_anti")


def has_edge(pairs: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """pairs (keys..., u, v) with `found`, directions ignored."""
    known = undirected(edges, keys).select(*keys, F.col("src").alias("__a"), F.col("dst").alias("__b"), F.lit(True).alias("__f"))
    ends = pairs.withColumns({"__a": F.least("u", "v"), "__b": F.greatest("u", "v")})
    return ends.join(known, [*keys, "__a", "__b"], "left").withColumn("found", F.coalesce("__f", F.lit(False))).drop("__a", "__b", "__f")


def degree(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Degree and strength of each node that has an edge."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def totals(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of nodes and edges, and the smallest and largest weight, in one row a key."""
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy(*keys).agg(F.count("*").alias("n_edges"), F.min("weight").alias("w_min"), F.max("weight").alias("w_max"))
    return n.join(e, list(keys), "left") if keys else n.crossJoin(F.broadcast(e))


def laplacian(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., i, j, val): strengths on the diagonal, negative weights beside it, both triangles."""
    off = edges.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j")))).alias("c"), (-F.col("weight")).alias("val"))
    on = degree(edges, keys).select(*keys, F.col("node").alias("i"), F.col("node").alias("j"), F.col("strength").alias("val"))
    return off.select(*keys, "c.i", "c.j", "val").unionByName(on)


def largest_first(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Components with their sizes and ranks, the largest first, of equal ones that with the smallest node."""
    sizes = found.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    if keys:
        return sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "component")))
    ranked, _ = ranked_by(written(sizes.withColumn("__less", -F.col("n")), "sizes"), ["__less", "component"])
    return ranked.drop("__less").withColumn("rank", F.col("rank").cast("int"))
