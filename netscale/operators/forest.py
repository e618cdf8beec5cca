"""Spanning forests, merge trees and what is read off them, as tables: no graph, tree or chain of merges has to fit a task.

A merge tree is a table of links (keys..., step, a, b, height, size): leaves are 0 .. n - 1, and step k makes cluster n + k of the clusters a < b.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.operators.stats import ranked_by
from netscale.sources.shared import written


#: Rows whose running sums one task may work out.
SMALL = 20_000


@dataclass
class Forest:
    """edges (keys..., src, dst, weight), each round's choice (keys..., c, src, dst) of an edge by each tree c, and the tree `top` that c is then
    part of; a tree is called by one of its nodes."""

    keys: list[str]
    sign: int
    edges: DataFrame
    choices: list[DataFrame]
    tops: list[DataFrame]


def with_row(df: DataFrame, row: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """df with the columns of a table of one row a key."""
    return df.join(row, list(keys), how) if keys else df.crossJoin(F.broadcast(row))


def running(rows: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """rows with `rank` (from 1) by the columns of `order` among all, and `upto`, the sum of value (long) up to the row; rows: best a table.

    Ranges of rows are summed apart; the totals of ranges go through one window, a row for each 4096 ranks.
    """
    ranked, n = ranked_by(rows, order)
    if n <= SMALL:
        return ranked.withColumn("upto", F.sum(value).over(Window.partitionBy(F.lit(0)).orderBy("rank")))
    ranked = written(ranked.withColumn("__part", F.expr("(rank - 1) div 4096")), "ranked")
    parts = ranked.groupBy("__part").agg(F.sum(value).alias("s"))
    before = parts.select("__part", (F.sum("s").over(Window.orderBy("__part")) - F.col("s")).alias("__before"))
    inner = F.sum(value).over(Window.partitionBy("__part").orderBy("rank"))
    return ranked.withColumn("upto", inner).join(before, "__part").withColumn("upto", F.col("upto") + F.col("__before")).drop("__part", "__before")


def to_roots(up: DataFrame, keys: Sequence[str], add: str | None = None) -> DataFrame:
    """(keys..., c, top[, add]) of pointers (keys..., c, top): where each leads in the end, by doubling; what leads to itself, or has no pointer
    of its own, is an end. add: a column that is summed over the pointers on the way."""
    names = [*keys, "c", "top", *([add] if add else [])]
    up = written(up.select(*names), "pointers")
    while True:
        on = up.where("c <> top").select(*keys, F.col("c").alias("top"), F.col("top").alias("__next"), *([F.col(add).alias("__add")] if add else []))
        far = up.join(on, [*keys, "top"], "left")
        moved = F.col("__next").isNotNull() & (F.col("c") != F.col("top"))
        sums = [(F.col(add) + F.when(moved, F.col("__add")).otherwise(F.lit(0))).alias(add)] if add else []
        up = written(far.select(*keys, "c", F.when(moved, F.col("__next")).otherwise(F.col("top")).alias("top"), *sums, moved.alias("__moved")), "pointers")
        done = up.where("__moved").isEmpty()
        up = up.drop("__moved")
        if done:
            return up


def spanning_forest(edges: DataFrame, keys: Sequence[str] = (), largest: bool = True) -> Forest:
    """The spanning forest of largest (or smallest) weight of each key's undirected edges (keys..., src, dst, weight), in Boruvka's rounds.

    Loops and null weights don't count; of parallel edges the best does; equal weights go by (src, dst), the smaller end being src. In a round each
    tree chooses its best edge to another one, and trees that are so joined become one, found by pointer doubling; edges within a tree
    are dropped, and of those between two trees the best is kept. Trees at least halve in number each round.
    """
    k, sign = list(keys), 1 if largest else -1
    ends = edges.where("src <> dst and weight is not null")
    ends = ends.select(*k, F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    left = ends.groupBy(*k, "src", "dst").agg((F.max("weight") if largest else F.min("weight")).alias("weight"))
    left = written(left.select(*k, "src", "dst", "weight", F.col("src").alias("u"), F.col("dst").alias("v")), "edges")
    better = F.struct(sign * F.col("weight"), -F.col("src"), -F.col("dst"))
    choices, tops, found = [], [], left.limit(0).select(*k, "src", "dst", "weight")
    while not left.isEmpty():
        ways = left.select(*k, F.col("u").alias("c"), F.col("v").alias("o"), "src", "dst", "weight").union(left.select(*k, F.col("v").alias("c"), F.col("u").alias("o"), "src", "dst", "weight"))
        best = ways.groupBy(*k, "c").agg(F.max_by(F.struct("o", "src", "dst", "weight"), better).alias("b"))
        best = written(best.select(*k, "c", "b.*"), "choices")
        back = best.select(*k, F.col("c").alias("o"), F.col("src").alias("__src"), F.col("dst").alias("__dst"))
        both = (F.col("src") == F.col("__src")) & (F.col("dst") == F.col("__dst")) & (F.col("c") < F.col("o"))
        up = best.join(back, [*k, "o"]).select(*k, "c", F.when(both, F.col("c")).otherwise(F.col("o")).alias("top"))
        up = to_roots(up, k)
        choices.append(best)
        tops.append(up)
        found = found.union(best.select(*k, "src", "dst", "weight"))
        for end in ("u", "v"):
            left = left.join(up.select(*k, F.col("c").alias(end), F.col("top").alias("__top")), [*k, end]).withColumn(end, F.col("__top")).drop("__top")
        between = left.where("u <> v").groupBy(*k, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        between = between.agg(F.max_by(F.struct("src", "dst", "weight"), better).alias("b"))
        left = written(between.select(*k, "b.*", "u", "v"), "edges")
    return Forest(k, sign, written(found.distinct(), "forest"), choices, tops)


def merge_tree(nodes: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame]:
    """Links (keys..., step, a, b, height, size, src, dst) of the merges by the forest's edges, best first, and leaves (keys..., node, leaf).

    The merges within a tree of round r, in their order, up to the one that the tree itself takes part in as a whole, are a chain: each of
    them has the one before as a part. A chain's last merge is part of the merge that the tree chose. So an edge belongs to the chain of the first
    round whose tree chose an edge after it. Sizes are sums along chains, the chains of earlier rounds first.
    """
    k = forest.keys
    order = forest.edges.withColumn("__order", -forest.sign * F.col("weight"))
    ranked = written(ranked_by(order, [*k, "__order", "src", "dst"])[0].drop("__order"), "merges")
    base = ranked.groupBy(*k).agg(F.min("rank").alias("__first"), F.count("*").alias("__m"))
    number = ranked.select(*k, "src", "dst", "rank")
    rounds = len(forest.choices)
    chosen = [written(c.select(*k, "c", "src", "dst").join(number, [*k, "src", "dst"]).select(*k, "c", "rank"), "chosen") for c in forest.choices]
    # the chain of each edge
    chains, open_ = None, None
    for r in range(rounds):
        own = chosen[r].join(forest.tops[r], [*k, "c"]).select(*k, "rank", F.col("top").alias("tree")).distinct()
        open_ = own if open_ is None else open_.union(own)
        if r + 1 < rounds:
            seen = open_.join(chosen[r + 1].select(*k, F.col("c").alias("tree"), F.col("rank").alias("last")), [*k, "tree"], "left")
        else:
            seen = open_.withColumn("last", F.lit(None).cast("long"))
        seen = written(seen, "chains")
        here = seen.where("last is null or rank < last").withColumn("round", F.lit(r))
        chains = here if chains is None else chains.unionByName(here)
        if r + 1 < rounds:
            above = forest.tops[r + 1].select(*k, F.col("c").alias("tree"), "top")
            open_ = seen.where("rank > last").join(above, [*k, "tree"]).select(*k, "rank", F.col("top").alias("tree"))
    own = nodes.select(*k, F.col("node").cast("long").alias("node")).distinct()
    own = written(ranked_by(written(own, "nodes"), [*k, "node"])[0], "leaves")
    firsts = own.groupBy(*k).agg(F.min("rank").alias("__low"), F.count("*").alias("__n"))
    leaves = with_row(own, firsts, k).select(*k, "node", (F.col("rank") - F.col("__low")).alias("leaf"), "__n")
    if chains is None:
        empty = ranked.select(*k, *[F.lit(0).cast("int").alias(c) for c in ("step", "a", "b")], F.col("weight").alias("height"), F.lit(0).cast("int").alias("size"), "src", "dst")
        return empty, leaves.drop("__n")
    # leaves hang on what they chose first
    hung = chosen[0].withColumnRenamed("c", "node").join(leaves, [*k, "node"]).select(*k, "rank", "leaf")
    value = hung.groupBy(*k, "rank").agg(F.count("*").alias("value"))
    totals = []
    rows = []
    for r in range(rounds):
        part = chains.where(F.col("round") == r).join(value, [*k, "rank"], "left")
        if totals:
            sides = totals[0]
            for t in totals[1:]:
                sides = sides.union(t)
            part = part.join(sides.groupBy(*k, "rank").agg(F.sum("side").alias("side")), [*k, "rank"], "left")
        else:
            part = part.withColumn("side", F.lit(0))
        part = written(part.withColumn("value", (F.coalesce("value", F.lit(0)) + F.coalesce("side", F.lit(0))).cast("long")).drop("side"), "chains")
        rows.append(part)
        totals.append(written(part.where("last is not null").groupBy(*k, "tree", F.col("last").alias("rank")).agg(F.sum("value").alias("side")).select(*k, "rank", "side"), "totals"))
    whole = rows[0]
    for part in rows[1:]:
        whole = whole.unionByName(part)
    placed = running(written(whole.withColumnRenamed("rank", "merge"), "chains"), [*k, "round", "tree", "merge"], "value")
    placed = written(placed, "placed")
    start = placed.groupBy(*k, "round", "tree").agg(F.min(F.col("upto") - F.col("value")).alias("__start"))
    sized = placed.join(start, [*k, "round", "tree"]).withColumn("size", F.col("upto") - F.col("__start"))
    after = placed.select(*k, "round", "tree", (F.col("rank") - 1).alias("rank"), F.col("merge").alias("__next"))
    joined = written(sized.join(after, [*k, "round", "tree", "rank"], "left").select(*k, F.col("merge").alias("rank"), F.coalesce("__next", "last").alias("parent"), "size"), "tree")
    # the two parts of each merge
    step = lambda c: F.col(c) - F.col("__first")
    n = F.col("__n")
    parts = hung.select(*k, F.col("rank").alias("parent"), "leaf", F.lit(None).cast("long").alias("child"))
    parts = parts.union(joined.where("parent is not null").select(*k, "parent", F.lit(None).cast("long"), F.col("rank").alias("child")))
    parts = with_row(with_row(parts, base, k), firsts.select(*k, "__n"), k).select(*k, F.col("parent").alias("rank"), F.coalesce("leaf", n + step("child")).alias("id"))
    parts = parts.groupBy(*k, "rank").agg(F.min("id").cast("int").alias("a"), F.max("id").cast("int").alias("b"))
    out = with_row(ranked.join(joined.select(*k, "rank", "size"), [*k, "rank"]).join(parts, [*k, "rank"]), base, k)
    links = out.select(*k, step("rank").cast("int").alias("step"), "a", "b", F.col("weight").alias("height"), F.col("size").cast("int").alias("size"), "src", "dst")
    return links, leaves.drop("__n")


def places(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., id, parent, height, size, first, n) of all leaves and clusters of a merge tree: parent, the step that takes it (null at the top);
    height, null for leaves; first, the place of its first leaf from left to right (of each merge first a, then b). links: best a table. If
    they are of several trees, n says how many leaves there are, and a leaf alone has no place.

    Places are sums of what comes before on the way to the top, by doubling: as many rounds as the logarithm of the depth."""
    k, several = list(keys), "n" in links.columns
    numbered = links if several else with_row(links, links.groupBy(*k).agg((F.count("*") + 1).alias("n")), k)
    parts = numbered.select(*k, "n", F.col("step").alias("parent"), F.explode(F.array(F.struct(F.col("a").cast("long").alias("id"), F.lit(0).alias("side")), F.struct(F.col("b").cast("long").alias("id"), F.lit(1).alias("side")))).alias("p"))
    clusters = numbered.select(*k, (F.col("n") + F.col("step")).alias("id"), "height", F.col("size").cast("long").alias("size"))
    parts = parts.select(*k, "n", "parent", "p.*").join(clusters, [*k, "id"], "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    parts = written(parts, "parts")
    left = parts.where("side = 0").select(*k, "parent", F.col("size").alias("__left"))
    up = parts.join(left, [*k, "parent"]).select(*k, F.col("id").alias("c"), (F.col("n") + F.col("parent")).alias("top"), F.when(F.col("side") == 1, F.col("__left")).otherwise(F.lit(0)).cast("long").alias("first"))
    firsts = to_roots(up, k, "first").select(*k, F.col("c").alias("id"), "first", F.col("top").alias("__top"))
    if several:
        tops = numbered.select(*k, (F.col("n") + F.col("step")).alias("id"), "height", F.col("size").cast("long").alias("size"), "n").join(parts.select(*k, "id"), [*k, "id"], "left_anti")
        tops = running(written(tops, "tops"), [*k, "id"], "size").withColumn("first", F.col("upto") - F.col("size"))
        tops = written(tops.select(*k, "id", F.lit(None).cast("int").alias("parent"), "height", "size", "first", "n"), "tops")
        firsts = firsts.join(tops.select(*k, F.col("id").alias("__top"), F.col("first").alias("__base")), [*k, "__top"]).withColumn("first", F.col("first") + F.col("__base"))
        inner = parts.join(firsts, [*k, "id"]).select(*k, "id", "parent", "height", "size", "first", "n")
        return written(inner.unionByName(tops), "places")
    inner = parts.join(firsts, [*k, "id"]).select(*k, "id", "parent", "height", "size", "first", "n")
    top = numbered.groupBy(*k).agg(F.max_by(F.struct((F.col("n") + F.col("step")).alias("id"), "height", F.col("size").cast("long").alias("size"), "n"), "step").alias("t"))
    top = top.where("t is not null").select(*k, "t.id", F.lit(None).cast("int").alias("parent"), "t.height", "t.size", F.lit(0).cast("long").alias("first"), "t.n")
    return written(inner.unionByName(top), "places")


def cut(links: DataFrame, height: float | Column, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Leaves (keys..., leaf, position, cluster, members) of a merge tree cut at a height, and places(); heights grow towards the top.

    Clusters are numbered from 1 through the tree: of a merge over the height first the clusters of those of its parts that are merges
    themselves, then the parts that are leaves. A number is the sum of what is counted before on the way to the top.
    """
    k, limit = list(keys), F.lit(height) if isinstance(height, (int, float)) else height
    tree = places(links, keys)
    over = tree.where(F.col("height") > limit).select(*k, F.col("id").alias("__id"), "n")
    above = over.select(*k, (F.col("__id") - F.col("n")).cast("int").alias("parent"), F.lit(True).alias("__over"))
    seen = written(tree.join(above, [*k, "parent"], "left").withColumns({"__root": (F.col("height").isNull() | (F.col("height") <= limit)) & (F.col("parent").isNull() | F.col("__over"))}), "cut")
    roots = seen.where("__root").select(*k, F.col("id").alias("root"), "first", F.col("size").alias("members"))
    # how many clusters start up to each place
    spots = seen.where("height is null").select(*k, F.col("id").alias("leaf"), F.col("first").alias("position"))
    starts = roots.select(*k, F.col("first").alias("position"), F.col("root"), "members")
    spots = written(spots.join(starts, [*k, "position"], "left").withColumn("__one", F.col("root").isNotNull().cast("long")), "spots")
    upto = written(running(spots, [*k, "position"], "__one").drop("rank", "__one"), "upto")
    begun = upto.select(*k, F.col("position").alias("first"), F.col("upto").alias("__a"))
    ended = upto.select(*k, (F.col("position") + 1).alias("__end"), F.col("upto").alias("__b"))
    # numbers of clusters in what is over the height, and in roots
    counted = seen.where(F.col("__root") | (F.col("height") > limit)).withColumn("__end", F.col("first") + F.col("size"))
    counted = counted.join(begun, [*k, "first"]).join(ended, [*k, "__end"])
    counted = written(counted.select(*k, "id", "parent", "n", F.col("height").isNull().alias("__leaf"), (F.col("__b") - F.col("__a") + 1).alias("count")), "counted")
    # of the parts of a merge: those that are merges first, then leaves
    parts = counted.where("parent is not null")
    pair = parts.groupBy(*k, "parent").agg(F.sort_array(F.collect_list(F.struct("__leaf", "id", "count"))).alias("__parts"))  # two
    before = F.when(F.col("id") == F.col("__parts")[0]["id"], F.lit(0).cast("long")).otherwise(F.col("__parts")[0]["count"])
    up = parts.join(pair, [*k, "parent"]).select(*k, F.col("id").alias("c"), (F.col("n") + F.col("parent")).alias("top"), before.alias("before"))
    label = to_roots(up, k, "before").select(*k, F.col("c").alias("root"), (F.col("before") + 1).alias("cluster"))
    numbers = upto.where("root is not null").join(label, [*k, "root"], "left").select(*k, "upto", F.coalesce("cluster", F.lit(1)).cast("int").alias("cluster"), "members")
    return upto.select(*k, "leaf", "position", "upto").join(numbers, [*k, "upto"]).drop("upto"), tree
