"""How nodes move between communities over stages: tables (keys..., stage, tau, node, community)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.operators.forest import to_roots, with_row
from netscale.operators.stats import ranked_by
from netscale.sources.shared import written


def histories(partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, history): its (stage, tau, community) by stage."""
    entry = F.struct(F.col("stage").cast("int").alias("stage"), F.col("tau").cast("double").alias("tau"), F.col("community").cast("int").alias("community"))
    return partition.groupBy(*keys, "node").agg(F.array_sort(F.collect_list(entry)).alias("history"))


def switching_nodes(partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Histories of nodes with more than one label."""
    return histories(partition, keys).where("size(array_distinct(transform(history, h -> h.community))) > 1")


def moved_nodes(history: DataFrame, source: int) -> DataFrame:
    """Nodes whose first label is the source and that leave it: when, where to, and their history."""
    first = F.expr(f"filter(history, h -> h.community != {int(source)})[0]")
    gone = history.where(F.expr(f"history[0].community = {int(source)} and exists(history, h -> h.community != {int(source)})"))
    return gone.withColumn("m", first).withColumns({"tau_move": F.col("m.tau"), "new_cluster": F.col("m.community")}).drop("m")


def moved_nodes_interval(history: DataFrame, source: int, tau_i: float | None = None, tau_f: float | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Nodes in the source at tau_i and elsewhere at tau_f. The last entry strictly within the tolerance of a tau counts; nodes without
    one are left out. By default the first two taus of the history with the smallest node."""
    if tau_i is None or tau_f is None:
        head = history.orderBy("node").select(F.expr("transform(history, h -> h.tau)").alias("taus")).first()
        if head is None or len(head.taus) < 2:
            raise ValueError("a history of two stages is needed for default taus")
        tau_i, tau_f = (head.taus[0] if tau_i is None else tau_i), (head.taus[1] if tau_f is None else tau_f)
    at = lambda tau: F.expr(f"try_element_at(filter(history, h -> abs(h.tau - {float(tau)!r}D) < {float(tolerance)!r}D), -1).community")
    ends = history.withColumns({"tau_i_cluster": at(tau_i), "tau_f_cluster": at(tau_f)})
    return ends.where((F.col("tau_i_cluster") == source) & (F.col("tau_f_cluster") != source))


def sizes(partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return partition.groupBy(*keys, "stage", "community").agg(F.count("*").alias("size"))


def flows(partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., stage, source, target, count) of nodes between neighbouring stages."""
    w = Window.partitionBy(*keys, "node").orderBy("stage")
    step = partition.withColumns({"target": F.lead("community").over(w)}).where("target is not null")
    return step.groupBy(*keys, "stage", F.col("community").alias("source"), "target").agg(F.count("*").alias("count"))


def sankey(partition: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, stage, community, label), numbered by stage and community from 0, and links (source_id, target_id, count)."""
    w = Window.partitionBy(*keys).orderBy("stage", "community")
    nodes = partition.groupBy(*keys, "stage", "community").agg(F.first("tau").alias("tau"))
    label = F.concat(F.lit("τ="), F.col("tau").cast("string"), F.lit(": Cluster "), F.col("community").cast("string"))
    nodes = nodes.withColumns({"id": F.row_number().over(w) - 1, "label": label})
    stages = partition.select(*keys, "stage").distinct().withColumn("next", F.lead("stage").over(Window.partitionBy(*keys).orderBy("stage")))
    links = flows(partition, keys).join(stages, [*keys, "stage"])
    a = nodes.select(*keys, "stage", F.col("community").alias("source"), F.col("id").alias("source_id"))
    b = nodes.select(*keys, F.col("stage").alias("next"), F.col("community").alias("target"), F.col("id").alias("target_id"))
    return nodes.select(*keys, "id", "stage", "community", "label"), links.join(a, [*keys, "stage", "source"]).join(b, [*keys, "next", "target"]).select(*keys, "stage", "source_id", "target_id", "count")


def sankey_layout(partition: DataFrame, keys: Sequence[str] = (), height: float = 1.0, gap: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Blocks (stage, community, size, x, bottom, top), stacked by community, and each node's place (x, low, high) in its block."""
    stage = Window.partitionBy(*keys, "stage")
    block = sizes(partition, keys).withColumns({"n": F.sum("size").over(stage), "upto": F.sum("size").over(stage.orderBy("community").rowsBetween(Window.unboundedPreceding, 0))})
    unit = F.lit(height) / F.col("n")
    block = block.withColumns({"x": F.col("stage") * gap, "bottom": (F.col("upto") - F.col("size")) * unit, "top": F.col("upto") * unit})
    slot = F.row_number().over(Window.partitionBy(*keys, "stage", "community").orderBy("node")) - 1
    nodes = partition.withColumn("slot", slot).join(block, [*keys, "stage", "community"])
    low = F.col("bottom") + F.col("slot") * unit
    places = nodes.select(*keys, "stage", "node", "community", "x", low.alias("low"), (low + unit).alias("high"))
    return block.select(*keys, "stage", "community", "size", "x", "bottom", "top"), places


def ribbons(partition: DataFrame, keys: Sequence[str] = (), height: float = 1.0, gap: float = 1.0) -> DataFrame:
    """(keys..., node, stage, x0, low0, high0, x1, low1, high1): each node's band between neighbouring stages."""
    w = Window.partitionBy(*keys, "node").orderBy("stage")
    places = sankey_layout(partition, keys, height, gap)[1]
    ahead = {f"{c}1": F.lead(c).over(w) for c in ("x", "low", "high")}
    out = places.withColumns(ahead).where("x1 is not null")
    return out.select(*keys, "node", "stage", F.col("x").alias("x0"), F.col("low").alias("low0"), F.col("high").alias("high0"), "x1", "low1", "high1")


def canonical(partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Communities renamed to their smallest node, so that labels of different stages can be compared."""
    return partition.withColumn("community", F.min("node").over(Window.partitionBy(*keys, "stage", "community")))


def carried(partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., stage, node, community, colour): a node keeps the colour that it had in the stage before; one that wasn't there takes its
    community's. So colour is the community in which the node's present run of stages began."""
    order = _numbered_stages(partition, keys)
    rows = partition.select(*keys, "stage", "node", "community").join(order, [*keys, "stage"])
    own = Window.partitionBy(*keys, "node").orderBy("stage")
    rows = rows.withColumn("__new", F.coalesce(F.col("__order") - F.lag("__order").over(own) > 1, F.lit(True)))
    start = F.last(F.when(F.col("__new"), F.col("community")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("colour", start).select(*keys, "stage", "node", "community", "colour")


def _numbered_stages(partition: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., stage, __order) of the few stages of a key."""
    stages = partition.select(*keys, "stage").distinct()
    return stages.withColumn("__order", F.row_number().over(Window.partitionBy(*keys).orderBy("stage")))


def lineages(partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., stage, community, lineage) of communities over stages: one goes on in the next stage's community with which it shares most nodes,
    if that shares most nodes with it too (of equal ones the smaller label counts); others begin, and get the next number from 1, by stage and
    community. Chains of stages are followed by pointer doubling."""
    k = list(keys)
    rows = partition.select(*k, "stage", "node", "community").join(_numbered_stages(partition, keys), [*k, "stage"])
    after = rows.select(*k, "node", (F.col("__order") - 1).alias("__order"), F.col("community").alias("target"))
    shared = written(rows.join(after, [*k, "node", "__order"]).groupBy(*k, "__order", F.col("community").alias("source"), "target").agg(F.count("*").alias("n")), "shared")
    best = lambda by, of: shared.groupBy(*k, "__order", by).agg(F.min_by(of, F.struct(-F.col("n"), of)).alias(of))
    pairs = best("target", "source").join(best("source", "target"), [*k, "__order", "source", "target"])
    place = lambda order, name: F.struct(order.alias("order"), F.col(name).alias("community"))
    up = pairs.select(*k, place(F.col("__order") + 1, "target").alias("c"), place(F.col("__order"), "source").alias("top"))
    ends = to_roots(up, k)
    own = written(rows.select(*k, "stage", place(F.col("__order"), "community").alias("c")).distinct(), "communities")
    whose = written(own.join(ends, [*k, "c"], "left").withColumn("top", F.coalesce("top", "c")), "lineages")
    begun = written(whose.select(*k, "top").distinct(), "begun")
    ranked, _ = ranked_by(begun, [*k, "top"])
    first = ranked.groupBy(*k).agg(F.min("rank").alias("__first"))
    number = with_row(written(ranked, "ranked"), first, k).select(*k, "top", (F.col("rank") - F.col("__first") + 1).alias("lineage"))
    return whose.join(number, [*k, "top"]).select(*k, "stage", F.col("c.community").alias("community"), "lineage")
