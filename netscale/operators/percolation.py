"""Percolation curves (keys..., idx, th, einf, pinf) and thresholds chosen from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.operators.forest import merge_tree, places, spanning_forest, with_row
from netscale.sources.shared import written


def threshold_at(idx: Column, low: Column, high: Column, steps: int) -> Column:
    """Point idx of a log grid of `steps` points, with both ends exact, and none beyond them by rounding."""
    inner = F.pow(F.lit(10.0), F.log10(low) + idx * ((F.log10(high) - F.log10(low)) / (steps - 1)))
    inner = F.least(high, F.greatest(low, inner))
    return F.when(idx <= 0, low).when(idx >= steps - 1, high).otherwise(inner)


def _bucket(weight: Column, low: Column, high: Column, steps: int) -> Column:
    """The last point of the grid that isn't over the weight."""
    span = F.log10(high) - F.log10(low)
    near = F.coalesce(F.floor(F.try_divide((F.log10(weight) - F.log10(low)) * (steps - 1), span)), F.lit(steps - 1)).cast("int")
    fits = [F.when((near + k <= steps - 1) & (threshold_at(near + k, low, high, steps) <= weight), near + k) for k in (1, 0, -1)]
    return F.greatest(F.coalesce(*fits, near - 2), F.lit(0))


def percolation_curve(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), steps: int = 400) -> DataFrame:
    """Shares of edges and nodes in the giant component over a log grid from the smallest to the largest weight.

    All thresholds are read off the merges of a spanning forest of largest weight: the giant component at a threshold is the largest merge by
    edges of at least that weight (of equal ones that with the smallest node). Its edges are counted by where their first node lies in
    the merge tree. Graphs are tables throughout; what is bounded by `steps` rows a key are the grid and the giants. A key without edges gives
    no rows; one with a weight that isn't positive has no grid, and its th, einf and pinf are null.
    """
    k = list(keys)
    edges = written(edges.select(*k, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")), "edges")
    ends = edges.select(*k, F.explode(F.array("src", "dst")).alias("node"))
    nodes = written(nodes.select(*k, F.col("node").cast("long").alias("node")).union(ends).distinct(), "nodes")
    total = edges.groupBy(*k).agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.count("*").alias("m")).where("m > 0")
    total = written(with_row(total, nodes.groupBy(*k).agg(F.count("*").alias("n")), k), "totals")
    grid = total.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("th", F.when(F.col("low") > 0, threshold_at(F.col("idx"), F.col("low"), F.col("high"), steps)))
    whole = with_row(edges, total.where("low > 0"), k).withColumn("bucket", _bucket(F.col("weight"), F.col("low"), F.col("high"), steps))
    links, leaves = merge_tree(nodes, spanning_forest(edges, k))
    links = written(with_row(links, total.where("low > 0").select(*k, "low", "high", "n"), k).withColumn("bucket", _bucket(F.col("height"), F.col("low"), F.col("high"), steps)).drop("low", "high"), "links")
    place = places(links.select(*k, "step", "a", "b", "height", "size", "n"), k)
    giants = written(_giants(links, leaves, place, k, steps), "giants")

    # stretches of thresholds over which the giant only grows, and the places that it takes in at each
    fall = Window.partitionBy(*k).orderBy(F.desc("idx"))
    end = F.col("first") + F.col("size")
    rows = giants.withColumns({"end": end, "__first": F.lag("first").over(fall), "__end": F.lag(end).over(fall)})
    rows = rows.withColumn("__new", F.coalesce((F.col("first") > F.col("__first")) | (F.col("end") < F.col("__end")), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("__new").cast("int")).over(fall))
    piece = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    own = F.when(F.col("__new"), F.array(piece(F.col("first"), F.col("end")))).otherwise(F.array(piece(F.col("first"), F.col("__first")), piece(F.col("__end"), F.col("end"))))
    pieces = written(rows.select(*k, "run", F.col("idx").alias("entry"), F.explode(own).alias("p")).select(*k, "run", "entry", "p.*").where("from < to"), "pieces")
    spots = place.where("height is null").select(*k, F.col("id").alias("leaf"), F.col("first").alias("position"))
    inside = (F.col("position") >= F.col("from")) & (F.col("position") < F.col("to"))
    held = leaves.join(spots, [*k, "leaf"])
    held = held.join(pieces, k).where(inside) if k else held.join(F.broadcast(pieces), inside)  # without keys 2 * steps rows at most
    held = held.select(*k, F.col("node").alias("src"), "run", "entry")
    count = whole.groupBy(*k, "src", "bucket").agg(F.count("*").alias("count")).join(held, [*k, "src"])
    count = count.groupBy(*k, "run", F.least("bucket", "entry").alias("idx")).agg(F.sum("count").alias("count"))
    upto = F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy(*k, "run").orderBy(F.desc("idx")))
    found = rows.select(*k, "idx", "run", "size").join(count, [*k, "run", "idx"], "left").withColumn("inner", upto)
    curve = grid.join(found.select(*k, "idx", "size", "inner"), [*k, "idx"], "left")
    share = lambda part, of: F.when(F.col("th").isNotNull(), F.coalesce(F.col(part) / F.col(of), F.lit(0.0)))
    return curve.select(*k, "idx", "th", share("inner", "m").alias("einf"), share("size", "n").alias("pinf"))


def _giants(links: DataFrame, leaves: DataFrame, place: DataFrame, k: list[str], steps: int) -> DataFrame:
    """(keys..., idx, first, size) of the giant component at each threshold: where it starts among the places of the merge tree."""
    best = links.groupBy(*k, F.col("bucket").alias("idx")).agg(F.max("size").alias("s"))
    every = links.groupBy(*k).agg(F.max("bucket").alias("top")).where("top is not null").withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("top")))).drop("top")
    fall = Window.partitionBy(*k).orderBy(F.desc("idx"))  # steps rows a key
    largest = written(every.join(best, [*k, "idx"], "left").withColumn("s", F.max("s").over(fall)), "largest")
    sizes = largest.select(*k, F.col("s").alias("size")).distinct()
    some = links.join(sizes, [*k, "size"]).select(*k, "size", (F.col("n") + F.col("step")).alias("id"), "bucket")
    some = written(some.join(place.select(*k, "id", "first"), [*k, "id"]), "candidates")
    # of several of one size, the smallest node; these are apart, so a leaf lies in the one that starts in its cell or the cell before
    tied = some.groupBy(*k, "size").count().where("count > 1").select(*k, "size")
    cells = some.join(tied, [*k, "size"]).select(*k, "size", "id", "first", F.floor(F.col("first") / F.col("size")).alias("cell"))
    spots = leaves.join(place.where("height is null").select(*k, F.col("id").alias("leaf"), F.col("first").alias("position")), [*k, "leaf"])
    spots = spots.join(tied, k) if k else spots.crossJoin(F.broadcast(tied))  # at most steps sizes a key
    cell = F.floor(F.col("position") / F.col("size"))
    spots = spots.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    low = spots.join(cells, [*k, "size", "cell"]).where("position >= first and position < first + size").groupBy(*k, "id").agg(F.min("node").alias("low"))
    some = some.join(low, [*k, "id"], "left")
    chosen = largest.join(some.withColumnRenamed("size", "s"), [*k, "s"]).where("bucket >= idx")
    chosen = chosen.groupBy(*k, "idx").agg(F.min_by(F.struct("first", F.col("s").cast("long").alias("size")), F.coalesce("low", F.lit(0))).alias("g"))
    return chosen.select(*k, "idx", "g.*")


def gradient(y: str, x: str, order: str, keys: Sequence[str] = ()) -> Column:
    """Derivative on an uneven grid: second order inside, first order at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = lambda c, n: F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w)
    back, ahead = F.col(x) - at(x, 1), at(x, -1) - F.col(x)
    rise, fall = at(y, -1) - F.col(y), F.col(y) - at(y, 1)
    inner = F.try_divide(back * F.try_divide(rise, ahead) + ahead * F.try_divide(fall, back), back + ahead)
    return F.coalesce(inner, F.try_divide(rise, ahead), F.try_divide(fall, back))


def elbow(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Where the giant component shrinks fastest."""
    slope = curve.withColumn("g", gradient("pinf", "th", "idx", keys))
    return slope.groupBy(*keys).agg(F.max_by("th", F.struct(-F.col("g"), -F.col("idx"))).alias("th"))


def by_fraction(curve: DataFrame, keys: Sequence[str] = (), fraction: float = 0.95) -> DataFrame:
    """The first threshold at which the giant component is below a share of its first size, else the last threshold."""
    first = curve.groupBy(*keys).agg(F.min_by("pinf", "idx").alias("p0"), F.max_by("th", "idx").alias("last"))
    held = curve.join(first, list(keys)) if keys else curve.crossJoin(F.broadcast(first))
    hit = F.when(F.col("pinf") < fraction * F.col("p0"), F.col("idx"))
    return held.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(hit.isNotNull(), F.col("th")), hit), F.first("last")).alias("th"))


def by_plateau(curve: DataFrame, keys: Sequence[str] = (), tolerance: float = 0.01) -> DataFrame:
    """The last threshold at which the giant component is within a tolerance of its largest size, else the first."""
    top = curve.groupBy(*keys).agg(F.max("pinf").alias("top"), F.min_by("th", "idx").alias("first"))
    held = curve.join(top, list(keys)) if keys else curve.crossJoin(F.broadcast(top))
    hit = F.when(F.col("pinf") >= F.col("top") - tolerance, F.col("idx"))
    return held.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(hit.isNotNull(), F.col("th")), hit), F.first("first")).alias("th"))


def by_target(curve: DataFrame, keys: Sequence[str] = (), percent: float = 80.0) -> DataFrame:
    """The first threshold whose giant share is nearest to a percentage."""
    return curve.groupBy(*keys).agg(F.min_by("th", F.struct(F.abs(100 * F.col("pinf") - percent), "idx")).alias("th"))


def by_crossing(curve: DataFrame, keys: Sequence[str] = (), level: float = 0.99, floor: float = 0.1) -> DataFrame:
    """Where the giant share first falls through a level, interpolated, and at least the floor; the floor if it never does."""
    w = Window.partitionBy(*keys).orderBy("idx")
    step = curve.withColumns({"th2": F.lead("th").over(w), "p2": F.lead("pinf").over(w)})
    at = F.col("th") + (level - F.col("pinf")) * F.try_divide(F.col("th2") - F.col("th"), F.col("p2") - F.col("pinf"))
    at = F.when((F.col("pinf") >= level) & (F.col("p2") < level), at)
    return step.withColumn("at", at).groupBy(*keys).agg(F.greatest(F.min_by("at", F.when(F.col("at").isNotNull(), F.col("idx"))), F.lit(floor)).alias("th"))
