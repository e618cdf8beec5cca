"""Statistical validation of pairs (keys..., i, j, p), and histograms."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.sources.shared import written


def correlation_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r of n samples: Student's distribution of n - 2 degrees, by its finite sum. Null for fewer than 3.

    With sin t = |r|, the probability of less is, for even degrees, sin t times the sum of (2k)! / (2^k k!)^2 cos^2k t, and for odd ones 2 / pi
    (t + sin t times the sum of (2^k k!)^2 / (2k + 1)! cos^(2k+1) t), k from 0 to half the degrees less 1 (and a half).
    """
    df, c = (n - 2).cast("int"), 1 - r * r
    even = df % 2 == 0
    terms = F.when(df >= 2, F.sequence(F.lit(1), F.greatest(F.floor(df / 2), F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    grown = lambda s, k: F.struct((s["term"] * c * F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    start = F.struct(F.when(even, F.lit(1.0)).otherwise(F.sqrt(c)).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(terms, start, grown, lambda s: s["sum"])
    less = F.when(even, F.abs(r) * total).otherwise((F.asin(F.abs(r)) + F.abs(r) * total) * 2 / F.pi())
    return F.when(df >= 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - less)))


def fdr(pairs: DataFrame, alpha: float, keys: Sequence[str] = (), total: int | None = None) -> DataFrame:
    """Pairs with rank, threshold and accepted, by Benjamini and Hochberg over i < j. Ties go by (i, j).

    threshold is the largest rank's alpha * rank / n that a p-value reaches; null, and nothing accepted, if none does. n is total, if pairs are
    only those with a small p, or else the number of pairs. With keys, a task ranks the pairs of a key. Without, ranges of (p, i, j) are
    ranked apart, and only the ranges' sizes and the threshold reach the driver.
    """
    upper = pairs.where("i < j")
    if keys:
        w = Window.partitionBy(*keys)
        n = F.count("*").over(w) if total is None else F.lit(total)
        ranked = upper.withColumns({"rank": F.row_number().over(w.orderBy("p", "i", "j")).cast("long"), "n": n})
        line = F.col("rank") * alpha / F.col("n")
        held = ranked.withColumn("threshold", F.max(F.when(F.col("p") <= line, line)).over(w))
    else:
        ranked, n = ranked_by(upper, ["p", "i", "j"])
        line = F.col("rank") * alpha / F.lit(n if total is None else total)
        held = ranked.withColumn("threshold", F.lit(ranked.agg(F.max(F.when(F.col("p") <= line, line))).first()[0]).cast("double"))
    return held.withColumn("accepted", F.coalesce(F.col("p") <= F.col("threshold"), F.lit(False))).select(*keys, "i", "j", "p", "rank", "threshold", "accepted")


def ranked_by(rows: DataFrame, order: Sequence[str], ranges: int = 256, sample: int = 20_000) -> tuple[DataFrame, int]:
    """rows with `rank` (long, from 1) by the columns of `order` among all, and their number; read up to three times: best a table.

    Up to `sample` rows are ranked by one task. More are dealt to ranges of all columns, so that ties in the first one are dealt out too, and each is
    numbered in its range's order; only the ranges' sizes reach the driver.
    """
    n = rows.count()
    if n <= sample:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long")), n
    # the number of a row's range, and below its 33rd bit that of the row there
    ranged = written(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    place, low = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    sizes = sorted(ranged.groupBy(place.alias("range")).count().collect())
    before = dict(zip([k for k, _ in sizes], [0, *itertools.accumulate(c for _, c in sizes)], strict=False))
    start = F.element_at(F.create_map(*[F.lit(x) for k, c in before.items() for x in (k, c)]), place).cast("long")
    return ranged.withColumn("rank", low + start + 1).drop("__at"), n


def below(pairs: DataFrame, alpha: float) -> DataFrame:
    """Pairs with p strictly below alpha; of a full matrix, both triangles."""
    return pairs.where(F.col("p") < alpha)


def mask(pairs: DataFrame, accepted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs with 1 for those that are accepted and 0 for others."""
    hit = accepted.select(*keys, "i", "j", F.lit(1).alias("valid"))
    return pairs.join(hit, [*keys, "i", "j"], "left").withColumn("valid", F.coalesce("valid", F.lit(0)))


def histogram(values: DataFrame, column: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., bin, low, high, density) of even bins from the smallest to the largest value, the last closed on both sides."""
    ends = values.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(column).alias("n")).where("n > 0")
    some = values.where(F.col(column).isNotNull())
    held = some.join(ends, list(keys)) if keys else some.crossJoin(F.broadcast(ends))  # a row for each key, or one
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    count = held.groupBy(*keys, at.alias("bin"), "a", "b", "n").agg(F.count("*").alias("count"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(count, [*keys, "bin", "a", "b", "n"], "left")
    width = (F.col("b") - F.col("a")) / bins
    density = F.try_divide(F.coalesce("count", F.lit(0)), F.col("n") * width)
    return full.select(*keys, "bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), density.alias("density"))
