"""Correlation matrices as coordinate tables (keys..., i, j, r) with i < j, and how they become edges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netscale.functions.columns import no_nan
from netscale.operators.series import SERIES, transpose
from netscale.sources.shared import written


#: Series in a block as long as there are few blocks, blocks from which on they get larger, and doubles in a block at most.
ROWS, BLOCKS, DOUBLES = 1024, 8, 2_000_000


def correlation(df: DataFrame, keys: Sequence[str] = (), digits: int | None = 12, least: float | None = None, rows: int = ROWS) -> DataFrame:
    """(keys..., i, j, r) of all pairs of series of a key; null where one is constant, or has null or too few samples.

    Series (samples by t, all of a key at the same times) are packed into blocks of unit vectors: matrices of `rows` series, or of so many
    that there are BLOCKS blocks if that is more, and of DOUBLES numbers at most. Each two blocks meet in a join, and their product is one matrix
    multiplication; so a key's series are sent BLOCKS times, until n samples of length t make n t / DOUBLES more than that. least: smaller values of r (nulls too) don't leave the task. digits: r is rounded, so that
    thresholds don't depend on the order of sums.
    """
    k = list(keys)
    vector = F.transform(F.array_sort(F.collect_list(F.struct("t", F.col("value").cast("double").alias("value")))), lambda x: x["value"])
    packed = written(df.groupBy(*k, SERIES).agg(vector.alias("v")), "packed")
    size = packed.groupBy(*k).agg(F.count("*").alias("__n"), F.max(F.size("v")).alias("__t"))
    packed = packed.join(size, k) if k else packed.crossJoin(F.broadcast(size))
    fit = F.greatest(F.lit(1), F.least(F.greatest(F.lit(rows), F.ceil(F.col("__n") / BLOCKS)), F.floor(DOUBLES / F.greatest("__t", F.lit(1)))))
    packed = packed.withColumn("__blocks", F.ceil(F.col("__n") / fit).cast("int")).withColumn("__block", F.pmod(F.xxhash64(SERIES), F.col("__blocks")).cast("int"))
    kind = df.schema[SERIES].dataType
    fields = [df.schema[c] for c in k]
    schema = T.StructType([*fields, T.StructField("__block", T.IntegerType()), T.StructField("__blocks", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("m", T.BinaryType())])
    blocks = written(packed.groupBy(*k, "__block", "__blocks").applyInArrow(_block(k), schema), "blocks")
    a = blocks.select(*k, F.col("__block").alias("p"), F.explode(F.sequence(F.col("__block"), F.col("__blocks") - 1)).alias("q"), F.col("ids").alias("a"), F.col("m").alias("ma"))
    b = blocks.select(*k, F.col("__block").alias("q"), F.explode(F.sequence(F.lit(0), F.col("__block"))).alias("p"), F.col("ids").alias("b"), F.col("m").alias("mb"))
    pairs = a.join(b, [*k, "p", "q"]).select(*k, "a", "ma", "b", "mb", F.expr("p = q").alias("own"))
    out = T.StructType([*fields, T.StructField("i", kind), T.StructField("j", kind), T.StructField("r", T.DoubleType())])
    return pairs.mapInArrow(_products(k, digits, least), out)


def _block(k: list[str]):
    """The series of a block as one matrix of unit vectors; NaN where a series has no direction."""

    def run(table: pa.Table) -> pa.Table:
        length = table["__t"][0].as_py()
        m = np.full((table.num_rows, length), np.nan)
        for row, v in enumerate(table["v"].combine_chunks()):
            x = v.values.to_numpy(zero_copy_only=False)
            if len(x) == length and length and x.min() < x.max():  # a null is NaN here
                x = x - x.mean()
                m[row] = x / np.sqrt(x @ x)
        columns = [*(table[c].slice(0, 1) for c in [*k, "__block", "__blocks"]), pa.array([table[SERIES].to_pylist()], pa.list_(table.schema.field(SERIES).type)), pa.array([m.tobytes()], pa.binary())]
        return pa.table(columns, [*k, "__block", "__blocks", "ids", "m"])

    return run


def _products(k: list[str], digits: int | None, least: float | None):
    """The correlations of each two blocks, or within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(batch.schema.get_field_index(c))[row] for c in "ab")
                ids_a, ids_b, own = a.values, b.values, batch.column(batch.schema.get_field_index("own"))[row].as_py()
                x, y = (np.frombuffer(batch.column(batch.schema.get_field_index(c))[row].as_buffer()).reshape(len(ids), -1) for c, ids in (("ma", ids_a), ("mb", ids_b)))
                step = max(1, DOUBLES // max(1, len(ids_b)))
                for at in range(0, len(ids_a), step):
                    r = np.clip(x[at : at + step] @ y.T, -1, 1)
                    if digits is not None:
                        r = np.round(r, digits)
                    keep = np.ones(r.shape, bool) if least is None else r >= least
                    if own:
                        keep &= np.arange(r.shape[1]) > np.arange(at, at + len(r))[:, None]
                    p, q = np.nonzero(keep)
                    i, j = ids_a.take(pa.array(p + at)), ids_b.take(pa.array(q))
                    swap = pc.greater(i, j)
                    r = r[p, q]
                    columns = [pa.repeat(batch.column(batch.schema.get_field_index(c))[row], len(r)) for c in k]
                    yield pa.record_batch([*columns, pc.if_else(swap, j, i), pc.if_else(swap, i, j), pa.array(r, mask=np.isnan(r))], [*k, "i", "j", "r"])

    return run


def correlation_by_sums(df: DataFrame, keys: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """The same by an equi-join on t and grouped moments: for few long series."""
    a = df.select(*keys, "t", F.col(SERIES).alias("i"), F.col("value").alias("x"))
    b = df.select(*keys, "t", F.col(SERIES).alias("j"), F.col("value").alias("y"))
    moments = a.join(b, [*keys, "t"]).where("i < j").groupBy(*keys, "i", "j")
    return moments.agg(F.round(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), digits).alias("r"))


def correlation_of_times(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation between times, over series."""
    return correlation(transpose(df), keys)


def full_matrix(corr: DataFrame, ids: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both triangles and a diagonal of ones (ids: keys..., series_id)."""
    diagonal = ids.select(*keys, F.col(SERIES).alias("i"), F.col(SERIES).alias("j"), F.lit(1.0).alias("r"))
    return corr.unionByName(corr.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "r")).unionByName(diagonal)


def as_series(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A full matrix as series: each row is a profile."""
    return matrix.select(*keys, F.col("i").alias(SERIES), F.col("j").alias("t"), F.col("r").alias("value"))


def clean(corr: DataFrame, remove_negative: bool = True, regularize: bool = True, threshold: float | None = None) -> DataFrame:
    """Negative values to 0, then null and NaN to 0, then what is strictly below the threshold to 0."""
    r = no_nan(F.col("r"))
    if remove_negative:
        r = F.when(r < 0, 0.0).otherwise(r)
    if regularize:
        r = F.coalesce(r, F.lit(0.0))
    if threshold is not None:
        r = F.when(r < threshold, 0.0).otherwise(r)
    return corr.withColumn("r", r)


def edges_of(corr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells above the diagonal that aren't 0, as weighted edges."""
    return corr.where("i < j and r <> 0").select(*keys, F.col("i").alias("src"), F.col("j").alias("dst"), F.col("r").alias("weight"))


def mean_matrix(corr: DataFrame, over: Sequence[str]) -> DataFrame:
    """Mean of each cell over what `over` doesn't name; null if any part is."""
    return corr.groupBy(*over, "i", "j").agg(F.when(F.count("r") == F.count("*"), F.avg("r")).alias("r"))


def mean_signal(df: DataFrame, over: Sequence[str] = ()) -> DataFrame:
    """Mean of each series' sample over what `over` doesn't name."""
    return df.groupBy(*over, SERIES, "t").agg(F.avg("value").alias("value"))


def summary(corr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """min, mean, max and population deviation of cells."""
    return corr.groupBy(*keys).agg(F.min("r").alias("r_min"), F.avg("r").alias("r_mean"), F.max("r").alias("r_max"), F.stddev_pop("r").alias("r_std"))


def count_zeros(corr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells above the diagonal that are exactly 0."""
    return corr.where("i < j").groupBy(*keys).agg(F.count_if(F.col("r") == 0).alias("n_zero"), F.count("*").alias("n_cells"))
