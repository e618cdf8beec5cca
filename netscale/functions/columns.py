"""Scalar column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def greeting(name: Column) -> Column:
    """A greeting to a brain by name."""
    return F.format_string("Hello, %s!", name)


def marchenko_pastur(value: Column, ratio: Column) -> Column:
    """Density of eigenvalues of a random correlation matrix; ratio: series by samples. Null at 0."""
    low, high = F.pow(1 - F.sqrt(ratio), 2), F.pow(1 + F.sqrt(ratio), 2)
    inside = F.greatest(high - value, F.lit(0.0)) * F.greatest(value - low, F.lit(0.0))
    return F.try_divide(F.sqrt(inside), 2 * math.pi * ratio * value)


def fft_frequency(k: Column, n: Column, rate: Column) -> Column:
    """Frequency of bin k of n at a sampling rate; the upper half is negative."""
    return F.when(2 * k < n, k).otherwise(k - n) * rate / n


def in_band(frequency: Column, low: Column, high: Column) -> Column:
    """Whether the absolute frequency lies in a band, edges included."""
    return F.abs(frequency).between(low, high)


def no_nan(value: Column) -> Column:
    """NaN as null: Spark takes NaN for the largest number."""
    return F.when(~F.isnan(value), value)


def grid(spark: SparkSession, low: float, high: float, steps: int, log: bool = True) -> DataFrame:
    """(idx, x): evenly or logarithmically spaced, both ends exact. For log grids the ends are exponents of 10."""
    at = F.lit(float(low)) + F.col("idx") * ((float(high) - float(low)) / (steps - 1))
    at = F.when(F.col("idx") == steps - 1, F.lit(float(high))).otherwise(at)
    return spark.range(steps).select(F.col("id").cast("int").alias("idx")).withColumn("x", F.pow(F.lit(10.0), at) if log else at)
