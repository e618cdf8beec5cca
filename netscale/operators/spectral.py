"""Spectra, diffusion density matrices, spectral entropy and diffusion distance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.functions import kernels
from netscale.functions.columns import grid, marchenko_pastur
from netscale.operators.graph import split, with_nodes
from netscale.operators.series import per_key


def laplacian_spectrum(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., k, lambda) ascending."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own, src, dst, weight = split(frame)
        values = np.linalg.eigvalsh(kernels.dense_laplacian(own, src, dst, weight))
        return pd.DataFrame({"k": np.arange(len(values), dtype=np.int32), "lambda": values})

    return per_key(with_nodes(nodes, edges, keys), keys, run, "k int, lambda double")


def matrix_spectrum(corr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., k, lambda) ascending, of the symmetric matrix with ones on the diagonal and nulls as 0."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[frame["i"].to_numpy(), frame["j"].to_numpy()])
        m = np.eye(len(ids))
        a, b, r = np.searchsorted(ids, frame["i"]), np.searchsorted(ids, frame["j"]), np.nan_to_num(frame["r"].to_numpy(float))
        m[a, b] = m[b, a] = r
        values = np.linalg.eigvalsh(m)
        return pd.DataFrame({"k": np.arange(len(values), dtype=np.int32), "lambda": values})

    return per_key(corr.select(*keys, "i", "j", "r"), keys, run, "k int, lambda double")


def random_matrix_density(values: DataFrame, n_series: int, n_samples: int) -> DataFrame:
    """values (x) with the density that eigenvalues would have without correlation, and whether x lies beyond its upper edge."""
    ratio = F.lit(n_series / n_samples)
    return values.withColumns({"density": marchenko_pastur(F.col("x"), ratio), "beyond": F.col("x") > F.pow(1 + F.sqrt(ratio), 2)})


def densities(nodes: DataFrame, edges: DataFrame, taus: Sequence[float], keys: Sequence[str] = (), density: Callable[[float, np.ndarray], np.ndarray] = kernels.density) -> DataFrame:
    """(keys..., tau, i, j, rho), both triangles: exp(-tau L) over its trace, or density(tau, L), all taus from one Laplacian."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own, src, dst, weight = split(frame)
        m, parts = kernels.dense_laplacian(own, src, dst, weight), []
        for tau in taus:
            parts.append(pd.DataFrame({"tau": float(tau), "i": np.repeat(own, len(own)), "j": np.tile(own, len(own)), "rho": density(tau, m).reshape(-1)}))
        return pd.concat(parts)

    return per_key(with_nodes(nodes, edges, keys), keys, run, "tau double, i long, j long, rho double")


def diffusion_distance(rho: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., tau, i, j, d) with i < j: the larger of 1 / rho of both directions; null where rho isn't positive."""
    ways = rho.select(*keys, "tau", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "rho").where("i < j")
    return ways.groupBy(*keys, "tau", "i", "j").agg(F.when(F.min("rho") > 0, 1 / F.min("rho")).alias("d"))


def entropy_curve(spectrum: DataFrame, keys: Sequence[str] = (), steps: int = 600, low: float = -2, high: float = 5) -> DataFrame:
    """(keys..., idx, tau, one_minus_s, c, var_l): spectral entropy, specific heat (null on the last tau) and variance of the Laplacian.

    spectrum: (keys..., lambda), or with a weight, as lanczos_spectrum gives it. The tau grid is of a fixed size and broadcast; each eigenvalue
    meets each tau, and sums are grouped.
    """
    taus = grid(spectrum.sparkSession, low, high, steps).withColumnRenamed("x", "tau")
    weight = F.col("weight") if "weight" in spectrum.columns else F.lit(1.0)
    known = spectrum.select(*keys, "lambda", weight.alias("weight"))
    ends = known.groupBy(*keys).agg(F.min("lambda").alias("low"), F.sum("weight").alias("n"))
    held = (known.join(ends, list(keys)) if keys else known.crossJoin(F.broadcast(ends))).crossJoin(F.broadcast(taus))  # a row a key; a fixed grid
    # weights are taken relative to the smallest eigenvalue, which cancels
    e = held.withColumn("u", F.col("lambda") - F.col("low")).withColumn("w", F.col("weight") * F.exp(-F.col("tau") * F.col("u")))
    z = e.groupBy(*keys, "idx", "tau", "n").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("u")).alias("u1"), F.sum(F.col("w") * F.col("u") * F.col("u")).alias("u2"))
    mean = F.col("u1") / F.col("z")
    s = (F.col("tau") * mean + F.ln("z")) / F.ln("n")
    rows = z.withColumns({"one_minus_s": 1 - s, "var_l": F.col("u2") / F.col("z") - mean * mean})
    w = Window.partitionBy(*keys).orderBy("idx")
    c = F.ln("n") * (F.lead("one_minus_s").over(w) - F.col("one_minus_s")) / (F.ln(F.lead("tau").over(w)) - F.ln("tau"))
    return rows.withColumn("c", c).select(*keys, "idx", "tau", "one_minus_s", "c", "var_l")
