"""Operators on long-format series: (keys..., series_id, t, value)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from netscale.functions import kernels
from netscale.functions.columns import fft_frequency, in_band
from netscale.operators import longseries

SERIES = "series_id"


def per_key(df: DataFrame, keys: Sequence[str], run, columns: str) -> DataFrame:
    """run(frame of one key) -> frame with the given columns ('a int, b double'); the key's values are put in front."""
    held = df if keys else df.withColumn("__all", F.lit(0))
    names = list(keys) or ["__all"]
    fields = [held.schema[k] for k in names] + T._parse_datatype_string(columns).fields
    order = [f.name for f in fields]

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = run(frame)
        for name, value in zip(names, key, strict=True):
            out[name] = value
        return out[order]

    return held.groupBy(*names).applyInPandas(one, T.StructType(fields)).drop("__all")


def densify(df: DataFrame, keys: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """Every series at every t of its key; what was missing (or null) is filled. df is read three times: best a table."""
    ids, ts = df.select(*keys, SERIES).distinct(), df.select(*keys, "t").distinct()
    full = ids.join(ts, list(keys)) if keys else ids.crossJoin(ts)
    return full.join(df, [*keys, SERIES, "t"], "left").select(*keys, SERIES, "t", F.coalesce("value", F.lit(fill)).alias("value"))


def drop_zero_series(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Without the series whose values sum to 0."""
    zero = df.groupBy(*keys, SERIES).agg(F.sum("value").alias("s")).where("s = 0").select(*keys, SERIES)
    return df.join(zero, [*keys, SERIES], "left_anti")


def center(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each value less its series' mean."""
    return df.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys, SERIES)))


def zscore(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Centred and divided by the population deviation; null for a constant series."""
    w = Window.partitionBy(*keys, SERIES)
    return df.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)))


def transpose(df: DataFrame) -> DataFrame:
    """Series and times trade places."""
    return df.select(*[F.col(c).alias({SERIES: "t", "t": SERIES}.get(c, c)) for c in df.columns])


def pivot_wide(df: DataFrame, ids: Sequence[int], keys: Sequence[str] = (), prefix: str = "Signal") -> DataFrame:
    """A row for each t and a column for each of the given series."""
    wide = df.groupBy(*keys, "t").pivot(SERIES, list(ids)).agg(F.first("value"))
    return wide.select(*keys, F.col("t").alias("time"), *[F.col(f"`{i}`").alias(f"{prefix}{i}") for i in ids])


def window_of(df: DataFrame, low: int, high: int, ids: Sequence[int] | None = None) -> DataFrame:
    """The slice low <= t < high, of some series or all."""
    out = df.where((F.col("t") >= low) & (F.col("t") < high))
    return out.where(F.col(SERIES).isin(*ids)) if ids else out


#: Samples of a series that one task may hold.
WHOLE = 1_000_000


def dft(df: DataFrame, keys: Sequence[str] = (), rate: float = 1.0, whole: int = WHOLE) -> DataFrame:
    """(keys..., series_id, k, n, freq, re, im) of each series, whose samples go by t. One fast transform a series of at most `whole` samples; longer
    ones in four steps over two shuffles, of which a task holds about the root of their length."""
    df, long = longseries.is_long(df, keys, whole)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        z = np.fft.fft(frame.sort_values("t")["value"].to_numpy(float))
        return pd.DataFrame({"k": np.arange(len(z), dtype=np.int32), "n": np.int32(len(z)), "re": z.real, "im": z.imag})

    out = per_key(df, [*keys, SERIES], run, "k int, n int, re double, im double")
    if not long.isEmpty():
        out = out.unionByName(longseries.transformed(long, keys))
    return out.withColumn("freq", fft_frequency(F.col("k"), F.col("n"), F.lit(rate)))


def dft_by_sums(df: DataFrame, keys: Sequence[str] = (), rate: float = 1.0) -> DataFrame:
    """The same as dft by sums alone, for short series: n rows for each sample."""
    w = Window.partitionBy(*keys, SERIES)
    at = df.withColumns({"n": F.count("*").over(w).cast("int"), "i": F.row_number().over(w.orderBy("t")) - 1})
    each = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    angle = 2 * np.pi * ((F.col("k").cast("long") * F.col("i")) % F.col("n")) / F.col("n")
    out = each.groupBy(*keys, SERIES, "k", "n").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), (-F.sum(F.col("value") * F.sin(angle))).alias("im"))
    return out.withColumn("freq", fft_frequency(F.col("k"), F.col("n"), F.lit(rate)))


def spectrum_filter(spectrum: DataFrame, bands: DataFrame) -> DataFrame:
    """Bins of each band (band, lo, hi), edges included; bands are few and broadcast."""
    return spectrum.join(F.broadcast(bands), in_band(F.col("freq"), F.col("lo"), F.col("hi")))


def non_negative(spectrum: DataFrame) -> DataFrame:
    return spectrum.where("freq >= 0")


def magnitude(spectrum: DataFrame) -> DataFrame:
    return spectrum.withColumn("magnitude", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def amplitude_spectrum(spectrum: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean magnitude over series of each bin at a frequency of 0 or more."""
    return magnitude(non_negative(spectrum)).groupBy(*keys, "k", "freq").agg(F.avg("magnitude").alias("amplitude"))


def ideal_band_filter(df: DataFrame, bands: DataFrame, keys: Sequence[str] = (), rate: float = 1.0) -> DataFrame:
    """(keys..., series_id, band, t, value): each series with the bins outside a band set to 0. One transform for all bands."""
    bounds = [(r.band, float(r.lo), float(r.hi)) for r in bands.select("band", "lo", "hi").collect()]  # a dimension of a few rows

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        z, f = np.fft.fft(frame["value"].to_numpy(float)), np.abs(np.fft.fftfreq(len(frame), 1 / rate))
        parts = [pd.DataFrame({"band": b, "t": frame["t"].to_numpy(), "value": np.fft.ifft(np.where((f >= lo) & (f <= hi), z, 0)).real}) for b, lo, hi in bounds]
        return pd.concat(parts) if parts else pd.DataFrame({"band": [], "t": [], "value": []})

    return per_key(df, [*keys, SERIES], run, f"band string, t {df.schema['t'].dataType.simpleString()}, value double")


def band_power(filtered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over series of their population variance, for each band."""
    each = filtered.groupBy(*keys, "band", SERIES).agg(F.var_pop("value").alias("power"))
    return each.groupBy(*keys, "band").agg(F.avg("power").alias("power"))


def butterworth(df: DataFrame, low: float, high: float, rate: float = 1.0, order: int = 4, keys: Sequence[str] = (), kind: str = "bandpass", whole: int = WHOLE) -> DataFrame:
    """Zero-phase Butterworth filter of each series. Null where a series isn't longer than the padding (27 samples for a band of order 4).

    A task filters a series of at most `whole` samples; longer ones go by segments, whose states are put together."""
    b, a = kernels.butter_bandpass(low, high, rate, order, kind)
    pad = 3 * len(b)
    df, long = longseries.is_long(df, keys, whole)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        x = frame["value"].to_numpy(float)
        return pd.DataFrame({"t": frame["t"], "value": kernels.band_filter(x, low, high, rate, order, kind)[0] if len(x) > pad else None})

    out = per_key(df, [*keys, SERIES], run, f"t {df.schema['t'].dataType.simpleString()}, value double")
    return out if long.isEmpty() else out.unionByName(longseries.filtered(long, b, a, keys))


def hilbert(df: DataFrame, rate: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Instantaneous phase, frequency, amplitude and period (1 / frequency) of each series."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        phase, frequency, amplitude = kernels.hilbert_frequency(frame["value"].to_numpy(float), rate)
        return pd.DataFrame({"t": frame["t"], "phase": phase, "frequency": frequency, "amplitude": amplitude})

    out = per_key(df, [*keys, SERIES], run, f"t {df.schema['t'].dataType.simpleString()}, phase double, frequency double, amplitude double")
    return out.withColumn("period", F.try_divide(F.lit(1.0), F.col("frequency")))


def modes(df: DataFrame, most: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., series_id, mode, t, value): empirical modes of each series, from fast to slow; the last is what is left."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        found = kernels.sift(frame["value"].to_numpy(float), most)
        return pd.concat([pd.DataFrame({"mode": np.int32(m), "t": frame["t"].to_numpy(), "value": x}) for m, x in enumerate(found)])

    return per_key(df, [*keys, SERIES], run, f"mode int, t {df.schema['t'].dataType.simpleString()}, value double")


def same_mode(imfs: DataFrame, mode: int) -> DataFrame:
    """One mode of all series."""
    return imfs.where(F.col("mode") == mode).drop("mode")


def peaks(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., series_id, t) of strict local maxima; of a flat top, its middle (the earlier of two)."""
    w = Window.partitionBy(*keys, SERIES).orderBy("t")
    runs = df.withColumn("new", F.coalesce(F.lag("value").over(w) != F.col("value"), F.lit(True)).cast("int"))
    runs = runs.withColumns({"run": F.sum("new").over(w), "i": F.row_number().over(w)})
    flat = runs.groupBy(*keys, SERIES, "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("value").alias("value"))
    w = Window.partitionBy(*keys, SERIES).orderBy("run")
    flat = flat.withColumns({"before": F.lag("value").over(w), "after": F.lead("value").over(w)})
    tops = flat.where("before < value and after < value").select(*keys, SERIES, F.expr("(a + b) div 2").cast("int").alias("i"))
    return runs.select(*keys, SERIES, "i", "t").join(tops, [*keys, SERIES, "i"]).drop("i")


def peak_period(df: DataFrame, rate: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Peaks and mean time between them of each series; null with fewer than two."""
    w = Window.partitionBy(*keys, SERIES).orderBy("t")
    gaps = peaks(df, keys).withColumn("gap", F.lead("t").over(w) - F.col("t"))
    return gaps.groupBy(*keys, SERIES).agg(F.count("*").alias("n_peaks"), (F.avg("gap") / rate).alias("period"))


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows by an order."""
    return df.orderBy(*order).limit(n)


def difference(df: DataFrame, value: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The step to the next row; null on the last."""
    return df.withColumn("diff", F.lead(value).over(Window.partitionBy(*keys).orderBy(order)) - F.col(value))


def euler(coupling: np.ndarray, start: np.ndarray, steps: int, dt: float = 0.1) -> np.ndarray:
    """[t, node]: x += dt * (J x - x), the start first."""
    x = np.zeros((steps, len(start)))
    x[0] = start
    for t in range(1, steps):
        x[t] = x[t - 1] + dt * (coupling @ x[t - 1] - x[t - 1])
    return x
