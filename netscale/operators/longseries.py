"""Filters and transforms of series that are too long for a task: rows (keys..., series_id, t, value), as many as there are.

A recursive filter maps its state affinely over a stretch of samples; so stretches are filtered apart, their maps are put together in one pass
over a row a stretch, and each stretch is filtered again from its true state. A Fourier transform of n1 * n2 samples is n2 transforms of n1, a
rotation, and n1 transforms of n2.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netscale.functions import kernels
from netscale.operators.stats import ranked_by
from netscale.sources.shared import written

SERIES = "series_id"


def _lengths(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, SERIES).agg(F.count("*").alias("n"))


def is_long(df: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of series of at most so many samples, and the others."""
    long = written(_lengths(df, keys).where(F.col("n") > most).select(*keys, SERIES), "long")
    if long.isEmpty():
        return df, df.limit(0)
    return df.join(long, [*keys, SERIES], "left_anti"), df.join(long, [*keys, SERIES], "left_semi")


def placed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with `place` from 0 by t and `n`, the number of samples of its series."""
    own = [*keys, SERIES]
    ranked = written(ranked_by(df, [*own, "t"])[0], "ranked")
    ends = ranked.groupBy(*own).agg(F.min("rank").alias("__low"), F.count("*").alias("n"))
    return ranked.join(ends, own).withColumn("place", F.col("rank") - F.col("__low")).drop("rank", "__low")


def _types(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _one_way(df: DataFrame, own: list[str], b: np.ndarray, a: np.ndarray, segment: int) -> DataFrame:
    """(own..., place, x) filtered from place 0 on, from the state that its first sample would hold for ever."""
    m = len(a) - 1
    step = np.zeros((m, m))
    step[:, 0] = -a[1:]
    step[:-1, 1:] = np.eye(m - 1)
    rest = kernels.steady_state(b, a)
    dealt = written(df.withColumn("segment", F.expr(f"place div {segment}")), "segments")
    head = _types(dealt, own)

    def run(state_of):
        """Filters a segment; state_of(table) is the state before it."""

        def one(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
            table = table.sort_by("place")
            x = table["x"].to_numpy().astype(float)
            wide = np.concatenate([x, np.zeros(m)])  # what comes after the segment tells its state
            y = kernels.lfilter(b, a, wide[None], state_of(table)[None])[0]
            return table, y[: len(x)], y[len(x) :]

        return one

    def ends(table: pa.Table) -> pa.Table:
        table, _, after = run(lambda _: np.zeros(m))(table)
        # outputs without input are the state's first entry, step by step
        state = np.linalg.solve(np.stack([np.linalg.matrix_power(step, k)[0] for k in range(m)]), after)
        columns = [*(table[c].slice(0, 1) for c in [*own, "segment"]), pa.array([table.num_rows], pa.int64()), pa.array([table["x"][0].as_py()], pa.float64()), pa.array([state.tolist()], pa.list_(pa.float64()))]
        return pa.table(columns, [*own, "segment", "length", "first", "state"])

    states = dealt.groupBy(*own, "segment").applyInArrow(ends, f"{head}, segment long, length long, first double, state array<double>")

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment")
        now, before = rest * frame["first"].iloc[0], []
        for length, state in zip(frame["length"], frame["state"], strict=True):
            before.append(now.tolist())
            now = np.linalg.matrix_power(step, int(length)) @ now + np.asarray(state)
        return frame[[*own, "segment"]].assign(before=before)

    before = written(states.groupBy(*own).applyInPandas(scan, f"{head}, segment long, before array<double>"), "states")  # a row a segment
    held = dealt.join(before, [*own, "segment"])

    def again(table: pa.Table) -> pa.Table:
        table, y, _ = run(lambda t: np.array(t["before"][0].as_py()))(table)
        return pa.table([*(table[c] for c in [*own, "place", "n"]), pa.array(y)], [*own, "place", "n", "x"])

    return held.groupBy(*own, "segment").applyInArrow(again, f"{head}, place long, n long, x double")


def filtered(df: DataFrame, b: np.ndarray, a: np.ndarray, keys: Sequence[str] = (), segment: int = 50_000) -> DataFrame:
    """(keys..., series_id, t, value): each series filtered forwards and backwards by the taps b and a, as kernels.filtfilt does it, with odd padding of
    three times the number of taps; null for series that aren't longer than that. A task holds `segment` samples."""
    own, pad = [*keys, SERIES], 3 * max(len(a), len(b))
    rows = written(placed(df, keys), "placed")
    wide = rows.where(F.col("n") > pad)
    ends = wide.groupBy(*own).agg(F.min_by("value", "place").alias("__a"), F.max_by("value", "place").alias("__b"))
    front = wide.where((F.col("place") >= 1) & (F.col("place") <= pad)).join(ends, own).select(*own, (pad - F.col("place")).alias("place"), "n", (2 * F.col("__a") - F.col("value")).alias("x"))
    back = wide.where((F.col("place") <= F.col("n") - 2) & (F.col("place") >= F.col("n") - 1 - pad)).join(ends, own)
    back = back.select(*own, (2 * F.col("n") - 2 - F.col("place") + pad).alias("place"), "n", (2 * F.col("__b") - F.col("value")).alias("x"))
    x = wide.select(*own, (F.col("place") + pad).alias("place"), "n", F.col("value").cast("double").alias("x")).unionByName(front).unionByName(back)
    turned = lambda d: d.withColumn("place", F.col("n") + 2 * pad - 1 - F.col("place"))
    y = turned(_one_way(x, own, b, a, segment))
    y = turned(_one_way(y, own, b, a, segment))
    y = y.where((F.col("place") >= pad) & (F.col("place") < F.col("n") + pad)).select(*own, (F.col("place") - pad).alias("place"), F.col("x").alias("__y"))
    return rows.join(y, [*own, "place"], "left").select(*own, "t", F.col("__y").alias("value"))


def _divisor(n: int) -> int:
    """The largest divisor of n up to its root."""
    return next(d for d in range(int(n**0.5), 0, -1) if n % d == 0)


def _divided(df: DataFrame) -> DataFrame:
    """df (with n) with n1, the largest divisor of n up to its root."""
    schema = f"{_types(df, df.columns)}, n1 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([_divisor(n) for n in batch.column("n").to_pylist()], pa.int64())], [*batch.schema.names, "n1"])

    return df.mapInArrow(run, schema)


def _four_steps(rows: DataFrame, own: list[str], back: bool = False) -> DataFrame:
    """(own..., place, n, re, im): the transform (or without its 1 / n the inverse one) of rows of that kind, which have n1, a divisor of n, too."""
    fft = (lambda z: np.fft.ifft(z) * len(z)) if back else np.fft.fft
    sign = 1 if back else -1
    head = _types(rows, own)

    def column(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n, n1, i2 = (table[c][0].as_py() for c in ("n", "n1", "__part"))
        k1 = np.arange(n1)
        z = fft(table["re"].to_numpy() + 1j * table["im"].to_numpy()) * np.exp(sign * 2j * np.pi * ((i2 * k1) % n) / n)
        columns = [*(pa.repeat(table[c][0], n1) for c in own), pa.array(k1), pa.repeat(pa.scalar(i2, pa.int64()), n1), pa.repeat(pa.scalar(n, pa.int64()), n1), pa.repeat(pa.scalar(n1, pa.int64()), n1), pa.array(z.real), pa.array(z.imag)]
        return pa.table(columns, [*own, "__part", "place", "n", "n1", "re", "im"])

    def row(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n, n1, k1 = (table[c][0].as_py() for c in ("n", "n1", "__part"))
        z = fft(table["re"].to_numpy() + 1j * table["im"].to_numpy())
        return pa.table([*(pa.repeat(table[c][0], len(z)) for c in own), pa.array(k1 + n1 * np.arange(len(z))), pa.repeat(pa.scalar(n, pa.int64()), len(z)), pa.array(z.real), pa.array(z.imag)], [*own, "place", "n", "re", "im"])

    parts = rows.withColumn("__part", F.expr("place % (n div n1)"))
    parts = parts.groupBy(*own, "__part").applyInArrow(column, f"{head}, __part long, place long, n long, n1 long, re double, im double")
    return parts.groupBy(*own, "__part").applyInArrow(row, f"{head}, place long, n long, re double, im double")


def transformed(df: DataFrame, keys: Sequence[str] = (), even: int = 64) -> DataFrame:
    """(keys..., series_id, k, n, re, im): the Fourier transform of each series, by t. A task holds about the root of a series' length.

    A length whose parts would be more than `even` times as long as one another (a prime, say) is taken by the chirp transform, as a convolution of a
    length that is a power of two.
    """
    own = [*keys, SERIES]
    rows = placed(df, keys).select(*own, "place", "n", F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    split = written(_divided(rows.select(*own, "n").distinct()), "divisors")
    rows = written(rows.join(split.drop("n"), own), "rows")
    good = rows.where(F.col("n") <= even * F.col("n1") * F.col("n1"))
    odd = rows.where(F.col("n") > even * F.col("n1") * F.col("n1"))
    out = _four_steps(good, own)
    if not odd.isEmpty():
        out = out.unionByName(_chirped(odd, own))
    return out.select(*own, F.col("place").cast("int").alias("k"), F.col("n").cast("int").alias("n"), "re", "im")


def _chirped(rows: DataFrame, own: list[str]) -> DataFrame:
    """The transform as a convolution with exp(i pi k^2 / n), the squares taken modulo 2 n."""
    angle = F.pi() * F.expr("cast(cast(place as decimal(19,0)) * place % (2 * n) as double)") / F.col("n")
    times = lambda re, im, c, s: (re * c - im * s, re * s + im * c)
    m = F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.col("n") - 1))).cast("long")
    size = rows.select(*own, "n").distinct().withColumn("m", m)
    a = rows.withColumns(dict(zip(("re", "im"), times(F.col("re"), F.col("im"), F.cos(angle), -F.sin(angle)), strict=True))).select(*own, "place", "re", "im")
    full = size.select(*own, "m", "n", F.explode(F.expr("sequence(0L, m - 1)")).alias("place"))
    n1 = F.pow(F.lit(2.0), F.floor(F.log2("m") / 2)).cast("long").alias("n1")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    padded = full.join(a, [*own, "place"], "left").select(*own, "place", F.col("m").alias("n"), n1, zero("re"), zero("im"))
    turn = full.withColumn("__k", F.least("place", F.col("m") - F.col("place"))).where("__k < n")
    chirp = F.pi() * F.expr("cast(cast(__k as decimal(19,0)) * __k % (2 * n) as double)") / F.col("n")
    filter_ = full.select(*own, "m", "place").join(turn.select(*own, "place", F.cos(chirp).alias("re"), F.sin(chirp).alias("im")), [*own, "place"], "left")
    filter_ = filter_.select(*own, "place", F.col("m").alias("n"), n1, zero("re"), zero("im"))
    x = _four_steps(padded, own)
    y = _four_steps(filter_, own).select(*own, "place", F.col("re").alias("c"), F.col("im").alias("s"))
    re, im = times(F.col("re"), F.col("im"), F.col("c"), F.col("s"))
    both = written(x.join(y, [*own, "place"]).select(*own, "place", "n", F.pow(F.lit(2.0), F.floor(F.log2("n") / 2)).cast("long").alias("n1"), re.alias("re"), im.alias("im")), "convolved")
    out = _four_steps(both, own, back=True).select(*own, "place", (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))
    out = out.join(size.select(*own, "n"), own).where("place < n")
    re, im = times(F.col("re"), F.col("im"), F.cos(angle), -F.sin(angle))
    return out.select(*own, "place", "n", re.alias("re"), im.alias("im"))
