"""The batch workflow: recordings by subject and contrast, band-filtered, correlated, cleaned, stored, resumed, and averaged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from netscale.operators.corr import clean, correlation, mean_matrix
from netscale.operators.series import ideal_band_filter
from netscale.sources import readers

KEYS = ["subject", "contrast"]


def connectivity(recordings: DataFrame, contrasts: DataFrame, bands: DataFrame, store: str) -> DataFrame:
    """(band, i, j, r, subject, contrast) of all recordings (subject, contrast, series_id, t, value), from the store.

    Recordings that the store has are not worked out again; the others are filtered to each band (in Hz, by their contrast's sampling rate),
    correlated and cleaned, and appended. Recordings without series don't appear.
    """
    spark = recordings.sparkSession
    todo = readers.not_done(recordings.select(*KEYS).distinct(), store, KEYS)
    rows = recordings.join(todo, KEYS, "left_semi").select(*KEYS, "series_id", "t", "value")
    rates = [(r.contrast, float(r.fs_hz)) for r in contrasts.select("contrast", "fs_hz").collect()]  # a dimension of a few rows
    parts = [ideal_band_filter(rows.where(rows["contrast"] == c), bands, KEYS, fs) for c, fs in rates]
    if parts:
        filtered = reduce(DataFrame.unionByName, parts)
        readers.save(clean(correlation(filtered, [*KEYS, "band"])), store, KEYS)
    return readers.load(spark, store)


def group_mean(matrices: DataFrame) -> DataFrame:
    """(contrast, band, i, j, r): means over subjects."""
    return mean_matrix(matrices, ["contrast", "band"])
