"""Series from a stream of events: windowed sums with a watermark. An extension; the batch operators take its output as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_series(events: DataFrame, series: str, value: str = "value", time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(series, start, value): the sum of each window, final once the watermark has passed it. Works on streams and on tables alike.

    Events later than `late` behind the newest are dropped in a stream, as watermarks have it; a table has no late events.
    """
    held = events.withColumn(time, F.col(time).cast("timestamp"))
    held = held.withWatermark(time, late) if events.isStreaming else held
    sums = held.groupBy(F.window(time, width).alias("w"), F.col(series).alias("series")).agg(F.sum(value).alias("value"))
    return sums.select("series", F.col("w.start").alias("start"), "value")
