"""Extension without a counterpart in the batch engine: windowed measures of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_peaks(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Count and peak value by window and type; rows that come later than ``late`` behind the newest are dropped."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "peak")
    )
