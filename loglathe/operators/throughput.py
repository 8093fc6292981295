"""Rows a second over windows that slide along event time, and their peak; the same on tables and on streams.

A row counts in each of ``seconds / slide`` windows; rows are pre-aggregated in each task, so a busy second is one row a
task and window.  On a stream a window is done when the watermark has passed it; rows later than ``late`` behind the newest
are stored like all others, but no longer counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EPOCH_1601_US


def rows_per_window(events: DataFrame, seconds: float = 2.0, slide: float = 1.0, late: str = "10 minutes", time: str = "timestamp_us") -> DataFrame:
    """(start_us, rows, rows_per_sec) of each window with rows; start in microseconds since 1970.  A null time counts nowhere."""
    at = F.timestamp_micros(F.col(time) - EPOCH_1601_US)
    length, step = (f"{round(s * 1_000_000)} microseconds" for s in (seconds, slide))
    timed = events.select(at.alias("at")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", length, step).alias("w")).agg(F.count("*").alias("rows"))
    return counted.select(F.unix_micros("w.start").alias("start_us"), "rows", (F.col("rows") / seconds).alias("rows_per_sec"))


def peak(windows: DataFrame) -> DataFrame:
    """One row: the busiest window (the first of equals) and the mean of all."""
    top = F.max(F.struct("rows_per_sec", (-F.col("start_us")).alias("before")))
    return windows.agg(top.getField("rows_per_sec").alias("peak_per_sec"), (-top.getField("before")).alias("peak_start_us"), F.avg("rows_per_sec").alias("mean_per_sec"))
