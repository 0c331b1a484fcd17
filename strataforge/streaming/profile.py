"""Counts and moments of numeric columns over time windows of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import col


def windowed_profile(stream: DataFrame, time_col: str, columns: Sequence[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """A row per window: rows, and of each column filled, mean and stddev; rows later than ``late`` are left out. Batch frames work too."""
    made = [f(col(c)).alias(f"{c}_{k}") for c in columns for k, f in (("filled", F.count), ("mean", F.avg), ("stddev", F.stddev_samp))]
    timed = stream.withColumn(time_col, col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, window).alias("w")).agg(F.count(F.lit(1)).alias("rows"), *made).select("w.start", "w.end", "rows", *(f"{c}_{k}" for c in columns for k in ("filled", "mean", "stddev")))
