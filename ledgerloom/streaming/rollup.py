"""Running rollup of an execution stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_counts(stream: DataFrame, key: str, at: str, lateness: str = "1 day", window: str = "1 day") -> DataFrame:
    """Runs per key and window of time, with the latest run; rows later than ``lateness`` are let go by the watermark.

    Works on streams and on batches alike; the state holds one row per key and open window.
    """
    return stream.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w"), F.col(key)).agg(F.count("*").alias("run_count"), F.max(at).alias("last_run")).select(key, F.col("w.start").alias("window_start"), "run_count", "last_run")
