"""Success ratio of a live attempts feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.metrics import success_ratio


def stream_success_ratio(
    attempts: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """(window_start, window_end, total, successes, ratio) per tumbling window. Rows more than ``delay`` behind
    the newest one are late and dropped; a window is emitted once it lies that far behind."""
    windowed = attempts.withWatermark(ts, delay).withColumn("window", F.window(ts, width))
    return success_ratio(windowed, ["window"]).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "total", "successes", "ratio"
    )
