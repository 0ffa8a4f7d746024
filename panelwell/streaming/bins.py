"""Bin sums over a stream of sensor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bin_sum(sensors: DataFrame, freq_hours: int, lateness: str = "1 day") -> DataFrame:
    """Sum per user, modality and epoch-aligned bin; a bin is final once the watermark passes it."""
    width = f"{freq_hours} hours"
    return (
        sensors.withColumn("__ts", F.col("start_timestamp").cast("timestamp"))
        .withWatermark("__ts", lateness)
        .groupBy("app_user_id", "modality", F.window("__ts", width).alias("__w"))
        .agg(F.sum("value").alias("value"))
        .select("app_user_id", "modality", F.col("__w.start").cast("timestamp_ntz").alias("bin_start"), "value")
    )
