"""Network snapshots kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_stream(events: DataFrame, width: str = "5 days", late: str = "1 day", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """start, keys and n of each window. A window is final once the watermark, `late` behind the newest event, is past it;
    events later than that are left out, and state is kept for open windows only.
    """
    seen = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = seen.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")
