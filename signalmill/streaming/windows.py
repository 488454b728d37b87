"""Event-time windows over irregular series, with a lateness policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(df: DataFrame, column: str = "ts", lateness: str = "1 hour", name: str | None = None) -> DataFrame:
    """Cast to a timestamp with time zone and set the watermark: rows later than ``lateness`` are dropped.

    With ``name`` the rows seen and the newest time are observed under that name, so dropped rows can be counted
    against the state operator's own metric.
    """
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    if name:
        out = out.observe(name, F.count(F.lit(1)).alias("rows"), F.max(column).alias("newest"))
    return out.withWatermark(column, lateness)


def observed_rows(progress: list, name: str) -> int:
    """Rows that a stream saw under ``name``, from the progress of its micro-batches."""
    return sum(int(p.observedMetrics[name]["rows"]) for p in progress if name in p.observedMetrics)


def dropped_rows(windows: DataFrame, progress: list, name: str) -> DataFrame:
    """One row, ``dropped``: rows that were seen but are in no (tumbling) window since they came behind the watermark."""
    return windows.agg((F.lit(observed_rows(progress, name)) - F.coalesce(F.sum("n"), F.lit(0))).cast("bigint").alias("dropped"))


def level_windows(df: DataFrame, duration: str, slide: str | None = None, keys=("source",), value: str = "x", time: str = "ts") -> DataFrame:
    """Count, rms and peak per key and tumbling (or sliding) window. Works on streams and on tables."""
    w = F.window(time, duration, slide) if slide else F.window(time, duration)
    return df.groupBy(w.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("peak")
    ).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "rms", "peak")


def sessions(df: DataFrame, gap: str, keys=("user_id",), value: str = "x", time: str = "ts") -> DataFrame:
    """Bursts of one key separated by at least ``gap``. Adjacency is per key: unlike the event merge, another
    label in between does not end a session."""
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("peak")
    ).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")
