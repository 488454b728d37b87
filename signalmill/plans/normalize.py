"""Bring processed series to a target loudness under a true-peak ceiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import clamp, to_linear
from ..operators.loudness import gated, timeline, true_peak, weighted_hops
from ..operators.scans import DEFAULT_BLOCK, from_blocks
from ..session import cut_lineage


def _measure(b: DataFrame, rate: float, block: int) -> DataFrame:
    f = from_blocks(b, ["track_id"], "frame_ix", ["l", "r"], block)
    level = gated(timeline(weighted_hops(f, rate, block=block)).filter("m is not null"), "m", "integrated_lufs")
    return true_peak(f, block=block).join(level, "track_id", "left").select(
        "track_id", F.coalesce("integrated_lufs", F.lit(-200.0)).alias("integrated_lufs"), "true_peak_dbtp")


def _scale(b: DataFrame, gains: DataFrame) -> DataFrame:
    g = b.join(gains, "track_id", "left").withColumn("_g", to_linear(F.coalesce("gain_db", F.lit(0.0))))
    return g.select("track_id", "block_ix", *[
        F.zip_with(c, F.array_repeat(F.col("_g"), F.size(c)), lambda x, k: x * k).alias(c) for c in ("l", "r")])


def normalize_to_target(b: DataFrame, rate: float, target_lufs: float, ceiling_dbtp: float, block: int = DEFAULT_BLOCK
                        ) -> tuple[DataFrame, DataFrame]:
    """Corrected blocks and a report row per series.

    One correction of -12..3 dB (skipped up to 0.025 dB), measured again from the written result; series still above
    the ceiling get one safety gain. The blocks are written between the passes so that nothing is computed twice.
    """
    b = cut_lineage(b)
    first = _measure(b, rate, block)
    want = clamp(F.least(target_lufs - F.col("integrated_lufs"), ceiling_dbtp - F.col("true_peak_dbtp")), -12, 3)
    gain = cut_lineage(first.select("track_id", F.when(F.abs(want) > 0.025, want).otherwise(0.0).alias("gain_db"),
                                    want.alias("correction_db")))
    b1 = cut_lineage(_scale(b, gain))
    second = _measure(b1, rate, block).join(gain.select("track_id", "correction_db"), "track_id")
    over = F.col("true_peak_dbtp") > ceiling_dbtp + 0.02
    second = cut_lineage(second.withColumn(
        "safety_db", F.when(over, ceiling_dbtp - F.col("true_peak_dbtp") - 0.03).otherwise(0.0)))
    b2 = _scale(b1, second.select("track_id", F.col("safety_db").alias("gain_db")))
    peak = F.col("true_peak_dbtp") + F.col("safety_db")
    report = second.select(
        "track_id", (F.col("correction_db") + F.col("safety_db")).alias("correction_db"),
        (F.col("integrated_lufs") + F.col("safety_db") - target_lufs).alias("loudness_error_lu"),
        peak.alias("true_peak_dbtp"), (peak <= ceiling_dbtp + 0.05).alias("ceiling_met"))
    return b2, report
