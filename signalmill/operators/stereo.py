"""Correlation, mono compatibility and width of two-channel series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import cutoff_alpha, one_pole
from ..functions.levels import clamp
from ..session import cut_lineage
from .scans import DEFAULT_BLOCK, from_blocks, linear_scan, to_blocks

def _lr():
    return F.col("l"), F.col("r")


def _raw_correlation(ll, rr, lr):
    return F.coalesce(F.try_divide(lr, F.sqrt(ll * rr)), F.lit(1.0))


def stereo_sums(frames: DataFrame) -> DataFrame:
    """Raw correlation (1 for silent input) and mono fold-down level change, from four sums."""
    l, r = _lr()
    mono = (l + r) * 0.5
    g = frames.groupBy("track_id").agg(
        F.sum(l * l).alias("ll"), F.sum(r * r).alias("rr"), F.sum(l * r).alias("lr"), F.sum(mono * mono).alias("mm"))
    ref = (F.col("ll") + F.col("rr")) * 0.5
    fold = (
        F.when(ref <= 0, 0.0).when(F.col("mm") > 0, 10 * F.log10(F.col("mm") / F.nullif(ref, F.lit(0.0)))).otherwise(-200.0)
    )
    return g.select(
        "track_id", _raw_correlation(F.col("ll"), F.col("rr"), F.col("lr")).alias("correlation"),
        fold.alias("mono_fold_delta_db"))


def pearson(a: str, b: str):
    """Correlation aggregate, 1 when either side is (numerically) constant."""
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    c = F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-12, spread))
    return clamp(F.coalesce(c, F.lit(1.0)), -1, 1)


def centered_correlation(frames: DataFrame) -> DataFrame:
    """Pearson correlation per series."""
    return frames.groupBy("track_id").agg(pearson("l", "r").alias("centered_correlation"))


def negative_correlation_fraction(frames: DataFrame, window: int = 2048) -> DataFrame:
    """Share of tumbling windows with negative correlation; silent windows do not count."""
    l, r = _lr()
    w = frames.groupBy("track_id", F.floor(F.col("frame_ix") / F.lit(window)).alias("win")).agg(
        F.sum(l * l).alias("ll"), F.sum(r * r).alias("rr"), F.sum(l * r).alias("lr"))
    used = F.sqrt(F.col("ll") * F.col("rr")) > 0
    return w.groupBy("track_id").agg(
        F.count_if(used).alias("correlation_windows"),
        F.coalesce(
            F.try_divide(F.count_if(used & (F.col("lr") < 0)).cast("double"), F.count_if(used).cast("double")),
            F.lit(0.0)).alias("negative_fraction"))


def band_widths(frames: DataFrame, rate: float, low_hz: float = 200.0, high_hz: float = 4000.0,
                block: int = DEFAULT_BLOCK) -> DataFrame:
    """Side share of energy below, between and above two one-pole crossovers."""
    low, high = one_pole(cutoff_alpha(low_hz, rate)), one_pole(cutoff_alpha(high_hz, rate))
    b = linear_scan(
        cut_lineage(to_blocks(frames, ["track_id"], "frame_ix", ["l", "r"], block)), ["track_id"],  # read more than once
        {"l_lo": ("l", low), "r_lo": ("r", low), "l_hi": ("l", high), "r_hi": ("r", high)}, block)
    f = from_blocks(b, ["track_id"], "frame_ix", ["l", "r", "l_lo", "r_lo", "l_hi", "r_hi"], block)
    c = F.col
    bands = {
        "low": (c("l_lo"), c("r_lo")),
        "mid": (c("l_hi") - c("l_lo"), c("r_hi") - c("r_lo")),
        "high": (c("l") - c("l_hi"), c("r") - c("r_hi")),
    }
    scale = math.sqrt(0.5)
    aggs = []
    for name, (bl, br) in bands.items():
        mid, side = (bl + br) * scale, (bl - br) * scale
        m2, s2 = F.sum(mid * mid), F.sum(side * side)
        aggs.append(F.coalesce(F.try_divide(s2, m2 + s2), F.lit(0.0)).alias(f"{name}_band_width"))
    return f.groupBy("track_id").agg(*aggs)
