"""Programme loudness, loudness range and true peak after the public standards (BS.1770, Tech 3341/3342).

Momentary and short-term levels lie on a fixed 100 ms grid of the series, so they do not depend on blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import k_weighting
from ..functions.levels import amplitude_db
from .frames import block_halos, to_long
from .ordering import home_rows, with_halo
from .quantiles import linear_quantiles, ranked_value
from .scans import DEFAULT_BLOCK, from_blocks, linear_scan, to_blocks

# fixed values
ABSOLUTE_GATE, RELATIVE_GATE, RANGE_GATE, OFFSET, SILENT = -70.0, -10.0, -20.0, -0.691, -200.0
CHANNEL_WEIGHTS = {
    1: [1.0], 2: [1.0, 1.0], 3: [1.0, 1.0, 1.0], 4: [1.0, 1.0, 1.41, 1.41], 5: [1.0, 1.0, 1.0, 1.41, 1.41],
    6: [1.0, 1.0, 1.0, 0.0, 1.41, 1.41],
}


def rolling_energy(hops: DataFrame, preceding: int, out: str, block: int = 4096, key: str = "track_id") -> DataFrame:
    """Mean energy over this and the ``preceding`` hops (``hop_ix, e, n``); fewer at the start."""
    rows, w = with_halo(hops, [key], "hop_ix", max(block, preceding), before=preceding)
    span = w.rowsBetween(-preceding, 0)
    return home_rows(rows.withColumn(out, F.sum("e").over(span) / F.sum("n").over(span)))


def lufs(energy: Column) -> Column:
    return F.when(energy > 0, OFFSET + 10 * F.log10(energy)).otherwise(SILENT)


def weighted_hops(frames: DataFrame, rate: float, channels: Sequence[str] = ("l", "r"), hop_s: float = 0.1,
                  block: int = DEFAULT_BLOCK) -> DataFrame:
    """Weighted energy per 100 ms: ``track_id, hop_ix, e, n``."""
    k, weights = k_weighting(rate), CHANNEL_WEIGHTS[len(channels)]
    b = linear_scan(to_blocks(frames, ["track_id"], "frame_ix", channels, block), ["track_id"],
                    {f"k_{c}": (c, k) for c in channels}, block)
    rows = from_blocks(b, ["track_id"], "frame_ix", [f"k_{c}" for c in channels], block)
    power = sum((F.col(f"k_{c}") * F.col(f"k_{c}") * w for c, w in zip(channels, weights)), F.lit(0.0))
    hop = max(1, round(rate * hop_s))
    return rows.groupBy("track_id", F.floor(F.col("frame_ix") / F.lit(hop)).cast("bigint").alias("hop_ix")).agg(
        F.sum(power).alias("e"), F.count(F.lit(1)).alias("n"), F.lit(hop).alias("hop"))


def weighted_hops_of_samples(samples: DataFrame, rate: float, hop_s: float = 0.1, block: int = DEFAULT_BLOCK) -> DataFrame:
    """The same from ``track_id, ch, frame_ix, x``, where each track has its own number of channels, one to six in the
    usual order; a track with more is an error. Every channel is filtered as a series of its own."""
    keys = ["track_id", "ch"]
    b = linear_scan(to_blocks(samples, keys, "frame_ix", ["x"], block), keys, {"k": ("x", k_weighting(rate))}, block)
    layouts = F.array(*[F.array(*[F.lit(w) for w in CHANNEL_WEIGHTS[n]]) for n in sorted(CHANNEL_WEIGHTS)])
    count = samples.groupBy("track_id").agg((F.max("ch") + 1).alias("_channels"))
    hop = max(1, round(rate * hop_s))
    ch = from_blocks(b, keys, "frame_ix", ["k"], block).groupBy(*keys, F.floor(F.col("frame_ix") / F.lit(hop)).cast("bigint").alias("hop_ix")).agg(
        F.sum(F.col("k") * F.col("k")).alias("_e"), F.count(F.lit(1)).alias("_n"))
    # one row per hop and channel from here on
    weight = F.element_at(F.element_at(layouts, F.col("_channels")), F.col("ch") + 1)
    return ch.join(count, "track_id").groupBy("track_id", "hop_ix").agg(
        F.sum(F.col("_e") * weight).alias("e"), F.max("_n").alias("n"), F.lit(hop).alias("hop"))


def timeline(hops: DataFrame, momentary: int = 4, short: int = 30) -> DataFrame:
    """``track_id, hop_ix, m, s``: mean energies of the last 400 ms and 3 s, null until a window is complete."""
    full = hops.filter(F.col("n") == F.col("hop"))
    t = rolling_energy(full, momentary - 1, "m")
    t = rolling_energy(t, short - 1, "s")
    return t.select(
        "track_id", "hop_ix", F.when(F.col("hop_ix") >= momentary - 1, F.col("m")).alias("m"),
        F.when(F.col("hop_ix") >= short - 1, F.col("s")).alias("s"))


def gated(points: DataFrame, value: str, out: str) -> DataFrame:
    """Two-stage gated mean of energies in LUFS."""
    loud = points.filter(lufs(F.col(value)) >= ABSOLUTE_GATE)
    floor = loud.groupBy("track_id").agg((lufs(F.avg(value)) + RELATIVE_GATE).alias("_g"))
    kept = loud.join(floor, "track_id").filter(lufs(F.col(value)) >= F.col("_g"))
    return kept.groupBy("track_id").agg(lufs(F.avg(value)).alias(out))


def loudness(hops: DataFrame) -> DataFrame:
    """Integrated loudness, range, maxima and short-term variation per track."""
    t = timeline(hops)
    base = t.groupBy("track_id").agg(
        F.coalesce(lufs(F.max("m")), F.lit(SILENT)).alias("max_momentary"),
        F.coalesce(lufs(F.max("s")), F.lit(SILENT)).alias("max_short_term"))
    integrated = gated(t.filter("m is not null"), "m", "integrated_lufs")
    shorts = t.filter(F.col("s").isNotNull()).withColumn("st", lufs(F.col("s")))
    # the range uses one short-term value per second above its own two gates
    seconds = shorts.filter(((F.col("hop_ix") - 29) % 10 == 0) & (F.col("st") >= ABSOLUTE_GATE))
    floor = seconds.groupBy("track_id").agg((lufs(F.avg("s")) + RANGE_GATE).alias("_g"))
    kept = seconds.join(floor, "track_id").filter(F.col("st") >= F.col("_g"))
    lo = ranked_value(kept, ["track_id"], "st", lambda n: F.floor((n - 1) * F.lit(0.10) + 0.5), "_lo")
    hi = ranked_value(kept, ["track_id"], "st", lambda n: F.floor((n - 1) * F.lit(0.95) + 0.5), "_hi")
    var = short_term_variation(shorts)
    out = base.join(integrated, "track_id", "left").join(lo, "track_id", "left").join(hi, "track_id", "left").join(
        var, "track_id", "left")
    return out.select(
        "track_id", F.coalesce("integrated_lufs", F.lit(SILENT)).alias("integrated_lufs"), "max_momentary", "max_short_term",
        F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0.0)).alias("loudness_range"),
        F.coalesce("short_term_variation", F.lit(0.0)).alias("short_term_variation"))


def short_term_variation(points: DataFrame) -> DataFrame:
    """p95 - p10 of short-term levels ``st`` above -199."""
    q = linear_quantiles(points.filter(F.col("st") > -199.0), ["track_id"], "st", {"_p10": 0.10, "_p95": 0.95})
    return q.select("track_id", (F.col("_p95") - F.col("_p10")).alias("short_term_variation"))


def true_peak(frames: DataFrame, channels: Sequence[str] = ("l", "r"), factor: int = 4, half: int = 12,
              block: int = DEFAULT_BLOCK) -> DataFrame:
    """Largest magnitude of the ``factor`` times oversampled signal, never below the sample peak.

    Each block is interpolated where it lies, with ``half`` samples from both neighbours.
    """
    return true_peak_of_samples(to_long(frames, channels), factor, half, block)


def oversampling(factor: int, half: int) -> np.ndarray:
    """Weights of the samples from ``half - 1`` before to ``half`` after, one column for each place between two samples."""
    taps = np.arange(-half + 1, half + 1)
    phases = []
    for k in range(1, factor):
        d = taps - k / factor
        h = np.sinc(d) * (0.5 + 0.5 * np.cos(np.pi * d / half))
        phases.append(h / h.sum())
    return np.stack(phases, axis=1)


def true_peak_of_samples(samples: DataFrame, factor: int = 4, half: int = 12, block: int = DEFAULT_BLOCK) -> DataFrame:
    """The same from ``track_id, ch, frame_ix, x``, whatever the number of channels."""
    bank = oversampling(factor, half)

    @F.pandas_udf("double")
    def peak(head: pd.Series, x: pd.Series, tail: pd.Series) -> pd.Series:
        out = []
        for before, own, after in zip(head, x, tail):
            left = np.zeros(half - 1)
            if len(before):
                left[-len(before[-(half - 1):]):] = before[-(half - 1):]
            right = np.zeros(half)
            right[: len(after)] = after
            data = np.concatenate([left, own, right])
            win = np.lib.stride_tricks.sliding_window_view(data, 2 * half)[: len(own)]
            out.append(max(np.abs(own).max(initial=0.0), np.abs(win @ bank).max(initial=0.0)))
        return pd.Series(out, dtype=float)

    b = to_blocks(samples, ["track_id", "ch"], "frame_ix", ["x"], block)
    h = block_halos(b, ["track_id", "ch"], half, half)
    return h.select("track_id", peak("head", "x", "tail").alias("_p")).groupBy("track_id").agg(
        F.max("_p").alias("true_peak"), amplitude_db(F.max("_p")).alias("true_peak_dbtp"))
