"""Damage counters, full-scale runs, peaks and clipping character."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import amplitude_db, amplitude_db_clamped, clamp, is_finite
from ..session import cut_lineage
from .frames import to_long
from .ordering import home_rows, runs, with_halo
from .quantiles import linear_quantiles

# fixed values
SILENCE = 0.00003162277660168379
FULL_SCALE = 0.999969482421875
NEAR_FULL = 0.985
PLATEAU_STEP = 2.0e-5
CLIP_WINDOW = 0.9999
ACTIVE_RMS = 1.0e-5


def _integrity_parts(channels: Sequence[str], rate: float):
    ok = {c: is_finite(F.col(c)) for c in channels}
    aggs = [
        (F.max("frame_ix") + 1).alias("frames"),
        sum((F.count_if(F.isnan(c)) for c in channels), F.lit(0)).alias("nan_samples"),
        sum((F.count_if(F.abs(F.col(c)) == float("inf")) for c in channels), F.lit(0)).alias("infinite_samples"),
        sum((F.count_if(ok[c] & (F.abs(F.col(c)) >= 1.0)) for c in channels), F.lit(0)).alias("clipped_samples"),
    ]
    loud = F.lit(False)
    for c in channels:
        loud = loud | (ok[c] & (F.abs(F.col(c)) > SILENCE))
        aggs += [
            F.avg(F.when(ok[c], F.col(c))).alias(f"_mean_{c}"),
            F.sqrt(F.avg(F.when(ok[c], F.col(c) * F.col(c)))).alias(f"_rms_{c}"),
        ]
    aggs += [F.min(F.when(loud, F.col("frame_ix"))).alias("_first"), F.max(F.when(loud, F.col("frame_ix"))).alias("_last")]
    rms = [F.col(f"_rms_{c}") for c in channels]
    dc = [F.coalesce(F.abs(F.col(f"_mean_{c}")), F.lit(0.0)) for c in channels]
    if len(channels) >= 2:
        low, high = F.least(*rms), F.greatest(*rms)
        usable = (F.size(F.filter(F.array(*rms), lambda v: v.isNotNull())) >= 2) & (low > 0)
        imbalance = F.when(usable, 20 * F.log10(high / F.nullif(low, F.lit(0.0)))).otherwise(0.0)
    else:
        imbalance = F.lit(0.0)
    finals = [
        F.col("frames"), F.col("nan_samples"), F.col("infinite_samples"), F.col("clipped_samples"),
        (F.greatest(*dc) if len(dc) > 1 else dc[0]).alias("max_abs_dc"),
        imbalance.alias("channel_imbalance_db"),
        (F.coalesce("_first", "frames") / rate).alias("head_silence_s"),
        (F.coalesce(F.col("frames") - F.col("_last") - 1, F.col("frames")) / rate).alias("tail_silence_s"),
    ]
    return aggs, finals


def _level_parts(channels: Sequence[str]):
    ok = [F.when(is_finite(F.col(c)), F.col(c)) for c in channels]
    peaks = [F.max(F.abs(c)) for c in ok]
    aggs = [
        (F.greatest(*peaks) if len(peaks) > 1 else peaks[0]).alias("_peak"),
        (sum((F.coalesce(F.sum(c * c), F.lit(0.0)) for c in ok), F.lit(0.0))
         / F.nullif(sum((F.count(c) for c in ok), F.lit(0)), F.lit(0))).alias("_power"),
    ]
    peak_db, rms_db = amplitude_db(F.col("_peak")), amplitude_db(F.sqrt("_power"))
    crest = F.when((F.col("_peak") > 0) & (F.col("_power") > 0), peak_db - rms_db).otherwise(0.0)
    return aggs, [peak_db.alias("sample_peak_db"), rms_db.alias("rms_db"), crest.alias("crest_db")]


def integrity_metrics(frames: DataFrame, rate: float, channels: Sequence[str] = ("l", "r")) -> DataFrame:
    """One aggregation per series: invalid samples, clipping, DC, imbalance, head and tail silence."""
    aggs, finals = _integrity_parts(channels, rate)
    return frames.groupBy("track_id").agg(*aggs).select("track_id", *finals)


def peak_rms_crest(frames: DataFrame, channels: Sequence[str] = ("l", "r")) -> DataFrame:
    """Sample peak, RMS and crest over all channels of a series."""
    aggs, finals = _level_parts(channels)
    return frames.groupBy("track_id").agg(*aggs).select("track_id", *finals)


def integrity_and_levels(frames: DataFrame, rate: float, channels: Sequence[str] = ("l", "r")) -> DataFrame:
    """Both of the above from one pass and one shuffle of partial sums."""
    a1, f1 = _integrity_parts(channels, rate)
    a2, f2 = _level_parts(channels)
    return frames.groupBy("track_id").agg(*a1, *a2).select("track_id", *f1, *f2)


def full_scale_runs(
    frames: DataFrame, threshold: float = FULL_SCALE, min_run: int = 3, block: int = 65536,
    channels: Sequence[str] = ("l", "r"),
) -> DataFrame:
    """Longest run at full scale and number of runs of at least ``min_run`` samples, over all channels."""
    x = F.col("x")
    # only samples at the threshold leave the scan stage
    found = runs(to_long(frames, channels), ["track_id", "ch"], "frame_ix", is_finite(x) & (F.abs(x) >= threshold), block)
    return found.groupBy("track_id").agg(
        F.max("length").alias("longest_run"), F.count_if(F.col("length") >= min_run).alias("repeated_runs")
    )


def plateau_samples(frames: DataFrame, block: int = 65536, channels: Sequence[str] = ("l", "r"),
                    near: float = NEAR_FULL, step: float = PLATEAU_STEP) -> DataFrame:
    """Near-full-scale samples and those that repeat the previous sample's magnitude."""
    rows, w = with_halo(to_long(frames, channels), ["track_id", "ch"], "frame_ix", block, before=1)
    prev = F.abs(F.lag("x").over(w))
    mag = F.abs(F.col("x"))
    flat = (mag >= near) & F.coalesce((prev >= near) & (F.abs(mag - prev) <= step), F.lit(False))
    marked = home_rows(rows.withColumns({"_near": mag >= near, "_flat": flat}))
    return marked.groupBy("track_id").agg(
        F.count_if("_near").alias("near_full_samples"), F.count_if("_flat").alias("plateau_samples"),
        F.count("x").alias("total_samples"),
    )


def window_character(frames: DataFrame, window: int = 2048, channels: Sequence[str] = ("l", "r"),
                     clip: float = CLIP_WINDOW) -> DataFrame:
    """Active windows, windows with clipping and the median window crest."""
    mags = [F.abs(F.col(c)) for c in channels]
    top = F.greatest(*mags) if len(mags) > 1 else mags[0]
    power = sum((F.col(c) * F.col(c) for c in channels), F.lit(0.0)) / float(len(channels))
    w = cut_lineage(
        frames.groupBy("track_id", F.floor(F.col("frame_ix") / F.lit(window)).alias("win"))
        .agg(F.sqrt(F.avg(power)).alias("rms"), F.max(top).alias("peak"))
        .filter(F.col("rms") > ACTIVE_RMS)
        .withColumn("crest", amplitude_db_clamped(F.col("peak")) - amplitude_db_clamped(F.col("rms")))
    )
    counts = w.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("active_windows"), F.count_if(F.col("peak") >= clip).alias("clipping_windows"))
    return counts.join(linear_quantiles(w, ["track_id"], "crest", {"median_crest_db": 0.5}), "track_id")


def character_likelihoods(m: DataFrame, rate: float, channels: int = 2) -> DataFrame:
    """Clipping character from counters (columns of the operators above) as likelihoods and a defect risk."""
    def share(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    high = share("near_full_samples", "total_samples")
    windows = share("clipping_windows", "active_windows")
    flat = share("plateau_samples", "near_full_samples")
    explicit = share("clipped_samples", "total_samples")
    m = m.withColumns({
        "high_level_fraction": high, "clipping_window_fraction": windows, "_flat": flat,
        "hard_clip": clamp(explicit * 180.0 + flat * 0.65 + windows * 0.30, 0, 1),
    })
    dense = clamp(F.col("high_level_fraction") * 24.0, 0, 1)
    low_crest = clamp((9.0 - F.col("median_crest_db")) / 5.0, 0, 1)
    cw = F.col("clipping_window_fraction")
    m = m.withColumn("saturation", clamp(dense * 0.50 + low_crest * 0.35 + cw * 0.15 - F.col("hard_clip") * 0.20, 0, 1))
    m = m.withColumn("intentional", clamp(
        clamp(cw / 0.35, 0, 1) * 0.45 + F.col("saturation") * 0.45 + (1.0 - F.col("_flat")) * 0.10, 0, 1))
    isolated = F.when(cw > 0, clamp((0.14 - cw) / 0.14, 0, 1)).otherwise(0.0)
    long_run = clamp(F.col("longest_run") / 32.0, 0, 1)
    seconds = F.col("total_samples") / float(channels) / float(rate)
    return m.withColumns({
        "defect_risk": clamp(
            F.col("hard_clip") * (0.55 + isolated * 0.30) + long_run * 0.35 - F.col("intentional") * 0.20, 0, 1),
        "character_confidence": clamp(seconds / 15.0, 0.2, 1.0),
    }).drop("_flat")
