"""Feature frames, onsets, tempo, macro dynamics and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import amplitude_db_min, clamp
from ..session import cut_lineage
from .ordering import fill_from_neighbours, home_rows, position, runs, with_halo
from .quantiles import linear_quantiles

WIN_BLOCK = 4096  # feature frames per ordered bucket


def feature_frames(frames: DataFrame, size: int = 1024, block: int = 65536) -> DataFrame:
    """Per frame of ``size`` samples: rms, peak, brightness, width. ``track_id, win, n, ...``."""
    block = max(block // size, 1) * size
    rows, w = with_halo(
        frames.withColumn("mono", (F.col("l") + F.col("r")) / 2), ["track_id"], "frame_ix", block, before=1)
    rows = home_rows(rows.withColumn("_d", F.abs(F.col("mono") - F.coalesce(F.lag("mono").over(w), F.lit(0.0)))))
    mid, side = (F.col("l") + F.col("r")) * 0.5, (F.col("l") - F.col("r")) * 0.5
    g = rows.groupBy("track_id", F.floor(F.col("frame_ix") / F.lit(size)).cast("bigint").alias("win")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.col("mono") * F.col("mono"))).alias("rms"),
        F.max(F.abs("mono")).alias("peak"),
        clamp(F.sum("_d") / F.greatest(2.0 * F.sum(F.abs("mono")), F.lit(1e-9)), 0, 1).alias("brightness"),
        clamp(F.sqrt(F.sum(side * side) / F.greatest(F.sum(mid * mid) + F.sum(side * side), F.lit(1e-12))), 0, 1)
        .alias("width"),
    )
    return g.withColumn("rms_db", amplitude_db_min(F.col("rms")))


def onset_strength(features: DataFrame) -> DataFrame:
    """Add ``onset`` from the jump in rms and peak against the previous feature frame."""
    rows, w = with_halo(features, ["track_id"], "win", WIN_BLOCK, before=1)
    prev = F.coalesce(F.lag("rms").over(w), F.lit(0.0))
    jump = F.greatest(F.lit(0.0), amplitude_db_min(F.col("rms")) - amplitude_db_min(F.col("_prev")))
    peak = F.greatest(F.lit(0.0), F.col("peak") - F.col("_prev")) / F.greatest(F.col("_prev"), F.lit(1e-5))
    return home_rows(
        rows.withColumn("_prev", prev).withColumn("onset", clamp(jump / 10.0 + peak * 0.15, 0, 1.5)).drop("_prev"))


def onset_threshold(onsets: DataFrame, quantile: float = 0.75, margin: float = 0.03) -> DataFrame:
    return linear_quantiles(onsets, ["track_id"], "onset", {"_q": quantile}, width=0.002).select(
        "track_id", (F.col("_q") + margin).alias("onset_limit"))


def pick_onsets(onsets: DataFrame, limits: DataFrame, rate: float) -> DataFrame:
    """Peaks above the threshold: count, density per second, mean strength, share of frames above."""
    rows, w = with_halo(onsets, ["track_id"], "win", WIN_BLOCK, before=1, after=1)
    rows = home_rows(rows.withColumns({"_p": F.lag("onset").over(w), "_f": F.lead("onset").over(w)}))
    rows = rows.join(limits, "track_id")
    above = F.col("onset") > F.col("onset_limit")
    # the first and last frame have a null neighbour and never count
    peak = F.coalesce(above & (F.col("onset") >= F.col("_p")) & (F.col("onset") >= F.col("_f")), F.lit(False))
    return rows.groupBy("track_id").agg(
        F.count_if(peak).alias("onset_count"),
        (F.count_if(peak) / (F.sum("n") / float(rate))).alias("onset_density"),
        F.coalesce(F.avg(F.when(peak, F.col("onset"))), F.lit(0.0)).alias("mean_onset"),
        (F.count_if(above) / F.count(F.lit(1))).alias("transient_fraction"),
    )


def lag_range(feature_rate: float, low_bpm: float = 60.0, high_bpm: float = 180.0) -> tuple[int, int]:
    first = max(1, int(feature_rate * 60.0 / high_bpm + 0.5))
    return first, max(first + 1, int(feature_rate * 60.0 / low_bpm + 0.5))


def tempo(onsets: DataFrame, picked: DataFrame, feature_rate: float) -> DataFrame:
    """Best self-similarity lag of the onset curve as BPM with a confidence.

    Every lag is read from one window pass inside a block with a halo of the longest lag,
    so a long series is neither joined with itself nor sorted in one task.
    """
    lo, hi = lag_range(feature_rate)
    rows, w = with_halo(onsets.select("track_id", "win", "onset"), ["track_id"], "win", max(WIN_BLOCK, hi), before=hi)
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("onset", k).over(w).alias("past")) for k in range(lo, hi + 1)])
    pairs = home_rows(rows.withColumn("_l", lags)).select(
        "track_id", "onset", F.explode(F.filter("_l", lambda s: s["past"].isNotNull())).alias("p")
    )
    sums = pairs.groupBy("track_id", F.col("p.lag").alias("lag")).agg(
        F.sum(F.col("onset") * F.col("p.past")).alias("cross"),
        F.sum(F.col("onset") * F.col("onset")).alias("e1"),
        F.sum(F.col("p.past") * F.col("p.past")).alias("e2"),
    )
    similarity = F.col("cross") / F.sqrt(F.greatest(F.col("e1") * F.col("e2"), F.lit(1e-12)))
    preference = 1.0 + 0.08 * (1.0 - (F.col("lag") - lo) / float(max(1, hi - lo)))
    scored = sums.withColumn("score", similarity * preference)
    best = (
        scored.filter("score > 0").groupBy("track_id")
        .agg(F.max(F.struct("score", (-F.col("lag")).alias("neg"))).alias("b"))
        .select("track_id", F.col("b.score").alias("score"), (-F.col("b.neg")).alias("lag"))
    )
    ok = F.col("lag").isNotNull() & (F.col("onset_count") >= 3)
    strength = clamp(F.col("score"), 0, 1) * clamp(F.col("onset_count") / 16.0, 0.25, 1.0)
    return picked.select("track_id", "onset_count").join(best, "track_id", "left").select(
        "track_id",
        F.when(ok, 60.0 * feature_rate / F.col("lag")).otherwise(0.0).alias("bpm"),
        F.when(ok, strength).otherwise(0.0).alias("tempo_confidence"),
    )


def macro_dynamics(features: DataFrame) -> DataFrame:
    """Level percentiles, their spread and the spread of the crest."""
    f = features.withColumn("crest", amplitude_db_min(F.col("peak")) - F.col("rms_db"))
    a = linear_quantiles(f, ["track_id"], "rms_db", {"rms_p10": 0.1, "rms_p50": 0.5, "rms_p90": 0.9})
    b = linear_quantiles(f, ["track_id"], "crest", {"_c10": 0.1, "_c90": 0.9})
    return a.join(b, "track_id").select(
        "track_id", "rms_p10", "rms_p50", "rms_p90",
        F.greatest(F.lit(0.0), F.col("rms_p90") - F.col("rms_p10")).alias("macro_range_db"),
        F.greatest(F.lit(0.0), F.col("_c90") - F.col("_c10")).alias("crest_variability_db"))


def section_windows(onsets: DataFrame, limits: DataFrame, per_window: int) -> DataFrame:
    """Coarse windows of ``per_window`` feature frames with the distance to the window before (0 for the first)."""
    g = onsets.join(limits, "track_id").groupBy(
        "track_id", F.floor(F.col("win") / F.lit(per_window)).cast("bigint").alias("sec")
    ).agg(
        amplitude_db_min(F.sqrt(F.avg(F.col("rms") * F.col("rms")))).alias("energy_db"),
        F.avg("brightness").alias("brightness"),
        (F.count_if(F.col("onset") > F.col("onset_limit")) / F.count(F.lit(1))).alias("transients"),
        F.avg("width").alias("width"),
        F.sum("n").alias("n"),
    )
    rows, w = with_halo(g, ["track_id"], "sec", WIN_BLOCK, before=1)
    # fixed values: scale of one unit of change
    scales = {"energy_db": 5.0, "brightness": 0.10, "transients": 0.15, "width": 0.15}
    square = sum((F.pow((F.col(c) - F.lag(c).over(w)) / s, F.lit(2.0)) for c, s in scales.items()), F.lit(0.0))
    return home_rows(rows.withColumn("distance", F.coalesce(F.sqrt(square), F.lit(0.0))))


def section_boundaries(sections: DataFrame) -> DataFrame:
    """Window indices that start a new section (always including 0), with the boundary strength.

    Neighbouring candidates are taken alternately: with a spacing of two windows only directly
    adjacent candidates exclude each other, so each run of them is settled on its own.
    """
    limit = linear_quantiles(sections.filter("sec > 0"), ["track_id"], "distance", {"_q": 0.7}, width=0.01)
    rows, w = with_halo(sections.select("track_id", "sec", "distance"), ["track_id"], "sec", WIN_BLOCK, before=1, after=1)
    rows = home_rows(rows.withColumns({"_p": F.lag("distance").over(w), "_n": F.lead("distance").over(w)}))
    floor = F.greatest(F.lit(1.1), F.coalesce(F.col("_q"), F.lit(0.0)) * 1.15)
    candidate = (
        (F.col("sec") > 0) & (F.col("distance") >= floor) & (F.col("distance") >= F.col("_p"))
        & (F.col("distance") >= F.col("_n"))
    )
    rows = rows.join(limit, "track_id", "left")
    chosen = runs(rows, ["track_id"], "sec", (F.col("sec") == 0) | candidate, WIN_BLOCK).select(
        "track_id", F.explode(F.sequence("start_ix", "end_ix", F.lit(2).cast("bigint"))).alias("sec"))
    return chosen.join(rows.select("track_id", "sec", "distance"), ["track_id", "sec"]).select(
        "track_id", "sec", F.when(F.col("sec") > 0, F.col("distance")).otherwise(1.0).alias("strength"))


def label_sections(sections: DataFrame, boundaries: DataFrame, picked: DataFrame, per_window: int, size: int,
                   rate: float) -> DataFrame:
    """Sections between boundaries with their mean features, label and confidence."""
    marked = sections.join(
        boundaries.select("track_id", "sec", "strength", F.col("sec").alias("_b")), ["track_id", "sec"], "left")
    filled = fill_from_neighbours(marked, ["track_id"], "sec", WIN_BLOCK, "_b", "first", None)
    seg = filled.groupBy("track_id", "first").agg(
        F.max("strength").alias("strength"),
        F.avg("energy_db").alias("energy_db"), F.avg("brightness").alias("brightness"),
        F.avg("transients").alias("transients"), F.avg("width").alias("width"), F.sum("n").alias("n"))
    seg = position(seg, ["track_id"], [F.floor(F.col("first") / F.lit(WIN_BLOCK))], [F.col("first")], "segment")
    last = seg.groupBy("track_id").agg(F.max("first").alias("_last"))
    seg = seg.join(last, "track_id").withColumn("is_last", F.col("first") == F.col("_last"))
    median = linear_quantiles(sections, ["track_id"], "energy_db", {"_mid": 0.5})
    s = seg.join(median, "track_id").join(picked.select("track_id", "transient_fraction"), "track_id")
    e, mid, t, tf = F.col("energy_db"), F.col("_mid"), F.col("transients"), F.col("transient_fraction")
    label = (
        F.when((F.col("segment") == 0) & (e < mid - 2.0), "intro_like")
        .when(F.col("is_last") & (e < mid - 2.0), "outro_like")
        .when((e > mid + 2.5) & (t > tf), "high_energy")
        .when(e < mid - 3.0, "low_energy")
        .when(t > tf * 1.35, "rhythmic_dense")
        .otherwise("section")
    )
    start = F.col("first") * float(per_window * size) / float(rate)
    return s.select(
        "track_id", "segment", start.alias("start_s"), (start + F.col("n") / float(rate)).alias("end_s"),
        "energy_db", "brightness", "transients", "width", label.alias("label"),
        clamp(F.col("strength") / 2.5, 0.25, 0.95).alias("confidence"))


def sections(frames: DataFrame, rate: float, size: int = 1024, window_s: float = 2.0, block: int = 65536) -> DataFrame:
    """Frames to labelled sections; the small feature and window tables are written once and reused."""
    per_window = max(1, int(rate / size * window_s + 0.5))
    onsets = cut_lineage(onset_strength(feature_frames(frames, size, block)))
    limits = onset_threshold(onsets)
    windows = cut_lineage(section_windows(onsets, limits, per_window))
    bounds = cut_lineage(section_boundaries(windows))
    return label_sections(windows, bounds, pick_onsets(onsets, limits, rate), per_window, size, rate)


def section_contrast(sections: DataFrame) -> DataFrame:
    return sections.groupBy("track_id").agg(
        F.greatest(F.lit(0.0), F.max("energy_db") - F.min("energy_db")).alias("section_contrast_db"),
        F.count(F.lit(1)).alias("section_count"))
