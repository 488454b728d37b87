"""Averaged spectra, band powers and resonances.

Windows are cut from block rows that carry the first samples of the next block, so the FFT runs
where the block already is and only one power vector per block is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import clamp, power_db, score_from_ratio
from .frames import block_halos
from .scans import DEFAULT_BLOCK, to_blocks

# fixed values
BAND_EDGES = (20.0, 60.0, 250.0, 500.0, 2000.0, 6000.0, 20000.0)


def power_spectrum(mono: DataFrame, fft: int = 2048, block: int = DEFAULT_BLOCK) -> DataFrame:
    """``track_id, bin, power, windows`` from ``track_id, frame_ix, x``: symmetric Hann, half-window hop,
    powers added over all full windows; a series shorter than one window is zero-padded."""
    if block % fft:
        raise ValueError("the block must hold whole windows")
    hop = fft // 2
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / (fft - 1))

    @F.pandas_udf("array<double>")
    def powers(ix: pd.Series, x: pd.Series, tail: pd.Series) -> pd.Series:
        out = []
        for b, own, after in zip(ix, x, tail):
            data = np.concatenate([own, after])
            starts = np.arange(0, len(own), hop)
            starts = starts[starts + fft <= len(data)]
            if len(starts):
                win = data[starts[:, None] + np.arange(fft)[None, :]] * taper
            elif b == 0:
                win = np.zeros((1, fft))
                win[0, : len(data)] = data * taper[: len(data)]
            else:
                out.append(np.zeros(0))
                continue
            total = (np.abs(np.fft.rfft(win, axis=1)) ** 2).sum(axis=0)
            out.append(np.append(total, len(win)))
        return pd.Series(out)

    b = block_halos(to_blocks(mono, ["track_id"], "frame_ix", ["x"], block), ["track_id"], 0, fft)
    bins = fft // 2 + 1
    rows = b.select("track_id", F.posexplode(powers("block_ix", "x", "tail")).alias("bin", "p"))
    g = rows.groupBy("track_id", "bin").agg(F.sum("p").alias("power"))
    count = g.filter(F.col("bin") == bins).select("track_id", F.col("power").cast("bigint").alias("windows"))
    return g.filter(F.col("bin") < bins).join(count, "track_id")


def spectral_shape(spectrum: DataFrame, rate: float, fft: int, share: float = 0.85) -> DataFrame:
    """Centroid and roll-off per track. The cumulative sum runs over the bins of one spectrum (fft/2+1 rows)."""
    hz = F.col("bin") * float(rate) / float(fft)
    w = Window.partitionBy("track_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = spectrum.withColumns({"_hz": hz, "_cum": F.sum("power").over(w)})
    total = s.groupBy("track_id").agg(
        F.sum("power").alias("_total"), F.coalesce(F.try_divide(F.sum(F.col("_hz") * F.col("power")), F.sum("power")), F.lit(0.0))
        .alias("centroid_hz"))
    j = s.join(total, "track_id")
    return j.groupBy("track_id").agg(
        F.first("centroid_hz").alias("centroid_hz"),
        F.coalesce(F.min(F.when(F.col("_cum") >= F.col("_total") * share, F.col("_hz"))), F.lit(0.0)).alias("rolloff_hz"))


def cumulative_share(spectrum: DataFrame) -> DataFrame:
    """Share of power up to each bin (a spectrum has fft/2+1 rows per series)."""
    w = Window.partitionBy("track_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("power").over(Window.partitionBy("track_id"))
    return spectrum.select("track_id", "bin", (F.sum("power").over(w) / F.nullif(total, F.lit(0.0))).alias("share"))


def band_ratios(spectrum: DataFrame, rate: float, fft: int, edges=BAND_EDGES) -> DataFrame:
    """Share of power in six half-open bands (the last ends at Nyquist if that is lower)."""
    hz = F.col("bin") * float(rate) / float(fft)
    total = F.sum("power")
    bands = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if i == len(edges) - 2:
            hi = min(hi, rate / 2)
        part = F.sum(F.when((hz >= lo) & (hz < hi), F.col("power")).otherwise(0.0))
        bands.append(F.struct(F.lit(float(lo)).alias("low_hz"), F.lit(float(hi)).alias("high_hz"),
                              F.coalesce(F.try_divide(part, total), F.lit(0.0)).alias("energy_ratio")))
    return spectrum.groupBy("track_id").agg(F.array(*bands).alias("bands"))


def band_frequencies(rate: float, count: int = 40, low: float = 40.0) -> np.ndarray:
    return low * (min(16000.0, rate * 0.46) / low) ** (np.arange(count) / (count - 1))


def window_band_powers(mono: DataFrame, rate: float, window: int = 2048, count: int = 40, low: float = 40.0,
                       shortest: int = 32, block: int = DEFAULT_BLOCK) -> DataFrame:
    """``track_id, win, band, power, end_s``: Hann-weighted power at log-spaced frequencies per window.

    A last window of fewer than ``shortest`` samples is left out (1: none is); one of under three samples has no taper."""
    if block % window:
        raise ValueError("the block must hold whole windows")
    hz = band_frequencies(rate, count, low)

    def basis(n: int) -> np.ndarray:
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 2 else np.ones(n)
        return np.exp(-2j * np.pi * np.outer(np.arange(n), hz) / rate) * taper[:, None] / n

    @F.pandas_udf("array<struct<w:int,n:int,p:array<double>>>")
    def powers(x: pd.Series) -> pd.Series:
        full = basis(window)
        out = []
        for own in x:
            rows = []
            for w, at in enumerate(range(0, len(own), window)):
                part = np.asarray(own[at : at + window])
                if len(part) < shortest:
                    continue
                m = full if len(part) == window else basis(len(part))
                rows.append({"w": w, "n": len(part), "p": np.abs(part @ m) ** 2})
            out.append(rows)
        return pd.Series(out)

    per = block // window
    b = to_blocks(mono, ["track_id"], "frame_ix", ["x"], block)
    w = b.select("track_id", "block_ix", F.explode(powers("x")).alias("s"))
    win = (F.col("block_ix") * per + F.col("s.w")).alias("win")
    end = ((F.col("block_ix") * block + F.col("s.w") * window + F.col("s.n")) / float(rate)).alias("end_s")
    return w.select("track_id", win, end, F.posexplode("s.p").alias("band", "power"))


def band_profile(powers: DataFrame, rate: float, count: int = 40, low: float = 40.0, limit_db: float = 4.0) -> DataFrame:
    """Mean power per band with how often, when first and when last it stood out from its two neighbours.

    Neighbours along frequency come from one row per window (a window has ``count`` bands).
    """
    db = power_db(F.col("power"))
    w = Window.partitionBy("track_id", "win").orderBy("band")
    out = powers.withColumn("_db", db).withColumn(
        "_out", F.coalesce(F.col("_db") - (F.lag("_db").over(w) + F.lead("_db").over(w)) / 2 >= limit_db, F.lit(False)))
    g = out.groupBy("track_id", "band").agg(
        F.avg("power").alias("power"), (F.count_if("_out") / F.count(F.lit(1))).alias("persistence"),
        F.min(F.when(F.col("_out"), F.col("end_s"))).alias("first_s"), F.max(F.when(F.col("_out"), F.col("end_s"))).alias("last_s"))
    step = (min(16000.0, rate * 0.46) / low) ** (1.0 / (count - 1))
    return g.withColumn("frequency_hz", F.lit(low) * F.pow(F.lit(step), F.col("band")))


def tonal_scores(profile: DataFrame, total=(80.0, 14000.0), sub=(40.0, 95.0), mud=(150.0, 450.0), harsh=(2500.0, 6500.0),
                 bright=(6500.0, 16000.0)) -> DataFrame:
    hz, p = F.col("frequency_hz"), F.col("power")

    def part(band, closed=False):
        upper = hz <= band[1] if closed else hz < band[1]
        return F.sum(F.when((hz >= band[0]) & upper, p).otherwise(0.0))

    den = F.greatest(part(total, True), F.lit(1e-18))
    return profile.groupBy("track_id").agg(
        score_from_ratio(part(sub) / den, 0.18, 0.35).alias("sub_buildup"),
        score_from_ratio(part(mud) / den, 0.24, 0.32).alias("mud"),
        score_from_ratio(part(harsh) / den, 0.22, 0.30).alias("harshness"),
        score_from_ratio(part(bright, True) / den, 0.16, 0.32).alias("brightness_score"))


def top_resonances(profile: DataFrame, n: int = 8, low_hz: float = 80.0, high_hz: float = 12000.0,
                   min_prominence: float = 2.5, base: float = 2.0) -> DataFrame:
    """The ``n`` most severe persistent peaks per track (lower band first on ties)."""
    w = Window.partitionBy("track_id").orderBy("band")
    mean = power_db(F.col("power"))
    p = profile.withColumn("_db", mean).withColumn(
        "prominence_db", F.col("_db") - (F.lag("_db").over(w) + F.lead("_db").over(w)) / 2)
    sev = clamp((F.col("prominence_db") - base) / 9.0 * (F.col("persistence") + 0.55), 0, 1)
    p = p.filter(F.col("frequency_hz").between(low_hz, high_hz) & (F.col("prominence_db") >= min_prominence)
                 & (F.col("persistence") >= 0.08)).withColumn("severity", sev)
    order = Window.partitionBy("track_id").orderBy(F.col("severity").desc(), "band")
    return p.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select(
        "track_id", "place", "band", "frequency_hz", "prominence_db", "persistence", "severity",
        F.coalesce("first_s", F.lit(0.0)).alias("first_s"), F.coalesce("last_s", F.lit(0.0)).alias("last_s"))


def perceptual_summary(scores: DataFrame, resonances: DataFrame, harsh=(2500.0, 6500.0)) -> DataFrame:
    """Harshness raised by resonances in its range, and the overall tonal imbalance."""
    bump = resonances.filter(F.col("frequency_hz").between(*harsh)).groupBy("track_id").agg(
        F.sum(F.col("severity") * F.col("persistence") * 0.25).alias("_b"))
    s = scores.join(bump, "track_id", "left").withColumn(
        "harshness", clamp(F.col("harshness") + F.coalesce("_b", F.lit(0.0)), 0, 1)).drop("_b")
    return s.withColumn("tonal_imbalance", F.greatest(
        "sub_buildup", "mud", "harshness", F.abs(F.col("brightness_score") - 0.35) * 0.65))
