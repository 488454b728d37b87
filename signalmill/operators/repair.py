"""Restoring clipped runs, resampling, playback profiles, segment characteristics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters as fl
from ..functions.levels import amplitude_db, clamp, is_finite
from ..session import cut_lineage
from .frames import block_halos
from .ordering import runs
from .scans import DEFAULT_BLOCK, linear_scan, to_blocks
from .stereo import pearson

SAMPLE = ["track_id", "ch"]


def declip(samples: DataFrame, threshold: float = 0.98, longest: int | None = None, block: int = 65536) -> DataFrame:
    """Replace clipped runs by a cubic through the two good samples on each side (never below the threshold).

    Runs longer than ``longest`` (default: none is too long) stay as they are. Only run rows and their four anchors take part in joins; other samples pass through. Anchors are the original
    samples, also where two runs are one sample apart.
    """
    x = F.col("x")
    found = runs(samples, SAMPLE, "frame_ix", is_finite(x) & (F.abs(x) >= threshold), block)
    # a run needs two samples before it; the two after it are checked by the anchor count
    found = found.filter(F.col("start_ix") >= 2)
    if longest is not None:
        found = found.filter(F.col("length") <= longest)
    need = found.select(
        *SAMPLE, "start_ix", "end_ix",
        F.explode(F.array(*[F.struct(F.lit(i).alias("a"), p.alias("frame_ix")) for i, p in enumerate((
            F.col("start_ix") - 2, F.col("start_ix") - 1, F.col("end_ix") + 1, F.col("end_ix") + 2))])).alias("n")
    ).select(*SAMPLE, "start_ix", "end_ix", "n.a", "n.frame_ix")
    anchors = (
        need.join(samples, [*SAMPLE, "frame_ix"]).groupBy(*SAMPLE, "start_ix", "end_ix")
        .agg(*[F.max(F.when(F.col("a") == i, x)).alias(f"y{i}") for i in range(4)], F.count(F.lit(1)).alias("_n"))
        .filter("_n = 4"))
    rows = anchors.withColumn("frame_ix", F.explode(F.sequence("start_ix", "end_ix")))
    t = (F.col("frame_ix") - F.col("start_ix") + 1) / (F.col("end_ix") - F.col("start_ix") + 2)
    m0, m1 = (F.col("y2") - F.col("y0")) / 2, (F.col("y3") - F.col("y1")) / 2
    curve = (
        (2 * t * t * t - 3 * t * t + 1) * F.col("y1") + (t * t * t - 2 * t * t + t) * m0
        + (3 * t * t - 2 * t * t * t) * F.col("y2") + (t * t * t - t * t) * m1)
    fixed = rows.select(*SAMPLE, "frame_ix", F.greatest(F.abs(curve), F.lit(threshold)).alias("_new"))
    out = samples.join(fixed, [*SAMPLE, "frame_ix"], "left")
    sign = F.when(x >= 0, 1.0).otherwise(-1.0)
    return out.select(
        *SAMPLE, "frame_ix", F.coalesce(sign * F.col("_new"), x).alias("x"), F.col("_new").isNotNull().alias("repaired"))


def declip_report(repaired: DataFrame, threshold: float = 0.98) -> DataFrame:
    top = F.max(F.when(F.col("repaired"), F.abs("x")))
    return repaired.groupBy("track_id").agg(
        F.count_if("repaired").alias("repaired_samples"),
        F.coalesce(F.when(top > threshold, 20 * F.log10(top / threshold)), F.lit(0.0)).alias("peak_gain_db"))


def resample(samples: DataFrame, rate_in: int, rate_out: int, half: int = 32, passband: float = 0.94,
             block: int = DEFAULT_BLOCK) -> DataFrame:
    """Windowed-sinc rate change of long samples; every block makes the output frames that start in it.

    The phase repeats after ``rate_out / gcd`` outputs, so a block multiplies a small bank of filters. The last
    block knows the series length from its own end, and the output has ``round(n * ratio)`` frames.
    """
    ratio = rate_out / rate_in
    cutoff = 0.5 * min(1.0, ratio) * passband
    div = int(np.gcd(rate_in, rate_out))
    up = rate_out // div
    taps = np.arange(-half + 1, half + 1)
    bank = []
    for k in range(up):
        d = taps - (k * (rate_in // div) % up) / up
        h = np.sinc(2 * cutoff * d) * (0.42 + 0.5 * np.cos(np.pi * d / half) + 0.08 * np.cos(2 * np.pi * d / half))
        h[np.abs(d) > half] = 0.0
        bank.append(h / h.sum())
    bank = np.stack(bank)

    @F.pandas_udf("struct<first:bigint,y:array<double>>")
    def run(ix: pd.Series, head: pd.Series, x: pd.Series, tail: pd.Series, total: pd.Series) -> pd.DataFrame:
        firsts, ys = [], []
        for b, before, own, after, n in zip(ix, head, x, tail, total):
            lo, last = int(b) * block, int(b) * block + len(own) == n
            data = np.concatenate([np.zeros(half - 1), own, np.zeros(half)])
            if len(before):
                use = before[-(half - 1):]
                data[half - 1 - len(use) : half - 1] = use
            data[half - 1 + len(own) : half - 1 + len(own) + len(after)] = after
            k0 = -(-lo * rate_out // rate_in)
            k1 = int(np.floor(n * ratio + 0.5)) if last else -(-(lo + len(own)) * rate_out // rate_in)
            k = np.arange(k0, k1)
            center = np.minimum(k * rate_in // rate_out - lo, len(own) - 1)
            win = np.lib.stride_tricks.sliding_window_view(data, 2 * half)
            ys.append((win[center] * bank[k % up]).sum(axis=1) if len(k) else np.zeros(0))
            firsts.append(k0)
        return pd.DataFrame({"first": firsts, "y": ys})

    b = block_halos(to_blocks(samples, SAMPLE, "frame_ix", ["x"], block), SAMPLE, half, half)
    size = samples.groupBy(*SAMPLE).agg((F.max("frame_ix") + 1).alias("_n"))
    out = b.join(size, SAMPLE).select(*SAMPLE, run("block_ix", "head", "x", "tail", "_n").alias("o"))
    return out.select(*SAMPLE, "o.first", F.posexplode("o.y").alias("i", "x")).select(
        *SAMPLE, (F.col("first") + F.col("i")).alias("frame_ix"), "x")


# fixed values: profile, low cutoff Hz, high cutoff Hz, emphasis dB, mono, peak limit dB
PROFILES = [
    ("studio_monitors", 20.0, 20000.0, 0.0, False, -0.1),
    ("headphones", 15.0, 22000.0, 0.0, False, -0.2),
    ("earbuds", 45.0, 17000.0, 2.5, False, -0.5),
    ("phone_speaker", 260.0, 14000.0, 4.0, True, -1.0),
    ("laptop_speaker", 180.0, 15000.0, 2.0, False, -0.8),
    ("bluetooth_speaker", 75.0, 16000.0, 2.0, True, -0.5),
    ("car_audio", 30.0, 16500.0, 3.5, False, -0.3),
    ("mono_system", 25.0, 19000.0, 0.0, True, -0.1),
    ("club_pa", 28.0, 18000.0, 4.0, False, -0.1),
]
SMALL = ("phone_speaker", "laptop_speaker", "bluetooth_speaker")


def profile_fanout(frames: DataFrame, rate: float, profiles=PROFILES, hz_scale: float = 1.0,
                   block: int = DEFAULT_BLOCK) -> DataFrame:
    """Peak and rms of every series under every playback profile.

    All band limits are one linear scan over the blocks (one output per profile and channel); the nine results are
    reduced to two numbers per block before anything is shuffled.
    """
    filters = {}
    for name, lo, hi, *_ in profiles:
        dt, rc = 1.0 / rate, 1.0 / (2 * np.pi * lo * hz_scale)
        # high-pass on input differences: y = keep * (x - previous x)
        keep = rc / (rc + dt)
        diff = fl.System(np.array([[0.0]]), np.array([1.0]), np.array([-keep]), keep)
        chain = fl.series(diff, fl.one_pole(fl.rc_alpha(hi * hz_scale, rate)))
        for c in ("l", "r"):
            filters[f"{name}_{c}"] = (c, chain)
    # a scan reads its blocks more than once
    b = linear_scan(cut_lineage(to_blocks(frames, ["track_id"], "frame_ix", ["l", "r"], block)), ["track_id"], filters, block)
    stats = []
    for name, lo, hi, emphasis, mono, top_db in profiles:
        top, boost = 10 ** (top_db / 20), 10 ** (emphasis * 0.25 / 20)
        l, r = _driver(f"{name}_l", top, boost), _driver(f"{name}_r", top, boost)
        if mono:
            l = r = F.zip_with(l, r, lambda x, y: (x + y) * 0.5)
        both = F.concat(l, r)
        stats.append(F.struct(
            F.lit(name).alias("profile"), F.array_max(F.transform(both, F.abs)).alias("peak"),
            F.aggregate(both, F.lit(0.0), lambda acc, v: acc + v * v).alias("sq"), F.size(both).alias("n")))
    rows = b.select("track_id", F.explode(F.array(*stats)).alias("s")).select("track_id", "s.*")
    return rows.groupBy("track_id", "profile").agg(
        F.max("peak").alias("peak"), F.sqrt(F.sum("sq") / F.sum("n")).alias("rms"))


def _driver(c: str, top: float, boost: float):
    """Emphasis and soft limit of a playback device."""
    def squeeze(v):
        y = v * boost
        return F.when(y > top, top + (y - top) * 0.2).when(y < -top, -top + (y + top) * 0.2).otherwise(y)

    return F.transform(c, squeeze)


def profile_scores(p: DataFrame) -> DataFrame:
    crest = F.when(F.col("rms") > 1e-6, F.col("peak") / F.nullif(F.col("rms"), F.lit(0.0))).otherwise(1.0)
    score = 1.0 - F.when(crest < 2, 0.15).otherwise(0.0) - F.when(F.col("peak") > 1.2, 0.20).otherwise(0.0)
    return p.withColumns({"score": clamp(score, 0.4, 1), "headroom_db": amplitude_db(F.col("peak"), -80.0)})


def translation_summary(scored: DataFrame, levels: DataFrame) -> DataFrame:
    """Overall, small-speaker, mono and low-end scores plus survival ratios against the track's own rms."""
    def of(name, col="score"):
        return F.max(F.when(F.col("profile") == name, F.col(col)))

    g = scored.groupBy("track_id").agg(
        F.avg("score").alias("overall"), F.avg(F.when(F.col("profile").isin(*SMALL), F.col("score"))).alias("small_speaker"),
        of("mono_system").alias("mono"), of("club_pa").alias("car_club"), of("phone_speaker", "rms").alias("_small"),
        of("mono_system", "rms").alias("_mono"))
    j = g.join(levels, "track_id")
    def ratio(c):
        return F.when(F.col("rms") > 1e-6, F.col(c) / F.nullif(F.col("rms"), F.lit(0.0))).otherwise(1.0)

    s, m = ratio("_small"), ratio("_mono")
    out = j.withColumns({
        "kick_small": clamp(s * 1.2, 0.1, 1), "kick_mono": clamp(m * 1.05, 0.2, 1), "vocal_small": clamp(s * 1.1, 0.4, 1),
        "vocal_mono": clamp(m, 0.4, 1), "snare_small": clamp(s * 1.15, 0.3, 1), "snare_mono": clamp(m * 1.02, 0.3, 1)})
    warn = F.filter(F.array(
        F.when(F.col("kick_small") < 0.45, "kick"), F.when(F.col("vocal_mono") < 0.7, "vocal"),
        F.when(F.col("snare_small") < 0.5, "snare")), lambda x: x.isNotNull())
    return out.withColumn("warnings", warn).drop("_small", "_mono", "rms")


def segment_characteristics(frames: DataFrame, rate: float, segment: int, f0_range=(30.0, 1000.0)) -> DataFrame:
    """Pitch, centroid, correlation, crest and harmonicity per fixed-length segment (a bounded group)."""
    seg = F.floor(F.col("frame_ix") / F.lit(segment)).cast("bigint").alias("segment")
    mono = (F.col("l") + F.col("r")) / 2
    g = frames.groupBy("track_id", seg).agg(
        F.array_sort(F.collect_list(F.struct("frame_ix", mono.alias("m")))).alias("_x"),
        pearson("l", "r").alias("correlation"),
        F.max(F.abs(mono)).alias("_p"), F.sqrt(F.avg(mono * mono)).alias("_r"))

    @F.pandas_udf("struct<f0:double,centroid:double>")
    def pitch(x: pd.Series) -> pd.DataFrame:
        rows = [(_f0(np.asarray(v, float), rate, *f0_range), _centroid(np.asarray(v, float), rate)) for v in x]
        return pd.DataFrame(rows, columns=["f0", "centroid"])

    g = g.withColumn("_u", pitch(F.transform("_x", lambda s: s["m"])))
    crest = F.when((F.col("_r") > 1e-9) & (F.col("_p") > 1e-9), 20 * F.log10(F.col("_p") / F.nullif(F.col("_r"), F.lit(0.0))))
    g = g.withColumn("crest_db", F.coalesce(crest, F.lit(0.0)))
    return g.select(
        "track_id", "segment", F.col("_u.f0").alias("f0_hz"), F.col("_u.centroid").alias("centroid_hz"),
        "correlation", "crest_db",
        F.when(F.col("_u.f0") > 0, clamp(F.col("crest_db") / 20, 0.2, 0.95)).otherwise(0.1).alias("harmonicity"))


def _f0(x: np.ndarray, rate: float, low: float, high: float, shortest: int = 256) -> float:
    """First lag of the highest normalised self-similarity above 0.4 over half the segment."""
    half, lo, hi = len(x) // 2, int(rate / high), int(rate / low)
    if len(x) < shortest or hi >= half:
        return 0.0
    a, power = x[:half], np.concatenate([[0.0], np.cumsum(x * x)])
    if power[half] <= 1e-12:
        return 0.0
    lags = np.arange(max(lo, 1), hi + 1)
    size = 1 << int(np.ceil(np.log2(half + len(x))))
    cross = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(x, size), size)[lags]
    norm = np.sqrt(power[half] * np.maximum(power[lags + half] - power[lags], 0.0))
    score = np.where(norm > 1e-12, cross / np.maximum(norm, 1e-300), -1.0)
    best = int(np.argmax(np.round(score, 12)))
    return float(rate / lags[best]) if score[best] > 0.4 else 0.0


def _centroid(x: np.ndarray, rate: float, longest: int | None = None, shortest: int = 64) -> float:
    if len(x) < shortest:
        return 0.0
    n = min(len(x), longest or len(x))
    taper = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))
    mag = np.abs(np.fft.rfft(x[:n] * taper))[1 : n // 2]
    total = mag.sum()
    return float((np.arange(1, n // 2) * rate / n * mag).sum() / total) if total > 1e-12 else 0.0


# fixed values
REFERENCE_BANDS = [
    ("sub_db", 20.0, 60.0), ("bass_db", 60.0, 250.0), ("low_mid_db", 250.0, 500.0), ("mid_db", 500.0, 2000.0),
    ("high_mid_db", 2000.0, 6000.0), ("presence_db", 6000.0, 12000.0), ("air_db", 12000.0, 20000.0)]


def reference_profile(frames: DataFrame, rate: float, bands=REFERENCE_BANDS, head: int | None = None, max_bins: int | None = None,
                      window: int = 4096) -> DataFrame:
    """Level summary and band levels of the whole series: power averaged over windows of ``window`` samples, each weighted
    by its samples (the last one is filled up with zeros; a shorter series is one window of its own length).

    ``head`` takes band levels from the first so many samples only, with the bins of the whole length; ``max_bins`` leaves
    out higher bins. Windows with values that are not finite are left out. Only the samples of one window meet in one row.
    """
    mono = (F.col("l") + F.col("r")) / 2
    levels = frames.groupBy("track_id").agg(
        (F.max("frame_ix") + 1).alias("frames"), F.sqrt(F.avg(mono * mono)).alias("_r"), F.max(F.abs(mono)).alias("_p"))
    used = frames if head is None else frames.filter(F.col("frame_ix") < head)
    place = F.floor(F.col("frame_ix") / F.lit(window)) if head is None else F.lit(0)
    parts = used.groupBy("track_id", place.cast("bigint").alias("_w")).agg(
        F.array_sort(F.collect_list(F.struct("frame_ix", mono.alias("m")))).alias("_x")).join(levels.select("track_id", "frames"), "track_id")
    length = F.least("frames", F.lit(window)) if head is None else F.col("frames")
    names = [b[0] for b in bands]
    fields = [f for n in names for f in (n, f"{n}_bins")]

    @F.pandas_udf("struct<" + ",".join(f"{f}:double" for f in fields) + ">")
    def spectrum(x: pd.Series, count: pd.Series) -> pd.DataFrame:
        rows = []
        for v, n in zip(x, count):
            v, k = np.asarray(v, float), np.arange(1, max(min(int(n) // 2, max_bins or int(n)), 1))
            if head is None:
                p = np.abs(np.fft.rfft(v, int(n))[k]) ** 2 / len(v) ** 2
            else:
                p = np.abs(np.exp(-2j * np.pi * np.outer(k, np.arange(len(v))) / n) @ v) ** 2 / len(v) ** 2
            hz = k * rate / n
            inside = [(hz >= lo) & (hz < hi) for _, lo, hi in bands]
            rows.append([t for i in inside for t in (p[i].sum(), i.sum())] if np.isfinite(p).all() else [None] * (2 * len(bands)))
        return pd.DataFrame(rows, columns=fields)

    size = F.size("_x")
    powers = parts.withColumn("_s", spectrum(F.transform("_x", lambda s: s["m"]), length)).groupBy("track_id").agg(
        *[F.try_divide(F.sum(F.col(f"_s.{n}") * size), F.sum(F.when(F.col(f"_s.{n}").isNotNull(), size))).alias(n) for n in names],
        *[F.max(f"_s.{n}_bins").alias(f"{n}_bins") for n in names])
    j = levels.join(powers, "track_id")
    rms, peak = F.col("_r"), F.col("_p")
    return j.select(
        "track_id", "frames", F.when(rms > 1e-9, 20 * F.log10(rms) - 0.691).otherwise(-70.0).alias("integrated_lufs"),
        F.when(peak > 1e-9, 20 * F.log10(peak)).otherwise(-70.0).alias("true_peak_dbtp"),
        F.when((rms > 1e-9) & (peak > 1e-9), 20 * F.log10(peak / F.nullif(rms, F.lit(0.0)))).otherwise(10.0).alias("crest_db"),
        *[F.when(F.col(n) > 1e-12, 10 * F.log10(F.col(n) / F.nullif(F.col(f"{n}_bins"), F.lit(0.0)))).otherwise(-70.0).alias(n) for n in names])
