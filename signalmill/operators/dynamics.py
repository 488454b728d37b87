"""Level and tone processing of block tables (``track_id, block_ix, l, r``), state carried across blocks.

Memoryless work is array expressions; linear parts are one linear scan; followers and limiters are exact
block scans, so one long series is processed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as fl
from ..functions.levels import (
    amplitude_db_clamped, clamp, clip_soft, knee_gain_db, lit, narrow_width, saturate, to_linear,
)
from ..session import cut_lineage
from .scans import DEFAULT_BLOCK, follower_scan, limiter_scan, linear_scan

KEYS = ["track_id"]


def _zip(a, b, fn) -> Column:
    return F.zip_with(a, b, fn)


def _peaks(a="l", b="r") -> Column:
    return _zip(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y)))


def _both(df: DataFrame, fn) -> DataFrame:
    """The same array expression on both channels."""
    return df.withColumns({"l": fn("l"), "r": fn("r")})


def _keep(df: DataFrame) -> DataFrame:
    return df.select("track_id", "block_ix", "l", "r")


def apply_gain(b: DataFrame, gain_db: float) -> DataFrame:
    g = to_linear(lit(gain_db))
    return _both(b, lambda c: F.transform(c, lambda x: x * g))


def apply_eq(b: DataFrame, bands: list[dict], rate: float, block: int = DEFAULT_BLOCK) -> DataFrame:
    """All bands as one cascade in a single scan."""
    sys = fl.series(*[fl.design(x["shape"], x["frequency_hz"], rate, x.get("gain_db", 0.0), x.get("q", 0.707)) for x in bands])
    f = linear_scan(b, KEYS, {"_l": ("l", sys), "_r": ("r", sys)}, block)
    return f.select("track_id", "block_ix", F.col("_l").alias("l"), F.col("_r").alias("r"))


def _follow(b: DataFrame, targets: dict[str, Column], attack_ms, release_ms, rate, block, linear_first=False) -> DataFrame:
    """Smooth gain targets in dB (falling fast, rising slowly) into columns of linear gains."""
    # a scan reads its input twice (summaries, then values): write what an earlier scan made
    t = b.withColumns({f"_t_{k}": v for k, v in targets.items()})
    if linear_first:
        t = cut_lineage(t)
    fast, slow = fl.time_keep(attack_ms, rate), fl.time_keep(release_ms, rate)
    t = follower_scan(t, KEYS, {f"_g_{k}": (f"_t_{k}", fast, slow) for k in targets}, 0.0, block)
    return t.withColumns({f"_g_{k}": F.transform(f"_g_{k}", to_linear) for k in targets})


def compress(b: DataFrame, rate: float, threshold_db=-18.0, ratio=1.5, attack_ms=20.0, release_ms=120.0, knee_db=6.0,
             makeup_db=0.0, mix=1.0, block: int = DEFAULT_BLOCK) -> DataFrame:
    target = F.transform(_peaks(), lambda p: knee_gain_db(amplitude_db_clamped(p), threshold_db, ratio, knee_db))
    g = _follow(b, {"c": target}, attack_ms, release_ms, rate, block)
    wet, makeup = min(max(mix, 0.0), 1.0), to_linear(lit(makeup_db))
    return _keep(_both(g, lambda c: _zip(c, "_g_c", lambda x, k: x + (x * k * makeup - x) * wet)))


def dynamic_eq(b: DataFrame, rate: float, frequency_hz=80.0, q=1.0, threshold_db=-22.0, ratio=2.0, attack_ms=15.0,
               release_ms=140.0, max_reduction_db=3.0, block: int = DEFAULT_BLOCK) -> DataFrame:
    det = fl.design("band_pass", frequency_hz, rate, q=q)
    f = linear_scan(b, KEYS, {"_bl": ("l", det), "_br": ("r", det)}, block)
    target = F.transform(_peaks("_bl", "_br"), lambda p: F.greatest(
        knee_gain_db(amplitude_db_clamped(p), threshold_db, ratio, 3.0), lit(-abs(max_reduction_db))))
    g = _follow(f, {"d": target}, attack_ms, release_ms, rate, block, linear_first=True)
    add = {c: _zip(c, _zip(f"_b{c}", "_g_d", lambda x, k: x * (k - 1.0)), lambda x, y: x + y) for c in ("l", "r")}
    return _keep(g.withColumns(add))


def multiband(b: DataFrame, rate: float, low_crossover_hz=120.0, high_crossover_hz=5000.0, low_threshold_db=-18.0,
              mid_threshold_db=-16.0, high_threshold_db=-18.0, low_ratio=1.4, mid_ratio=1.3, high_ratio=1.4, attack_ms=25.0,
              release_ms=160.0, block: int = DEFAULT_BLOCK) -> DataFrame:
    lo = fl.design("low_pass", low_crossover_hz, rate, q=0.70710678)
    hi = fl.design("high_pass", high_crossover_hz, rate, q=0.70710678)
    lo2, hi2 = fl.series(lo, lo), fl.series(hi, hi)
    f = linear_scan(b, KEYS, {"_lol": ("l", lo2), "_lor": ("r", lo2), "_hil": ("l", hi2), "_hir": ("r", hi2)}, block)
    mid = {f"_mi{c}": _zip(_zip(c, f"_lo{c}", lambda x, y: x - y), f"_hi{c}", lambda x, y: x - y) for c in ("l", "r")}
    f = f.withColumns(mid)
    setup = {"lo": (low_threshold_db, low_ratio), "mi": (mid_threshold_db, mid_ratio), "hi": (high_threshold_db, high_ratio)}

    def curve(band, thr, rat):
        return F.transform(_peaks(f"_{band}l", f"_{band}r"), lambda p: knee_gain_db(amplitude_db_clamped(p), thr, rat, 4.0))

    g = _follow(f, {k: curve(k, *v) for k, v in setup.items()}, attack_ms, release_ms, rate, block, linear_first=True)

    def total(c):
        parts = [_zip(f"_{k}{c}", f"_g_{k}", lambda x, y: x * y) for k in setup]
        return _zip(_zip(parts[0], parts[1], lambda x, y: x + y), parts[2], lambda x, y: x + y)

    return _keep(g.withColumns({"l": total("l"), "r": total("r")}))


def transient_shape(b: DataFrame, rate: float, attack_db=0.0, sustain_db=0.0, fast_ms=3.0, slow_ms=35.0, mix=1.0,
                    block: int = DEFAULT_BLOCK) -> DataFrame:
    """Both followers have fixed coefficients, so they are one linear scan of the peak."""
    fast, slow = (fl.one_pole(1.0 - fl.time_keep(ms, rate)) for ms in (fast_ms, slow_ms))
    f = linear_scan(b.withColumn("_p", _peaks()), KEYS, {"_f": ("_p", fast), "_s": ("_p", slow)}, block)
    shape = _zip("_f", "_s", lambda x, y: clamp((x - y) / F.greatest(y, lit(1e-6)), -1, 1))
    gain = F.transform(shape, lambda s: to_linear(F.when(s >= 0, s * attack_db).otherwise(-s * sustain_db)))
    wet = min(max(mix, 0.0), 1.0)
    f = f.withColumn("_g", gain)
    return _keep(_both(f, lambda c: _zip(c, "_g", lambda x, k: x * (1.0 + (k - 1.0) * wet))))


def apply_saturation(b: DataFrame, drive_db=0.0, mix=0.0) -> DataFrame:
    return _both(b, lambda c: F.transform(c, lambda x: saturate(x, drive_db, min(max(mix, 0.0), 1.0))))


def apply_clip(b: DataFrame, threshold_db=-1.0, softness=0.25) -> DataFrame:
    return _both(b, lambda c: F.transform(c, lambda x: clip_soft(x, threshold_db, softness)))


def stereo_bass_mono(b: DataFrame, rate: float, width=1.0, bass_mono_hz=90.0, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Widen or narrow the side signal; below the cutoff it is kept almost mono."""
    alpha = fl.cutoff_alpha(fl.usable_frequency(bass_mono_hz, rate), rate)
    s = b.withColumns({"_m": _zip("l", "r", lambda x, y: (x + y) * 0.5), "_d": _zip("l", "r", lambda x, y: (x - y) * 0.5)})
    f = linear_scan(s, KEYS, {"_lo": ("_d", fl.one_pole(alpha))}, block)
    w = min(max(width, 0.0), 2.0)
    f = f.withColumn("_o", _zip("_d", "_lo", lambda d, x: (d - x) * w + x * min(w, 0.08)))
    return _keep(f.withColumns({"l": _zip("_m", "_o", lambda m, o: m + o), "r": _zip("_m", "_o", lambda m, o: m - o)}))


def limit(b: DataFrame, rate: float, ceiling_db=-1.0, release_ms=80.0, block: int = DEFAULT_BLOCK) -> DataFrame:
    top = 10.0 ** (ceiling_db / 20.0)
    t = b.withColumn("_t", F.transform(_peaks(), lambda p: F.when(p > top, top / F.nullif(p, lit(0.0))).otherwise(1.0)))
    g = limiter_scan(t, KEYS, "_t", "_g", fl.time_keep(release_ms, rate), block)
    return _keep(_both(g, lambda c: _zip(c, "_g", lambda x, k: clamp(x * k, -top, top))))


def denoise_gate(b: DataFrame, rate: float, noise_floor_db=-60.0, reduction_db=6.0, spectral_floor=0.1,
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per-channel downward gate under twice the noise floor, 5 ms up and 80 ms down."""
    floor = 2.0 * 10.0 ** (noise_floor_db / 20.0)
    least = max(10.0 ** (-reduction_db / 20.0), spectral_floor)
    dt = 1.0 / rate
    rise, fall = 1.0 - dt / (0.005 + dt), 1.0 - dt / (0.080 + dt)
    m = b.withColumns({f"_a{c}": F.transform(c, F.abs) for c in ("l", "r")})
    e = follower_scan(m, KEYS, {f"_e{c}": (f"_a{c}", fall, rise) for c in ("l", "r")}, 0.0, block)

    def gate(c):
        return _zip(c, f"_e{c}", lambda x, v: F.when(v < floor, x * clamp(v / floor, least, 1)).otherwise(x))

    return _keep(e.withColumns({"l": gate("l"), "r": gate("r")}))


def transient_repair(b: DataFrame, rate: float, boost_db=3.0, max_boost_db=4.0, sensitivity=0.3,
                     block: int = DEFAULT_BLOCK) -> DataFrame:
    """Raise attacks where a 2 ms follower exceeds a 50 ms one; adds ``enhanced`` (count on the first channel)."""
    dt = 1.0 / rate
    fast, slow = fl.one_pole(dt / (0.002 + dt)), fl.one_pole(dt / (0.050 + dt))
    top = 10.0 ** (min(boost_db, max_boost_db) / 20.0)
    m = b.withColumns({f"_a{c}": F.transform(c, F.abs) for c in ("l", "r")})
    f = linear_scan(m, KEYS, {f"_{s}{c}": (f"_a{c}", sy) for c in ("l", "r") for s, sy in (("f", fast), ("s", slow))}, block)

    def gain(c):
        return _zip(f"_f{c}", f"_s{c}", lambda x, y: F.when(
            (x > y * (1.0 + sensitivity)) & (y > 1e-4), 1.0 + (top - 1.0) * clamp((x - y) / F.nullif(x, lit(0.0)), 0, 1)))

    f = f.withColumns({"_gl": gain("l"), "_gr": gain("r")})
    f = f.withColumn("enhanced", F.size(F.filter("_gl", lambda g: g.isNotNull())))
    out = {c: _zip(c, f"_g{c}", lambda x, g: F.when(g.isNotNull(), clamp(x * g, -1, 1)).otherwise(x)) for c in ("l", "r")}
    return f.withColumns(out).select("track_id", "block_ix", "l", "r", "enhanced")


def guided_apply(b: DataFrame, rate: float, center_hz: float = 1000.0, octaves: float = 1.0, max_gain=1.5, max_cut=2.5,
                 max_transient=0.35, max_width=0.30, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Bounded interventions in fixed order: gain ride, dynamic cut, transient taming, width reduction.

    Amount arrays per frame: ``gain_db`` and ``cut_db`` (negative), ``tame``, ``narrow`` (positive). Each is limited
    to its maximum whatever was asked for.
    """
    b = b.withColumns({c: _zip(c, "gain_db", lambda x, a: x * to_linear(clamp(a, -max_gain, 0))) for c in ("l", "r")})
    ratio = 2.0 ** min(max(octaves, 0.2), 2.0)
    det = fl.design("band_pass", center_hz, rate, q=min(max(ratio**0.5 / (ratio - 1.0), 0.25), 12.0))
    b = linear_scan(b, KEYS, {"_bl": ("l", det), "_br": ("r", det)}, block)
    for c in ("l", "r"):
        cut = _zip(f"_b{c}", "cut_db", lambda x, a: x * (to_linear(clamp(a, -max_cut, 0)) - 1.0))
        b = b.withColumn(c, _zip(c, cut, lambda x, y: x + y))
    keep = {k: fl.time_keep(ms, rate) for k, ms in TRANSIENT_MS.items()}
    b = follower_scan(cut_lineage(b.withColumn("_p", _peaks())), KEYS, {
        "_f": ("_p", keep["fast_release"], keep["fast_attack"]),
        "_s": ("_p", keep["reference_release"], keep["reference_attack"])}, 0.0, block)
    excess = _zip("_f", "_s", lambda f, s: clamp((f - s) / F.greatest(f, lit(1e-12)), 0, 1))
    b = b.withColumn("_g", _zip("tame", excess, lambda a, e: 1.0 - clamp(a, 0, max_transient) * e))
    b = _both(b, lambda c: _zip(c, "_g", lambda x, g: x * g))
    rows = F.arrays_zip("l", "r", "narrow")
    b = b.withColumn("_z", F.transform(rows, lambda s: F.struct(
        narrow_width(s["l"], s["r"], s["narrow"], max_width)[0].alias("l"),
        narrow_width(s["l"], s["r"], s["narrow"], max_width)[1].alias("r"))))
    return b.select("track_id", "block_ix", F.col("_z.l").alias("l"), F.col("_z.r").alias("r"))


# fixed values
TRANSIENT_MS = {"fast_attack": 0.5, "fast_release": 15.0, "reference_attack": 12.0, "reference_release": 120.0}

PROCESSORS = {
    "gain": lambda b, rate, p, block: apply_gain(b, **p),
    "eq": lambda b, rate, p, block: apply_eq(b, p["bands"], rate, block),
    "compressor": lambda b, rate, p, block: compress(b, rate, **p, block=block),
    "dynamic_eq": lambda b, rate, p, block: dynamic_eq(b, rate, **p, block=block),
    "multiband": lambda b, rate, p, block: multiband(b, rate, **p, block=block),
    "transient": lambda b, rate, p, block: transient_shape(b, rate, **p, block=block),
    "saturation": lambda b, rate, p, block: apply_saturation(b, **p),
    "stereo": lambda b, rate, p, block: stereo_bass_mono(b, rate, **p, block=block),
    "clipper": lambda b, rate, p, block: apply_clip(b, **p),
    "limiter": lambda b, rate, p, block: limit(b, rate, **p, block=block),
}


MEMORYLESS = {"gain", "saturation", "clipper"}


def register_processor(name: str, fn) -> None:
    """Add a processor type: ``fn(blocks, rate, params, block_size) -> blocks``."""
    PROCESSORS[name] = fn


def run_graph(b: DataFrame, nodes: list[dict], rate: float, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Apply an ordered plan to every series; bypassed nodes vanish and neighbouring gains become one."""
    if not nodes:
        raise ValueError("a plan needs at least one node")
    ids = [n["id"] for n in nodes]
    if len(set(ids)) != len(ids) or "" in ids:
        raise ValueError("node ids must be unique and not empty")
    active: list[dict] = []
    for n in nodes:
        if n.get("bypass"):
            continue
        if active and n["type"] == active[-1]["type"] == "gain":
            active[-1] = {**n, "params": {"gain_db": active[-1]["params"]["gain_db"] + n["params"]["gain_db"]}}
        else:
            active.append(n)
    for i, n in enumerate(active):
        b = PROCESSORS[n["type"]](b, rate, n["params"], block)
        # the next scan would run this one twice: keep its result in files; memoryless nodes just join the next stage
        if n["type"] not in MEMORYLESS and any(m["type"] not in MEMORYLESS for m in active[i + 1 :]):
            b = cut_lineage(b)
    return b
