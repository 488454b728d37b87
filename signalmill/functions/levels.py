"""Scalar numeric policy: decibels, clamps, ramps, gain curves, share and risk formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, lit(lo)), lit(hi))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def amplitude_db(x: Column, floor_db: float = -200.0) -> Column:
    """20 log10, with a fixed level for non-positive input."""
    return F.when(x > 0, 20.0 * F.log10(x)).otherwise(F.lit(float(floor_db)))


def amplitude_db_min(x: Column, minimum: float = 1e-12, floor_db: float = -120.0) -> Column:
    """20 log10, values at or below ``minimum`` become ``floor_db``."""
    return F.when(x > minimum, 20.0 * F.log10(x)).otherwise(F.lit(float(floor_db)))


def amplitude_db_clamped(x: Column, minimum: float = 1e-12) -> Column:
    return 20.0 * F.log10(F.greatest(x, lit(minimum)))


def power_db(p: Column, minimum: float = 1e-18) -> Column:
    return 10.0 * F.log10(F.greatest(p, lit(minimum)))


def to_linear(db: Column) -> Column:
    return F.pow(lit(10.0), db / 20.0)


def gain(x: Column, db) -> Column:
    return x * to_linear(lit(db))


def ramp(v: Column, lo, hi) -> Column:
    """0 up to ``lo`` (and for non-finite input), 1 from ``hi``, linear between."""
    lo, hi = lit(lo), lit(hi)
    return (
        F.when(~is_finite(v) | (v <= lo), 0.0)
        .when(hi <= lo, 1.0)
        .otherwise(clamp((v - lo) / F.nullif(hi - lo, lit(0.0)), 0, 1))
    )


def score_from_ratio(ratio: Column, start, span) -> Column:
    return clamp((ratio - lit(start)) / lit(span), 0, 1)


def finite_or(x: Column, default) -> Column:
    return F.when(is_finite(x), x).otherwise(lit(default))


def risk_from_ratio(r: Column, k) -> Column:
    return F.when(is_finite(r), clamp(1 - F.exp(-r * lit(k)), 0, 1)).otherwise(1.0)


def saturate(x: Column, drive_db, mix) -> Column:
    drive = F.greatest(to_linear(lit(drive_db)), lit(1.0))
    wet = F.tanh(x * drive) / F.tanh(drive)
    return x * (1 - lit(mix)) + wet * lit(mix)


def clip_soft(x: Column, threshold_db, softness) -> Column:
    """Hard limit at the threshold with a quadratic knee below it."""
    top = to_linear(lit(threshold_db))
    soft = clamp(lit(softness), 0, 0.95)
    knee = top * (1 - soft)
    size = F.abs(x)
    span = F.nullif(F.greatest(top - knee, lit(1e-9)), lit(0.0))
    t = (size - knee) / span
    bent = knee + (top - knee) * (1 - (1 - t) * (1 - t))
    return F.when(size >= top, F.signum(x) * top).when((soft > 0) & (size > knee), F.signum(x) * bent).otherwise(x)


def knee_gain_db(level: Column, threshold, ratio, knee) -> Column:
    """Static compressor curve: gain in dB for an input level in dB."""
    thr, rat, kn = lit(threshold), lit(ratio), lit(knee)
    over, slope = level - thr, 1.0 / F.greatest(rat, lit(1.0)) - 1.0
    return (
        F.when(kn <= 0, F.when(over <= 0, 0.0).otherwise(slope * over))
        .when(over <= -kn / 2, 0.0)
        .when(over >= kn / 2, slope * over)
        .otherwise(slope * F.pow(over + kn / 2, lit(2.0)) / (2.0 * F.nullif(kn, lit(0.0))))
    )


def narrow_width(l: Column, r: Column, reduction, cap: float = 0.30) -> tuple[Column, Column]:
    """Scale the side signal by ``1 - reduction`` (reduction limited to ``cap``)."""
    keep = 1 - clamp(lit(reduction), 0, cap)
    mid, side = (l + r) * 0.5, (l - r) * 0.5 * keep
    return mid + side, mid - side


def power_share(a_db: Column, b_db: Column, absent: float = -190.0) -> Column:
    """Loudness share of a against b as a power ratio in 0..2."""
    usable = is_finite(a_db) & is_finite(b_db) & (a_db > absent) & (b_db > absent)
    return F.when(usable, clamp(F.pow(lit(10.0), (a_db - b_db) / 10.0), 0, 2)).otherwise(0.0)


def quantize(x: Column, bits: int) -> Column:
    step = float(2 ** (bits - 1))
    return clamp(F.round(x * step) / step, -1.0, 1.0 - 1.0 / step)


def tpdf_noise(bits: int, seed: int, *position: Column) -> Column:
    """Triangular noise of one quantization step, a pure function of the sample position."""
    def u(salt: int) -> Column:
        return F.pmod(F.xxhash64(*position, F.lit(seed), F.lit(salt)), F.lit(2**53)) / F.lit(float(2**53)) - 0.5

    return (u(1) + u(2)) * float(2.0 ** -(bits - 1))


def wilson_bounds(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    z2 = z * z
    center = (p + z2 / (2.0 * n)) / (1.0 + z2 / n)
    spread = z * F.sqrt((p * (1.0 - p) + z2 / (4.0 * n)) / n) / (1.0 + z2 / n)
    low = F.when(n.isNotNull(), F.greatest(lit(0.0), center - spread))
    high = F.when(n.isNotNull(), F.least(lit(1.0), center + spread))
    return low, high


def band_overlap(bands: Column, lo, hi) -> Column:
    """Energy of ``array<struct<low_hz,high_hz,energy_ratio>>`` that falls in lo..hi, each band taken as flat."""
    lo, hi = lit(lo), lit(hi)

    def part(b: Column) -> Column:
        width = b["high_hz"] - b["low_hz"]
        shared = F.greatest(lit(0.0), F.least(b["high_hz"], hi) - F.greatest(b["low_hz"], lo))
        return F.when(width > 0, b["energy_ratio"] * shared / F.nullif(width, lit(0.0))).otherwise(0.0)

    return clamp(F.aggregate(bands, lit(0.0), lambda acc, b: acc + part(b)), 0, 1)


def assessment(score: Column) -> Column:
    """Four labels for a 0..100 score."""
    return (
        F.when(score >= 85, "strong")
        .when(score >= 70, "generally_balanced")
        .when(score >= 50, "attention_warranted")
        .otherwise("high_risk")
    )


def time_range_valid(start: Column, end: Column) -> Column:
    """Both bounds absent, or both present with 0 <= start < end."""
    both_absent = start.isNull() & end.isNull()
    ordered = (start >= 0) & (end > start)
    return both_absent | (start.isNotNull() & end.isNotNull() & F.coalesce(ordered, F.lit(False)))


def is_sha256_hex(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def r(x: Column, digits: int = 6) -> Column:
    """Rounding used where results leave the library."""
    return F.round(x, digits)
