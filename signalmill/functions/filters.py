"""Second-order filter designs and state-space systems for linear scans.

Designs follow the public audio-EQ formulas (bilinear transform, Q form); a system is
``s' = A s + B x, y = C s + D x`` and systems in series fold into one larger system.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class System:
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    @property
    def order(self) -> int:
        return self.a.shape[0]


def series(*systems: System) -> System:
    """The systems applied one after another."""
    out = systems[0]
    for nxt in systems[1:]:
        n, m = out.order, nxt.order
        a = np.zeros((n + m, n + m))
        a[:n, :n] = out.a
        a[n:, :n] = np.outer(nxt.b, out.c)
        a[n:, n:] = nxt.a
        out = System(
            a, np.concatenate([out.b, nxt.b * out.d]), np.concatenate([nxt.d * out.c, nxt.c]), nxt.d * out.d
        )
    return out


def one_pole(alpha: float) -> System:
    """``y += alpha * (x - y)`` with the updated value as output."""
    keep = 1.0 - alpha
    return System(np.array([[keep]]), np.array([alpha]), np.array([keep]), alpha)


def one_pole_high(keep: float) -> System:
    """First-order high-pass ``y = keep * (y + x - x_previous)``."""
    a = np.array([[keep, -keep], [0.0, 0.0]])
    return System(a, np.array([keep, 1.0]), np.array([keep, -keep]), keep)


def cutoff_alpha(hz: float, rate: float) -> float:
    return 1.0 - math.exp(-2.0 * math.pi * hz / rate)


def rc_alpha(hz: float, rate: float) -> float:
    dt, rc = 1.0 / rate, 1.0 / (2.0 * math.pi * hz)
    return dt / (rc + dt)


def time_keep(ms: float, rate: float) -> float:
    """Per-sample retention of an exponential follower with time constant ``ms``."""
    return math.exp(-1.0 / (0.001 * ms * rate)) if ms > 0 else 0.0


def biquad(b0, b1, b2, a0, a1, a2) -> System:
    b0, b1, b2, a1, a2 = (v / a0 for v in (b0, b1, b2, a1, a2))
    return System(
        np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0]), b0
    )


def usable_frequency(hz: float, rate: float) -> float:
    return min(max(hz, 10.0), rate * 0.49)


def design(shape: str, hz: float, rate: float, gain_db: float = 0.0, q: float = 0.707) -> System:
    """``peak``, ``low_pass``, ``high_pass``, ``low_shelf``, ``high_shelf`` or ``band_pass``; shelves ignore q."""
    w = 2.0 * math.pi * usable_frequency(hz, rate) / rate
    cw, sw = math.cos(w), math.sin(w)
    alpha = sw / (2.0 * min(max(q, 0.1), 12.0))
    amp = 10.0 ** (gain_db / 40.0)
    if shape == "peak":
        return biquad(1 + alpha * amp, -2 * cw, 1 - alpha * amp, 1 + alpha / amp, -2 * cw, 1 - alpha / amp)
    if shape in ("low_pass", "high_pass"):
        sign = 1.0 if shape == "low_pass" else -1.0
        edge = 1.0 - sign * cw
        return biquad(edge / 2, sign * edge, edge / 2, 1 + alpha, -2 * cw, 1 - alpha)
    if shape == "band_pass":
        return biquad(alpha, 0.0, -alpha, 1 + alpha, -2 * cw, 1 - alpha)
    if shape in ("low_shelf", "high_shelf"):
        # mirror cos(w) to turn the low shelf into the high shelf
        m = 1.0 if shape == "low_shelf" else -1.0
        root = 2.0 * math.sqrt(amp) * sw * math.sqrt(2.0) / 2.0
        up, down = amp + 1.0, amp - 1.0
        return biquad(
            amp * (up - m * down * cw + root), 2 * m * amp * (down - m * up * cw), amp * (up - m * down * cw - root),
            up + m * down * cw + root, -2 * m * (down + m * up * cw), up + m * down * cw - root,
        )
    raise ValueError(f"unknown filter shape {shape}")


def k_weighting(rate: float) -> System:
    """Loudness pre-filter of ITU-R BS.1770 for any rate: high shelf then high pass."""
    # analog prototypes that reproduce the 48 kHz table of the recommendation
    gain_db, q, fc = 3.999843853973347, 0.7071752369554196, 1681.974450955533
    k, vh = math.tan(math.pi * fc / rate), 10.0 ** (gain_db / 20.0)
    vb = vh**0.4996667741545416
    a0 = 1.0 + k / q + k * k
    shelf = biquad(
        (vh + vb * k / q + k * k) / a0, 2.0 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0,
        1.0, 2.0 * (k * k - 1.0) / a0, (1.0 - k / q + k * k) / a0,
    )
    q, fc = 0.5003270373238773, 38.13547087602444
    k = math.tan(math.pi * fc / rate)
    a0 = 1.0 + k / q + k * k
    high = biquad(1.0, -2.0, 1.0, 1.0, 2.0 * (k * k - 1.0) / a0, (1.0 - k / q + k * k) / a0)
    return series(shelf, high)
