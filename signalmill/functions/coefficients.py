"""Biquad designs as column expressions on plan tables (one row per band)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def biquad_coefficients(shape: str, frequency_hz: str, gain_db: str, q: str, rate: float) -> Column:
    """Struct ``b0,b1,b2,a1,a2`` normalised by a0; frequency and q are brought into range first."""
    hz = F.least(F.greatest(F.col(frequency_hz).cast("double"), F.lit(10.0)), F.lit(rate * 0.49))
    w = hz * (2.0 * math.pi / rate)
    c, s = F.cos(w), F.sin(w)
    al = s / (2.0 * F.least(F.greatest(F.col(q).cast("double"), F.lit(0.1)), F.lit(12.0)))
    a = F.pow(F.lit(10.0), F.col(gain_db).cast("double") / 40.0)
    root = 2.0 * F.sqrt(a) * s * (math.sqrt(2.0) / 2.0)
    kind = F.col(shape)

    def shelf(m: float):
        up, down = a + 1, a - 1
        return [a * (up - m * down * c + root), 2 * m * a * (down - m * up * c), a * (up - m * down * c - root),
                up + m * down * c + root, -2 * m * (down + m * up * c), up + m * down * c - root]

    def edge(m: float):
        return [(1 - m * c) / 2, m * (1 - m * c), (1 - m * c) / 2, 1 + al, -2 * c, 1 - al]

    table = {
        "peak": [1 + al * a, -2 * c, 1 - al * a, 1 + al / a, -2 * c, 1 - al / a],
        "low_pass": edge(1.0), "high_pass": edge(-1.0), "low_shelf": shelf(1.0), "high_shelf": shelf(-1.0),
        "band_pass": [al, F.lit(0.0), -al, 1 + al, -2 * c, 1 - al],
    }
    raw = []
    for i in range(6):
        expr = None
        for name, values in table.items():
            expr = F.when(kind == name, values[i]) if expr is None else expr.when(kind == name, values[i])
        raw.append(expr)
    b0, b1, b2, a0, a1, a2 = raw
    return F.struct((b0 / a0).alias("b0"), (b1 / a0).alias("b1"), (b2 / a0).alias("b2"), (a1 / a0).alias("a1"), (a2 / a0).alias("a2"))
