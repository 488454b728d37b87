"""How far a reconstruction (``p``) is from its original (``o``): residual, transient and detail mismatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import clamp
from .ordering import home_rows, with_halo


def reconstruction_metrics(pairs: DataFrame, rate: float, block: int = 65536) -> DataFrame:
    """``track_id, ch, frame_ix, o, p`` to ratios of energies, correlation and a length-based confidence."""
    rows, w = with_halo(pairs, ["track_id", "ch"], "frame_ix", block, before=2)
    d = {}
    for v in ("o", "p"):
        d[f"{v}1"] = F.col(v) - F.lag(v).over(w)
        d[f"{v}2"] = F.col(v) - 2 * F.lag(v).over(w) + F.lag(v, 2).over(w)
    rows = home_rows(rows.withColumns(d))

    def ratio(a: str, b: str):
        diff = F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
        ref = F.sum(F.col(a) * F.col(a))
        return F.coalesce(F.sqrt(F.try_divide(diff, ref)), F.lit(0.0))

    norm = F.sqrt(F.sum(F.col("o") * F.col("o")) * F.sum(F.col("p") * F.col("p")))
    corr = F.coalesce(F.try_divide(F.sum(F.col("o") * F.col("p")), norm), F.lit(1.0))
    seconds = (F.max("frame_ix") + 1) / float(rate)
    return rows.groupBy("track_id").agg(
        ratio("o", "p").alias("residual_ratio"), ratio("o1", "p1").alias("transient_ratio"),
        ratio("o2", "p2").alias("hf_ratio"), clamp(corr, -1, 1).alias("correlation"),
        (0.55 + 0.35 * F.least(F.lit(1.0), seconds / 30.0)).alias("confidence"))
