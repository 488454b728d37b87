"""Label resolution and picked events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import home_rows, with_halo
from .scans import from_blocks, refractory_scan, to_blocks


def best_label(scores: DataFrame, key: str = "segment_id") -> DataFrame:
    """Highest score per segment; on ties the label that comes first (``i``)."""
    top = F.max(F.struct("confidence", (-F.col("i")).alias("n"), "label")).alias("t")
    return scores.groupBy(key).agg(top).select(key, "t.label", "t.confidence")


def taxonomy_backoff(scores: DataFrame, closure: DataFrame, key: str = "segment_id") -> DataFrame:
    """Best label moved up its tree to the first ancestor whose minimum the confidence reaches.

    The closure is the fixed label tree (under a hundred rows), small enough to broadcast at any data size.
    """
    best = best_label(scores, key).withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    up = best.join(F.broadcast(closure), "label").filter(F.col("confidence") >= F.col("minimum"))
    near = up.groupBy(key).agg(F.min_by(F.struct("ancestor", "role", "confidence"), "depth").alias("n"))
    known = F.col("n.ancestor") != "unknown"
    return near.select(
        key, F.col("n.ancestor").alias("label"), F.col("n.role").alias("role"),
        F.when(known, F.col("n.confidence")).otherwise(0.0).alias("confidence"))


def pick_regularity(picks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tempo from the mean interval of picked events, folded into 70..180 by octaves (0 when undefined)."""
    g = picks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("picks"), (F.max("time_s") - F.min("time_s")).alias("_d"))
    step = F.try_divide(F.col("_d"), (F.col("picks") - 1).cast("double"))
    raw = F.when((F.col("picks") > 1) & (F.col("_d") > 0.5) & (step > 0.1), 60.0 / F.nullif(step, F.lit(0.0)))
    up = F.pow(F.lit(2.0), F.ceil(F.log2(70.0 / raw)))
    down = F.pow(F.lit(2.0), F.ceil(F.log2(raw / 180.0)))
    bpm = F.when(raw < 70, raw * up).when(raw > 180, raw / down).otherwise(raw)
    return g.select(*keys, "picks", F.coalesce(bpm, F.lit(0.0)).alias("bpm"))


def refractory_pick(windows: DataFrame, keys: Sequence[str], skip: int, block: int = 65536) -> DataFrame:
    """Greedy spacing over ``keys, pos, hit`` (``pos`` without gaps): a hit counts if more than ``skip``
    positions lie between it and the last counted one. Exact and parallel along one long series: a block's
    effect depends only on how many positions are still blocked when it starts (0..skip).
    """
    b = to_blocks(windows.withColumn("hit", F.col("hit").cast("double")), keys, "pos", ["hit"], block)
    picked = from_blocks(refractory_scan(b, keys, "hit", "picked", skip, block), keys, "pos", ["picked"], block)
    return picked.filter(F.col("picked") > 0).select(*keys, "pos")


def overlapping_rms(filtered: DataFrame, window: int) -> DataFrame:
    """Rms of overlapping windows (hop half a window) of a filtered series: ``track_id, pos, rms``."""
    hop = window // 2
    part = filtered.groupBy("track_id", F.floor(F.col("frame_ix") / F.lit(hop)).cast("bigint").alias("_h")).agg(
        F.sum(F.col("y") * F.col("y")).alias("_e"), F.count(F.lit(1)).alias("_n"))
    rows, w = with_halo(part, ["track_id"], "_h", 4096, after=2)
    full = home_rows(rows.withColumns({
        "_e2": F.lead("_e").over(w), "_n2": F.lead("_n").over(w), "_n3": F.lead("_n", 2).over(w)}))
    # windows start one window in and must end before the last sample
    ok = (F.col("_n") + F.col("_n2") == 2 * hop) & (F.col("_h") >= 2) & F.col("_n3").isNotNull()
    return full.filter(ok).select(
        "track_id", (F.col("_h") - 2).alias("pos"), F.sqrt((F.col("_e") + F.col("_e2")) / (2.0 * hop)).alias("rms"))


def source_presence(sources: DataFrame, programs: DataFrame, share: float = 0.01) -> DataFrame:
    """Sources whose rms is more than ``share`` of the program's, with the ratio as confidence in 0.5..0.95."""
    ratio = F.try_divide(F.col("source_rms"), F.col("program_rms"))
    j = sources.join(programs, "track_id").withColumn("ratio", F.coalesce(ratio, F.lit(0.0)))
    return j.filter(F.col("ratio") > share).withColumn(
        "confidence", F.least(F.greatest("ratio", F.lit(0.5)), F.lit(0.95)))
