"""Multi-resolution min/max/rms bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def waveform_pyramid(samples: DataFrame, base: int = 256, factor: int = 4) -> DataFrame:
    """``track_id, ch, level, bin_ix, min, max, rms, frames`` from long samples.

    Level 0 is aggregated once and written; every coarser level is made from the bins of the level below, which carry
    sums of squares and counts so that rms stays exact. All levels together have a third more bins than level 0. The number of
    levels is that of the longest series; a series takes part while the level below has more than one bin.
    """
    keys = ["track_id", "ch"]
    fine = cut_lineage(samples.groupBy(*keys, F.floor(F.col("frame_ix") / F.lit(base)).cast("bigint").alias("bin_ix")).agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("x").alias("frames")))
    last = fine.agg(F.max("bin_ix")).first()[0] or 0
    bins, levels = fine, [fine.withColumn("level", F.lit(0))]
    while last > 0:
        last //= factor
        bins = bins.groupBy(*keys, F.floor(F.col("bin_ix") / F.lit(factor)).cast("bigint").alias("_up")).agg(
            F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sq").alias("sq"), F.sum("frames").alias("frames"),
            F.max("bin_ix").alias("_below")).filter("_up > 0 OR _below > 0").drop("_below").withColumnRenamed("_up", "bin_ix")
        levels.append(bins.withColumn("level", F.lit(len(levels))))
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    return rows.select(*keys, "level", "bin_ix", "min", "max", F.sqrt(F.col("sq") / F.col("frames")).alias("rms"), "frames")
