"""Exact order statistics per key without gathering a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import running_total


def _ranked_values(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Distinct values with their rank range ``[_lo, _hi)`` and the group size ``_n``."""
    keys = list(keys)
    # the input may be costly and is read once; the counted values are read for ranks, totals and sizes
    counts = cut_lineage(
        df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    # two levels of value ranges keep both the sort and the list of ranges short
    coarse = F.floor(F.col("_v") / F.lit(width * 256.0))
    fine = F.floor(F.col("_v") / F.lit(width))
    ranked = running_total(counts, keys, [coarse, fine], [F.col("_v")], F.col("_c"), "_hi")
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = ranked.join(sizes, keys) if keys else ranked.crossJoin(F.broadcast(sizes))  # one-row side
    return ranked.withColumn("_lo", F.col("_hi") - F.col("_c"))


def _pick(rank: Column) -> Column:
    return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))


def linear_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], width: float = 0.05
) -> DataFrame:
    """Linear-interpolated quantiles (position ``p*(n-1)``), one output column per entry of ``probs``."""
    ranked = _ranked_values(df, keys, value, width)
    picks, finals = [], []
    for name, p in probs.items():
        where = F.lit(p) * (F.col("_n") - 1)
        picks += [
            _pick(F.floor(where)).alias(f"_{name}_lo"),
            _pick(F.ceil(where)).alias(f"_{name}_hi"),
            F.max(where - F.floor(where)).alias(f"_{name}_t"),
        ]
        lo, hi, t = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_t")
        finals.append(F.when(lo == hi, lo).otherwise(lo * (1 - t) + hi * t).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *finals)


def ranked_value(
    df: DataFrame, keys: Sequence[str], value: str, rank_of_n, out: str, width: float = 0.05
) -> DataFrame:
    """The value at zero-based rank ``rank_of_n(n)``: upper median, nearest rank and the like."""
    ranked = _ranked_values(df, keys, value, width)
    return ranked.groupBy(*keys).agg(_pick(rank_of_n(F.col("_n"))).alias(out))
