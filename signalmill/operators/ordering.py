"""Order-dependent building blocks that never put a whole series into one task.

A series may hold a third of all rows, so every ordered operator here works in two
levels: rows are ordered inside a bounded bucket (a block of frames, a day, a value
range), and only one small summary row per bucket is ordered across the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows of ``keys`` up to and including this one.

    ``buckets`` are expressions that never decrease along ``order``; rows are only ever
    sorted inside one combination of buckets, and bucket totals are accumulated level by level.
    """
    keys = list(keys)
    names = [f"_bucket{i}" for i in range(len(buckets))]
    base = df.withColumns({n: b for n, b in zip(names, buckets)})
    # null keys are equal inside a struct, so rows lie for the join as they do for the window: they are dealt and sorted once;
    # most of them are told apart by the hash alone
    at = ["_hash", "_at"] if names else keys
    place = [F.xxhash64(*keys, *names).alias("_hash"), F.struct(*keys, *names).alias("_at")]
    rows = base.select("*", *place) if names else base
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(out, F.sum(value).over(inside))
    if not names:
        return rows
    totals = base.groupBy(*keys, *names).agg(F.sum(value).alias("_total"))
    if len(names) > 1:  # each level reads the totals again; the rows are summed up once
        totals = cut_lineage(totals)
    offsets = _bucket_offsets(totals, keys, names).select(*place, "_before")
    return (
        rows.join(offsets, at, "left")
        .withColumn(out, F.col(out) + F.coalesce(F.col("_before"), F.lit(0)))
        .drop(*at, "_before", *names)
    )


def _same_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal values where null equals null: rows without a key are a series too."""
    other = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(other, same, how).drop(*[f"_on_{c}" for c in on])


def _bucket_offsets(totals: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Total of all earlier buckets (``_before``) per bucket combination."""
    outer, last = names[:-1], names[-1]
    w = Window.partitionBy(*keys, *outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    here = totals.withColumn("_before", F.coalesce(F.sum("_total").over(w), F.lit(0)))
    if not outer:
        return here.select(*keys, *names, "_before")
    upper = _bucket_offsets(totals.groupBy(*keys, *outer).agg(F.sum("_total").alias("_total")), keys, outer)
    return _same_join(here, upper.withColumnRenamed("_before", "_outer_before"), [*keys, *outer], "inner").select(
        *keys, *names, (F.col("_before") + F.col("_outer_before")).alias("_before")
    )


def position(df: DataFrame, keys: Sequence[str], buckets: Sequence[Column], order: Sequence[Column], out: str) -> DataFrame:
    """Zero-based position of each row in its series; rows are sorted inside buckets, whatever the size of the series."""
    return running_total(df, keys, buckets, order, F.lit(1).cast("bigint"), out).withColumn(out, F.col(out) - 1)


def with_halo(
    df: DataFrame, keys: Sequence[str], pos: str, block: int, before: int = 0, after: int = 0
) -> tuple[DataFrame, Window]:
    """Copy edge rows into the neighbouring block so lag/lead never cross a block border.

    Returns the rows with ``_block`` and ``_home`` plus the window to use on them. Keep
    only ``_home`` rows after the window functions ran. ``before``/``after`` rows of the
    neighbours are visible; both must fit in one block.
    """
    if before > block or after > block:
        raise ValueError("a halo must not be longer than a block")
    own = F.floor(F.col(pos) / F.lit(block)).cast("bigint")
    offset = F.pmod(F.col(pos), F.lit(block))
    copies = [own]
    if after:
        copies.append(F.when((offset < after) & (own > 0), own - 1))
    if before:
        copies.append(F.when(offset >= block - before, own + 1))
    targets = F.filter(F.array(*copies), lambda t: t.isNotNull()) if len(copies) > 1 else F.array(own)
    rows = (
        df.withColumn("_own", own)
        .withColumn("_block", F.explode(targets))
        .withColumn("_home", F.col("_block") == F.col("_own"))
        .drop("_own")
    )
    return rows, Window.partitionBy(*keys, "_block").orderBy(pos)


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter("_home").drop("_home", "_block")


def fill_from_neighbours(
    df: DataFrame, keys: Sequence[str], pos: str, block: int, value: str, previous: str | None, following: str | None,
    tie: Sequence[Column] = (),
) -> DataFrame:
    """Nearest non-null ``value`` at or before (``previous``) / at or after (``following``) each row.

    Inside a block by window; across blocks from one summary row per block.
    """
    keys = list(keys)
    base = df.withColumn("_block", F.floor(F.col(pos) / F.lit(block)).cast("bigint"))
    w = Window.partitionBy(*keys, "_block").orderBy(pos, *tie)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = base
    if previous:
        rows = rows.withColumn(previous, F.last(value, ignorenulls=True).over(back))
    if following:
        rows = rows.withColumn(following, F.first(value, ignorenulls=True).over(ahead))
    at = F.when(F.col(value).isNotNull(), F.col(pos))
    blocks = base.groupBy(*keys, "_block").agg(F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy("_block")
    carry = blocks.select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_prev"),
        F.first("_first", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_next"),
    )
    rows = rows.join(carry, [*keys, "_block"], "left")
    if previous:
        rows = rows.withColumn(previous, F.coalesce(previous, "_carry_prev"))
    if following:
        rows = rows.withColumn(following, F.coalesce(following, "_carry_next"))
    return rows.drop("_block", "_carry_prev", "_carry_next")


def runs(
    df: DataFrame, keys: Sequence[str], pos: str, flag: Column, block: int
) -> DataFrame:
    """Maximal runs of consecutive positions where ``flag`` holds: ``keys, start_ix, end_ix, length``.

    Gaps-and-islands in each block gives partial runs; partial runs that touch at a block
    border are then joined, again with one pass over the (few) partial runs per block border.
    """
    keys = list(keys)
    hit = df.filter(flag).select(*keys, pos).withColumn("_block", F.floor(F.col(pos) / F.lit(block)).cast("bigint"))
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    partial = (
        hit.withColumn("_island", F.col(pos) - F.row_number().over(w))
        .groupBy(*keys, "_block", "_island")
        .agg(F.min(pos).alias("start_ix"), F.max(pos).alias("end_ix"))
    )
    # read twice below; the samples behind it are read once
    partial = cut_lineage(partial)
    touches_start = F.pmod(F.col("start_ix"), F.lit(block)) == 0
    touches_end = F.pmod(F.col("end_ix"), F.lit(block)) == block - 1
    inner = partial.filter(~touches_start & ~touches_end).select(*keys, "start_ix", "end_ix")
    # border pieces: at most two per block, chained where one ends right before the next starts
    border = partial.filter(touches_start | touches_end)
    wk = Window.partitionBy(*keys).orderBy("start_ix")
    chained = border.withColumn(
        "_new", F.when(F.lag("end_ix").over(wk) == F.col("start_ix") - 1, 0).otherwise(1)
    ).withColumn("_chain", F.sum("_new").over(wk.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = chained.groupBy(*keys, "_chain").agg(F.min("start_ix").alias("start_ix"), F.max("end_ix").alias("end_ix"))
    return inner.unionByName(joined.drop("_chain")).withColumn("length", F.col("end_ix") - F.col("start_ix") + 1)
