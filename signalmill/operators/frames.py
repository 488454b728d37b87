"""Shapes of sample tables: stereo frames, long samples, interleaved vectors, blocks and chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import home_rows, with_halo


def to_long(frames: DataFrame, channels: Sequence[str] = ("l", "r"), key: str = "track_id") -> DataFrame:
    """Wide frames to ``track_id, ch, frame_ix, x``."""
    return frames.select(
        key, "frame_ix", F.posexplode(F.array(*[F.col(c) for c in channels])).alias("ch", "x")
    ).select(key, "ch", "frame_ix", "x")


def interleave(frames: DataFrame, block: int, channels: Sequence[str] = ("l", "r")) -> DataFrame:
    """Frame-major sample arrays, one per block: ``track_id, block_ix, samples``."""
    row = F.struct("frame_ix", F.array(*[F.col(c) for c in channels]).alias("s"))
    return (
        frames.groupBy("track_id", F.floor(F.col("frame_ix") / F.lit(block)).cast("bigint").alias("block_ix"))
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
        .select("track_id", "block_ix", F.flatten(F.transform("rows", lambda s: s["s"])).alias("samples"))
    )


def deinterleave(blocks: DataFrame, block: int, channels: int = 2) -> DataFrame:
    """Inverse of :func:`interleave` as long samples."""
    return blocks.select("track_id", "block_ix", F.posexplode("samples").alias("pos", "x")).select(
        "track_id",
        (F.col("pos") % channels).alias("ch"),
        (F.col("block_ix") * block + F.floor(F.col("pos") / channels)).cast("bigint").alias("frame_ix"),
        "x",
    )


def scan_blocks(blocks: DataFrame, first: int, last: int, track=None) -> DataFrame:
    """Range read: the predicates reach the Parquet scan (row groups are skipped by ``block_ix``)."""
    df = blocks.filter(F.col("block_ix").between(first, last))
    return df if track is None else df.filter(F.col("track_id") == track)


def downmix(*channels: Column) -> Column:
    total = channels[0]
    for c in channels[1:]:
        total = total + c
    return total / float(len(channels))


def mid_side(l: Column, r: Column, scale: float) -> tuple[Column, Column]:
    return (l + r) * scale, (l - r) * scale


def differences(samples: DataFrame, keys: Sequence[str], block: int, value: str = "x") -> DataFrame:
    """First and second differences per series (``d1``, ``d2``; null where undefined)."""
    rows, w = with_halo(samples, keys, "frame_ix", block, before=2)
    p1, p2 = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return home_rows(rows.withColumns({"d1": F.col(value) - p1, "d2": F.col(value) - 2 * p1 + p2}))


def block_halos(blocks: DataFrame, keys: Sequence[str], before: int, after: int, value: str = "x") -> DataFrame:
    """Add ``head`` (last ``before`` samples of the previous block) and ``tail`` (first ``after`` of the next).

    Only the slices travel: edges are shifted by one block and joined back, blocks are not sorted per series.
    """
    keys = list(keys)
    n = F.size(value)
    edges = blocks.select(
        *keys,
        F.explode(F.array(
            F.struct((F.col("block_ix") + 1).alias("block_ix"),
                     F.slice(value, F.greatest(n - before + 1, F.lit(1)), F.least(n, F.lit(before))).alias("head"),
                     F.lit(None).cast("array<double>").alias("tail")),
            F.struct((F.col("block_ix") - 1).alias("block_ix"), F.lit(None).cast("array<double>").alias("head"),
                     F.slice(value, 1, after).alias("tail")),
        )).alias("e"),
    ).select(*keys, "e.*")
    merged = edges.groupBy(*keys, "block_ix").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    empty = F.array().cast("array<double>")
    return blocks.join(merged, [*keys, "block_ix"], "left").withColumns(
        {"head": F.coalesce("head", empty), "tail": F.coalesce("tail", empty)}
    )


def cut_chunks(samples: DataFrame, chunk: int, overlap: int, keys: Sequence[str] = ("track_id", "ch")) -> DataFrame:
    """Overlapping chunks in long form: ``keys, chunk_ix, pos, x`` (stride ``chunk - overlap``)."""
    stride = chunk - overlap
    own = F.floor(F.col("frame_ix") / F.lit(stride)).cast("bigint")
    first = F.greatest(F.floor((F.col("frame_ix") - (chunk - 1) + (stride - 1)) / F.lit(stride)).cast("bigint"), F.lit(0))
    return samples.withColumn("chunk_ix", F.explode(F.sequence(F.least(first, own), own))).select(
        *keys, "chunk_ix", (F.col("frame_ix") - F.col("chunk_ix") * stride).alias("pos"), "x"
    )


def overlap_add(
    chunks: DataFrame, chunk: int, overlap: int, keys: Sequence[str] = ("track_id", "ch"), value: str = "x"
) -> DataFrame:
    """Stitch processed chunks: linear cross-fade between a chunk's head and its predecessor's tail."""
    if not 0 <= overlap < chunk / 2:
        raise ValueError("overlap must be shorter than half a chunk")
    stride = chunk - overlap
    t = F.col("pos") / F.lit(float(max(overlap - 1, 1)))
    rise = F.when((F.col("chunk_ix") > 0) & (F.col("pos") < overlap), t).otherwise(1.0)
    tail_t = (F.col("pos") - stride) / F.lit(float(max(overlap - 1, 1)))
    fall = F.when((F.col("pos") >= stride) & ~F.col("_last"), 1.0 - tail_t).otherwise(1.0)
    last = chunks.groupBy(*keys).agg(F.max("chunk_ix").alias("_last_ix"))
    weighted = chunks.join(last, list(keys)).withColumn("_last", F.col("chunk_ix") == F.col("_last_ix"))
    return (
        weighted.select(
            *keys, (F.col("chunk_ix") * stride + F.col("pos")).alias("frame_ix"), (F.col(value) * rise * fall).alias("_y")
        )
        .groupBy(*keys, "frame_ix")
        .agg(F.sum("_y").alias(value))
    )


def map_chunks(
    samples: DataFrame, chunk: int, overlap: int, fn: Callable[[np.ndarray], np.ndarray], keys: Sequence[str] = ("track_id", "ch")
) -> DataFrame:
    """Run a function (for example a model) over overlapping chunks and stitch the results by cross-fade.

    ``fn`` gets and returns one array of equal length; chunks of all series are spread over the tasks. Samples are packed once,
    into the part of a chunk that is its own; only what overlaps travels between chunks. Series without a key are left out.
    """
    if not 0 <= overlap < chunk / 2:
        raise ValueError("overlap must be shorter than half a chunk")
    keys, stride = list(keys), chunk - overlap
    fade = np.arange(overlap) / float(max(overlap - 1, 1))

    @F.pandas_udf("struct<own:array<double>,tail:array<double>>")
    def run(ix: pd.Series, x: pd.Series) -> pd.DataFrame:
        own, tail = [], []
        for k, v in zip(ix, x):
            y = np.array(fn(np.asarray(v, float)), float)
            if k > 0:
                y[:overlap] *= fade[: len(y)]
            y[stride:] *= 1.0 - fade[: max(0, len(y) - stride)]
            own.append(y[:stride])
            tail.append(y[stride:])
        return pd.DataFrame({"own": own, "tail": tail})

    at = F.floor(F.col("frame_ix") / F.lit(stride)).cast("bigint").alias("chunk_ix")
    pos = (F.col("frame_ix") - F.floor(F.col("frame_ix") / F.lit(stride)).cast("bigint") * stride).alias("pos")
    known = samples.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    packed = known.groupBy(*keys, at).agg(F.sort_array(F.collect_list(F.struct(pos, "x"))).alias("_r"))
    on = [*keys, "chunk_ix"]
    # a chunk ends with what the next one begins with; the last chunk has no such end, so it is not faded out
    ends = packed.select(*keys, (F.col("chunk_ix") - 1).alias("chunk_ix"), F.filter("_r", lambda s: s["pos"] < overlap)["x"].alias("_end"))
    whole = packed.select(*on, F.col("_r")["x"].alias("_x")).join(ends.filter((F.col("chunk_ix") >= 0) & (F.size("_end") > 0)), on, "full")
    none = F.array().cast("array<double>")
    x = F.concat(F.coalesce(F.col("_x").cast("array<double>"), none), F.coalesce(F.col("_end").cast("array<double>"), none))
    # the function runs once for each chunk
    done = cut_lineage(whole.select(*on, run("chunk_ix", x).alias("_y")).select(*on, "_y.own", "_y.tail"))
    tails = done.filter(F.size("tail") > 0).select(*keys, (F.col("chunk_ix") + 1).alias("chunk_ix"), F.col("tail").alias("_before"))
    y = F.when(F.col("_before").isNull(), F.col("own")).otherwise(F.zip_with("own", "_before", lambda a, b: a + F.coalesce(b, F.lit(0.0))))
    return done.join(tails, on, "left").select(*on, F.posexplode(y).alias("pos", "x")).select(
        *keys, (F.col("chunk_ix") * stride + F.col("pos")).alias("frame_ix"), "x")
