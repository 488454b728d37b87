"""Comparisons and lookups between series: full-outer compare, as-of match, intervals, mixing, envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import clamp, is_finite, to_linear
from ..session import cut_lineage
from .ordering import fill_from_neighbours, home_rows, running_total, with_halo
from .quantiles import ranked_value

SILENT = 1e-12


def compare_series(a: DataFrame, b: DataFrame, tolerance: float, keys: Sequence[str] = ("track_id", "ch")) -> DataFrame:
    """Per series: frame counts, largest difference and the first frame that is absent, non-finite or too far off."""
    on = [*keys, "frame_ix"]
    j = a.select(*on, F.col("x").alias("_a")).join(b.select(*on, F.col("x").alias("_b")), on, "full")
    d = F.abs(F.col("_a") - F.col("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    bad = ~both | ~is_finite(F.col("_a")) | ~is_finite(F.col("_b")) | (d > tolerance)
    return j.groupBy(*keys).agg(
        F.count("_a").alias("frames_a"), F.count("_b").alias("frames_b"), F.max(d).alias("max_difference"),
        F.min(F.when(bad, F.col("frame_ix"))).alias("first_bad_frame"))


def repair_validation(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """Peak change in dB and relative residual of a repair, per series."""
    on = ["track_id", "ch", "frame_ix"]
    j = original.select(*on, F.col("x").alias("o")).join(repaired.select(*on, F.col("x").alias("p")), on, "full")
    g = j.groupBy("track_id").agg(
        (F.count_if(F.col("o").isNull() | F.col("p").isNull()) == 0).alias("same_geometry"),
        F.max(F.abs("o")).alias("_po"), F.max(F.abs("p")).alias("_pp"),
        F.sum((F.col("p") - F.col("o")) * (F.col("p") - F.col("o"))).alias("_d"), F.sum(F.col("o") * F.col("o")).alias("_e"))
    return g.select(
        "track_id", "same_geometry",
        F.when((F.col("_po") > 0) & (F.col("_pp") > 0), 20 * F.log10(F.col("_pp") / F.nullif(F.col("_po"), F.lit(0.0))))
        .otherwise(0.0).alias("peak_delta_db"),
        F.when(F.col("_e") > 0, F.sqrt(F.col("_d") / F.nullif(F.col("_e"), F.lit(0.0)))).otherwise(0.0)
        .alias("relative_residual"))


def mix_sources(program: DataFrame, stems: DataFrame, gains: DataFrame, limit: float = 8.0) -> DataFrame:
    """Program plus every stem times (linear gain - 1); one union and one sum instead of a chain of joins."""
    g = gains.select("role", (to_linear(F.col("gain_db")) - 1.0).alias("_g")).filter(F.abs("_g") >= 1e-9)
    # one row per role; left to size estimates, packed stems look small and are the side that is broadcast
    parts = stems.join(F.broadcast(g), "role").select("track_id", "ch", "frame_ix", (F.col("x") * F.col("_g")).alias("x"))
    y = F.sum("x")
    return (
        program.select("track_id", "ch", "frame_ix", "x").unionByName(parts).groupBy("track_id", "ch", "frame_ix")
        .agg(clamp(F.when(is_finite(y), y).otherwise(0.0), -limit, limit).alias("x")))


def nearest_match(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float, bucket: float) -> DataFrame:
    """As-of nearest join on ``t`` (ties go to the later point); rows of ``a`` with no partner in reach are dropped.

    Both sides are laid on one time line and each row of ``a`` reads the closest row of ``b`` before and after
    it: inside a time bucket by window, across buckets from one row per bucket.
    """
    keys = list(keys)
    left = a.select(*keys, "t", F.col("v").alias("_va"), F.lit(None).cast("struct<t:double,v:double>").alias("_b"))
    right = b.select(*keys, "t", F.lit(None).cast("double").alias("_va"), F.struct("t", "v").alias("_b"))
    line = fill_from_neighbours(
        left.unionByName(right), keys, "t", bucket, "_b", "_prev", "_next", tie=[F.col("_b").isNull()])
    after, before = F.col("_next.t") - F.col("t"), F.col("t") - F.col("_prev.t")
    pick = F.when(F.col("_prev").isNull() | (after <= before), F.col("_next")).otherwise(F.col("_prev"))
    return (
        line.filter(F.col("_b").isNull()).withColumn("_m", pick)
        .filter(F.abs(F.col("_m.t") - F.col("t")) <= tolerance)
        .select(*keys, "t", F.col("_va").alias("v"), F.col("_m.t").alias("other_t"), F.col("_m.v").alias("other_v")))


def activity_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 0.5, bucket: float = 64.0,
                     floor_db: float = -60.0, below_max: float = 18.0) -> DataFrame:
    """Share of the smaller source's active points where both are active (``v`` in dB)."""
    keys = list(keys)
    def limit(df, name):
        return df.groupBy(*keys).agg(F.greatest(F.lit(floor_db), F.max("v") - below_max).alias(name))

    m = nearest_match(a, b, keys, tolerance, bucket).join(limit(a, "_la"), keys).join(limit(b, "_lb"), keys)
    on_a, on_b = F.col("v") >= F.col("_la"), F.col("other_v") >= F.col("_lb")
    g = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(on_a).alias("a_active"), F.count_if(on_b).alias("b_active"),
        F.count_if(on_a & on_b).alias("both_active"))
    smaller = F.least("a_active", "b_active")
    return g.withColumn("overlap", F.coalesce(
        clamp(F.try_divide(F.col("both_active").cast("double"), smaller.cast("double")), 0, 1), F.lit(0.0)))


def activity_envelope(samples: DataFrame, hop: int, floor_db: float = -60.0, quantile: float = 0.95) -> DataFrame:
    """Hop rms over all channels, normalised against a nearest-rank reference to 0..1."""
    # one row per hop, used twice: written once instead of reading the samples twice
    hops = cut_lineage(samples.groupBy("track_id", F.floor(F.col("frame_ix") / F.lit(hop)).cast("bigint").alias("hop_ix")).agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")))
    ref = ranked_value(
        hops.filter(F.col("rms") > SILENT), ["track_id"], "rms",
        lambda n: F.floor(F.lit(quantile) * (n - 1) + 0.5), "_ref", width=0.0005)
    db = 20.0 * F.log10(F.greatest(F.col("rms") / F.col("_ref"), F.lit(SILENT)))
    level = F.when(F.col("_ref").isNotNull() & (F.col("rms") > SILENT), clamp((db - floor_db) / -floor_db, 0, 1))
    return hops.join(ref, "track_id", "left").select(
        "track_id", "hop_ix", "rms", F.coalesce(level, F.lit(0.0)).alias("activity"))


def interpolate_activity(frames: DataFrame, envelope: DataFrame, hop: int, block: int = 4096) -> DataFrame:
    """Add the envelope's value at each frame: linear between hops, constant on the last, 0 beyond."""
    rows, w = with_halo(envelope.select("track_id", "hop_ix", "activity"), ["track_id"], "hop_ix", block, after=1)
    steps = home_rows(rows.withColumn("_next", F.coalesce(F.lead("activity").over(w), F.col("activity"))))
    f = frames.withColumn("hop_ix", F.floor(F.col("frame_ix") / F.lit(hop)).cast("bigint"))
    t = (F.col("frame_ix") % hop) / float(hop)
    value = F.col("activity") + (F.col("_next") - F.col("activity")) * t
    return f.join(steps, ["track_id", "hop_ix"], "left").withColumn(
        "activity", F.coalesce(value, F.lit(0.0))).drop("hop_ix", "_next")


def interval_amounts(frames: DataFrame, interventions: DataFrame, rate: float, bucket_s: float = 1.0) -> DataFrame:
    """Sum of intervention amounts at each frame: start <= t < end, no start means always; frames without any get 0.

    Every intervention becomes two changes, its amount where it starts and the opposite where it ends; changes at one frame
    are added up, laid between the frames, and a running total over buckets of ``bucket_s`` seconds gives the amounts. The work
    grows with frames plus interventions, however many of them overlap. An interval that ends at or before its start, or has no
    end, holds no frame.
    """
    rate = float(rate)

    def first_at(t: Column) -> Column:
        # the first frame whose time is not before t; times are compared as the frames have them
        f = F.ceil(t * rate)
        return F.when((f - 1) / rate >= t, f - 1).when(f / rate < t, f + 1).otherwise(f).cast("bigint")

    start, end, amount = F.col("start_s"), F.col("end_s"), F.col("amount").cast("double")
    ends = F.when(start.isNull(), F.array(F.struct(F.lit(-1).cast("bigint").alias("at"), amount.alias("change")))).when(
        end > start, F.array(F.struct(first_at(start).alias("at"), amount.alias("change")), F.struct(first_at(end).alias("at"), (-amount).alias("change"))))
    changes = interventions.select("track_id", F.inline(ends)).groupBy("track_id", F.greatest("at", F.lit(-1)).alias("frame_ix")).agg(
        F.sum("change").alias("_change"))
    line = frames.withColumns({"_change": F.lit(0.0), "_frame": F.lit(True)}).unionByName(
        changes.withColumn("_frame", F.lit(False)), allowMissingColumns=True)
    bucket = F.floor(F.col("frame_ix") / F.lit(max(1, int(bucket_s * rate)))).cast("bigint")
    total = running_total(line, ["track_id"], [bucket], [F.col("frame_ix"), F.col("_frame")], F.col("_change"), "amount")
    return total.filter("_frame").drop("_change", "_frame")


def bind_best(interventions: DataFrame, envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each intervention with its source's most trusted envelope (first on ties), and the unmatched ones."""
    best = envelopes.groupBy("track_id", "source").agg(
        F.max(F.struct("confidence", (-F.col("seq")).alias("n"))).alias("_b")).select(
        "track_id", "source", F.col("_b.confidence").alias("envelope_confidence"), (-F.col("_b.n")).alias("envelope_seq"))
    bound = interventions.join(best, ["track_id", "source"])
    skipped = interventions.join(best, ["track_id", "source"], "left_anti").withColumn(
        "reason", F.lit("no matching envelope"))
    return bound, skipped


def pairwise_interactions(activities: DataFrame) -> DataFrame:
    """Interaction scores of every two sources of a track.

    ``activities`` has one row per (track_id, taxonomy_id), so a track holds at most as many rows as the
    taxonomy has labels and the pairs per track are bounded by that.
    """
    cols = [c for c in activities.columns if c != "track_id"]
    a = activities.select("track_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = activities.select("track_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    p = a.join(b, (a["track_id"] == b["track_id"]) & (a["a_taxonomy_id"] < b["b_taxonomy_id"])).drop(b["track_id"])
    c = F.col
    def low(name):
        return F.least(c(f"a_{name}"), c(f"b_{name}"))

    def high(name):
        return F.greatest(c(f"a_{name}"), c(f"b_{name}"))

    near = F.when(F.abs(c("a_fundamental_hz") - c("b_fundamental_hz")) < 35.0, 1.0).otherwise(0.55)
    ratio = low("low_band_energy") / F.greatest(F.lit(0.001), high("low_band_energy"))
    shorter = F.greatest(F.lit(0.001), low("active_seconds"))
    p = p.select(
        "track_id", c("a_taxonomy_id").alias("first_id"), c("b_taxonomy_id").alias("second_id"),
        clamp(low("confidence"), 0, 1).alias("confidence"),
        clamp(low("overlap_seconds") / shorter, 0, 1).alias("temporal_overlap"),
        clamp(ratio * near, 0, 1).alias("spectral_overlap"),
        clamp(1.0 - low("phase_coherence"), 0, 1).alias("phase_risk"),
        low("transient_strength").alias("_t_low"), high("stereo_width").alias("_w"),
        (c("a_transient_strength") + c("b_transient_strength")).alias("_t_sum"))
    p = p.withColumns({
        "low_band_masking": clamp(c("temporal_overlap") * c("spectral_overlap"), 0, 1),
        "onset_masking": clamp(c("temporal_overlap") * c("_t_low"), 0, 1),
        "mono_survival_risk": clamp(c("phase_risk") * c("_w"), 0, 1)})
    return p.withColumn("limiter_contribution", clamp(c("low_band_masking") * c("_t_sum") * 0.5, 0, 1)).drop(
        "_t_low", "_w", "_t_sum")
