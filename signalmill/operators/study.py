"""Listening studies and corpus manifests: validation, blinding, decoding, rates and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import is_sha256_hex, wilson_bounds

DAMAGE = ("artifact_audible", "transient_damage", "mono_worse", "image_worse", "sections_worse", "tonal_side_effect")
SPLITS = ("train", "validation", "test", "negative")
MANIFEST_FIELDS = (
    "corpus_id", "split", "item_id", "audio_sha256", "labels", "license_provenance", "artist_group", "usage")


def _rate(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def study_metrics(records: DataFrame) -> DataFrame:
    """Totals (``category`` null) and per-category counts in one grouping-sets pass, with 95% intervals."""
    damage = F.lit(False)
    for c in DAMAGE:
        damage = damage | F.col(c)
    on = F.col("guidance_applied")
    good, target = on & F.col("already_good"), on & ~F.col("already_good")
    r = records.select(
        "category", on.alias("applied"), good.alias("good"), target.alias("target"), (on & damage).alias("damaged"),
        (good & damage).alias("good_damaged"), (on & F.col("artifact_audible")).alias("artifact"),
        (target & (F.col("preference") == "guided")).alias("win"),
        (target & (F.col("preference") == "stereo")).alias("loss"))
    flags = [c for c in r.columns if c != "category"]
    g = r.rollup("category").agg(
        F.grouping("category").cast("int").alias("is_total"), F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col(c)).alias(f"{c}_count") for c in flags])
    c = F.col
    pairs = {
        "good_damage": (c("good_damaged_count"), c("good_count")), "artifact": (c("artifact_count"), c("applied_count")),
        "win": (c("win_count"), c("target_count")), "loss": (c("loss_count"), c("target_count"))}
    for name, (k, n) in pairs.items():
        lo, hi = wilson_bounds(k, n)
        g = g.withColumns({f"{name}_rate": _rate(k, n), f"{name}_low": lo, f"{name}_high": hi})
    return g


def policy_gate(metrics: DataFrame, min_good: int, min_target: int, max_good_damage: float, max_artifact: float,
                min_win: float, max_loss: float) -> DataFrame:
    """Six checks and their conjunction; a rate that could not be computed fails."""
    def check(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    checks = {
        "enough_good": check(F.col("good_count") >= min_good),
        "enough_target": check(F.col("target_count") >= min_target),
        "good_damage_ok": check(F.col("good_damage_rate") <= max_good_damage),
        "artifact_ok": check(F.col("artifact_rate") <= max_artifact),
        "win_ok": check(F.col("win_rate") >= min_win),
        "loss_ok": check(F.col("loss_rate") <= max_loss),
    }
    out = metrics.withColumns(checks)
    approved = F.lit(True)
    for name in checks:
        approved = approved & F.col(name)
    return out.withColumn("approved", approved)


def assign_blind(trials: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Key table (which side is guided) and public response sheet; a hash of trial and seed picks the side."""
    a = F.xxhash64("trial_id", F.lit(seed)).bitwiseAND(F.lit(1)) == 1
    key = trials.select(
        "trial_id", F.when(a, "guided").otherwise("stereo").alias("side_a"),
        F.when(a, "stereo").otherwise("guided").alias("side_b"))
    sheet = trials.select("trial_id", F.lit("").alias("category"), F.lit("").alias("preference"))
    return key, sheet


def decode_blind(responses: DataFrame, key: DataFrame) -> DataFrame:
    """Responses with sides resolved and the guided side's ratings; unusable rows carry an ``error``.

    Every response comes back once: a trial that the key holds several times is an error of its responses, as is a missing
    preference.
    """
    counts = responses.groupBy("trial_id").agg(F.count(F.lit(1)).alias("_n"))
    sides = key.groupBy("trial_id").agg(F.min("side_a").alias("side_a"), F.min("side_b").alias("side_b"), F.count(F.lit(1)).alias("_keys"))
    j = responses.join(counts, "trial_id").join(sides, "trial_id", "left")
    pref = F.col("preference")
    error = (
        F.when(F.col("side_a").isNull(), "trial missing from key").when(F.col("_keys") > 1, "trial repeated in key")
        .when(F.col("_n") > 1, "duplicate response").when(pref.isNull() | ~pref.isin("A", "B", "tie"), "invalid preference")
        .when(F.col("side_a") == F.col("side_b"), "key maps both sides alike"))
    guided = F.when(F.col("side_a") == "guided", F.col("a")).otherwise(F.col("b"))
    decoded = F.when(pref == "tie", "tie").when(pref == "A", F.col("side_a")).when(pref == "B", F.col("side_b"))
    return j.select(
        "trial_id", "category", "already_good", F.when(error.isNull(), decoded).alias("decoded"),
        F.when(error.isNull(), guided).alias("guided_rating"), error.alias("error"))


def manifest_errors(rows: DataFrame) -> DataFrame:
    """Per row the list of violated rules (empty when valid). Absent fields are null."""
    missing = F.filter(
        F.array(*[F.when(F.col(f).isNull(), f) for f in MANIFEST_FIELDS]), lambda x: x.isNotNull())
    rules = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))),
        F.when(F.col("split").isNotNull() & ~F.col("split").isin(*SPLITS), "unsupported split"),
        F.when(F.exists("labels", lambda x: F.coalesce(x == "", F.lit(True))), "empty label"),
        F.when(F.col("audio_sha256").isNotNull() & ~is_sha256_hex(F.col("audio_sha256")), "bad digest"),
        F.when((F.trim("license_provenance") == "") | (F.trim("artist_group") == ""), "license and group required"),
    ]
    return rows.withColumn("errors", F.filter(F.array(*rules), lambda x: x.isNotNull()))


def duplicate_identity(rows: DataFrame, *ids: str) -> DataFrame:
    return rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def split_leakage(rows: DataFrame, group: str = "artist_group") -> DataFrame:
    """Groups that appear in test and in train or validation."""
    return (
        rows.groupBy(group)
        .agg(F.bool_or(F.col("split") == "test").alias("_t"), F.bool_or(F.col("split").isin("train", "validation")).alias("_o"))
        .filter("_t and _o").select(group))
