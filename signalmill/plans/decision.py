"""Diagnosis, candidate plans, scores and finalists per track; mode choice and bounded repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import clamp, risk_from_ratio
from .dimensions import CANDIDATES, STRENGTHS, expand


def kept(*items: Column) -> Column:
    """Array of the non-null items in order: the shape of every rule list here."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def diagnose(e: DataFrame) -> DataFrame:
    wide = F.col("stereo_correlation") < 0.7
    lufs = F.col("integrated_lufs")
    issues = kept(
        F.when(wide, "wide low end"), F.when(F.col("kick_bass_masking"), "kick and bass overlap"),
        F.when(F.col("harsh"), "harsh highs"))
    strengths = kept(F.when(~wide, "stable centre"), F.when(~F.col("kick_bass_masking"), "clean low end"))
    return e.withColumns({
        "headroom_db": F.greatest(F.lit(0.0), -1.0 - F.col("true_peak_dbtp")),
        "tendency": F.when(lufs > -10, "loud_competitive").when(lufs < -16, "dynamic_acoustic")
        .otherwise("modern_streaming"),
        "stereo_stability": F.when(wide, 0.6).otherwise(1.0),
        "low_end_cleanliness": F.when(F.col("kick_bass_masking"), 0.65).otherwise(1.0),
        "high_smoothness": F.when(F.col("harsh"), 0.70).otherwise(1.0),
        "issues": issues, "strengths": strengths})


def explain_diagnosis(d: DataFrame) -> Column:
    return F.concat_ws(
        "; ", F.col("tendency"), F.format_string("headroom %.1f dB", "headroom_db"),
        F.when(F.size("issues") > 0, F.concat(F.lit("issues: "), F.array_join("issues", ", "))),
        F.when(F.size("strengths") > 0, F.concat(F.lit("good: "), F.array_join("strengths", ", "))))


def generate_candidates(e: DataFrame, target: float = -11.0, ceiling: float = -1.0) -> DataFrame:
    """Three candidates per track, as a projection over the fixed candidate rows."""
    c = expand(e, CANDIDATES, ["candidate", "branch", "target_offset", "preservation"])
    return c.withColumns({"target_lufs": F.col("target_offset") + target, "ceiling_dbtp": F.lit(ceiling)})


def score_candidates(c: DataFrame, target: float = -11.0) -> DataFrame:
    keep = F.col("preservation")
    c = c.withColumns({
        "tonal_balance": F.lit(0.85) - F.when((F.col("centroid_hz") > 4000) & (keep < 0.5), 0.10).otherwise(0.0),
        "low_end_stability": F.lit(0.90) - F.when(F.col("kick_bass_masking") & (keep < 0.4), 0.15).otherwise(0.0),
        "punch": F.when(keep > 0.6, 0.92).otherwise(0.82),
        "density": F.lit(0.85),
        "artifact_risk": F.lit(0.05) + F.when(F.col("target_lufs") > target + 2.0, 0.20).otherwise(0.0),
        "stereo_integrity": F.col("stereo_correlation")})
    return c.withColumn(
        "score", 0.25 * F.col("tonal_balance") + 0.25 * F.col("low_end_stability") + 0.20 * F.col("punch")
        + 0.20 * F.col("density") + 0.10 * (1.0 - F.col("artifact_risk")))


def select_finalists(scored: DataFrame, key: str = "track_id") -> DataFrame:
    """Best and runner-up by score (candidate name on ties); a single candidate fills both places."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "candidate")
    top = scored.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    def pick(col, n):
        return F.max(F.when(F.col("_n") == n, F.col(col)))

    return top.groupBy(key).agg(
        pick("candidate", 1).alias("master_a"), pick("score", 1).alias("score_a"),
        F.coalesce(pick("candidate", 2), pick("candidate", 1)).alias("master_b"),
        F.coalesce(pick("score", 2), pick("score", 1)).alias("score_b"))


def reference_influence(pairs: DataFrame) -> DataFrame:
    """Bounded moves of a source towards a reference at three strengths (columns ``ref_*`` and ``src_*``)."""
    p = expand(pairs, STRENGTHS, ["strength", "weight", "limit"])
    def move(name):
        return clamp((F.col(f"ref_{name}") - F.col(f"src_{name}")) * F.col("weight"), -F.col("limit"), F.col("limit"))

    return p.withColumns({
        "target_lufs": F.col("src_lufs") + move("lufs"), "low_shelf_db": move("bass_db"),
        "high_shelf_db": move("presence_db"), "pre_gain_db": move("lufs") * 0.7})


def artifact_risk(m: DataFrame) -> DataFrame:
    """Seven damage measures to one risk: the weighted sum or the worst one, plus doubt about the model."""
    # fixed values
    weights = {"leakage": 0.17, "musical_noise": 0.15, "transient_damage": 0.20, "phase_change": 0.12,
               "hf_smearing": 0.12, "source_residue": 0.12, "residual": 0.12}
    unit = {k: clamp(F.col(k), 0, 1) for k in [*weights, "model_confidence", "measurement_confidence"]}
    weighted = sum((w * unit[k] for k, w in weights.items()), F.lit(0.0))
    worst = F.greatest(*[unit[k] for k in weights])
    evidence = kept(
        *[F.when(unit[k] >= 0.35, k) for k in weights],
        F.when(unit["model_confidence"] < 0.65, "limited model confidence"),
        F.when(unit["measurement_confidence"] < 0.65, "limited measurement confidence"))
    return m.withColumns({
        "overall_risk": clamp(F.greatest(weighted, worst * 0.78) + (1.0 - unit["model_confidence"]) * 0.12, 0, 1),
        "risk_confidence": F.sqrt(unit["model_confidence"] * unit["measurement_confidence"]),
        "evidence": evidence})


def reconstruction_risk(m: DataFrame) -> DataFrame:
    """Risk of a reconstruction from its measured differences, plus doubt about measurement and model."""
    res = risk_from_ratio(F.col("residual_ratio"), 4.0)
    phase = clamp((1.0 - clamp(F.col("correlation"), -1, 1)) * 0.5, 0, 1)
    measured = (
        0.46 * res + 0.20 * phase + 0.22 * risk_from_ratio(F.col("transient_ratio"), 2.5)
        + 0.12 * risk_from_ratio(F.col("hf_ratio"), 2.0))
    conf, model = clamp(F.col("confidence"), 0, 1), clamp(F.col("model_confidence"), 0, 1)
    doubt = (1.0 - conf) * 0.10 + (1.0 - model) * 0.10 + 0.03
    return m.withColumns({
        "overall_risk": clamp(F.greatest(measured, res * 0.72) + doubt, 0, 1),
        "risk_confidence": clamp(F.sqrt(model * conf) * 0.90, 0, 1)})


def choose_mode(e: DataFrame) -> DataFrame:
    """Three-way processing mode from issue evidence and artifact risk, with confidence and first reason."""
    c = {k: clamp(F.col(k), 0, 1) for k in (
        "benefit", "overall_risk", "model_confidence", "guidance_confidence", "guided_sufficiency")}
    rc, full = F.col("risk_confidence"), F.col("reconstruction_required")
    quality = (
        (c["model_confidence"] >= 0.80) & (rc >= 0.55) & (c["overall_risk"] <= 0.25)
        & (c["benefit"] - c["overall_risk"] >= 0.20))
    guided = (c["guidance_confidence"] >= 0.55) & (c["guided_sufficiency"] >= 0.45)
    ladder = [
        (~F.col("source_specific_issue"), "stereo_mastering", F.lit(1.0), "no source-specific issue"),
        (c["benefit"] < 0.18, "stereo_mastering", 1.0 - c["benefit"], "benefit too small"),
        (full & quality, "stem_reconstruction", F.least(c["model_confidence"], rc), "reconstruction gates passed"),
        (guided, "source_guided_stereo", F.least(c["guidance_confidence"], F.greatest(c["guided_sufficiency"], rc)),
         "estimates guide the mix"),
    ]
    last = ("stereo_mastering", F.greatest(F.lit(0.25), 1.0 - c["guidance_confidence"]), "guidance too weak")
    mode = conf = reason = None
    for cond, m, cf, why in ladder:
        mode = F.when(cond, m) if mode is None else mode.when(cond, m)
        conf = F.when(cond, cf) if conf is None else conf.when(cond, cf)
        reason = F.when(cond, why) if reason is None else reason.when(cond, why)
    return e.withColumns({
        "mode": mode.otherwise(last[0]), "mode_confidence": conf.otherwise(last[1]), "reason": reason.otherwise(last[2])})


def plan_bounded_repairs(pairs: DataFrame) -> DataFrame:
    """Capped repairs for pair scores of sufficient confidence, one row per proposed action."""
    def item(cond, action, amount):
        return F.when(cond, F.struct(F.lit(action).alias("action"), amount.alias("amount")))

    m, o, s = F.col("low_band_masking"), F.col("onset_masking"), F.col("mono_survival_risk")
    items = kept(
        item(m > 0.42, "dynamic_low_band_attenuation", F.least(F.lit(2.0), m * 3.0)),
        item(o > 0.50, "transient_sidechain_control", F.least(F.lit(0.35), o * 0.4)),
        item(s > 0.32, "low_band_mono_stabilization", F.least(F.lit(0.30), s * 0.5)))
    return pairs.filter(F.col("confidence") >= 0.70).withColumn("_r", F.explode(items)).select(
        "track_id", "first_id", "second_id", "_r.action", "_r.amount")


DAMAGE_GUARD = {
    "true_peak": "abs(true_peak_delta) > 0.20",
    "loudness": "abs(loudness_delta) > 0.30",
    "transient": "transient_loss > 0.10",
    "spectral": "spectral_side_effect > 0.15",
    "stereo": "mono_delta > 0.10 or width_delta > 0.12",
}


def rule_gate(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Add ``blockers`` (names of violated rules, SQL conditions) and ``safe``."""
    blockers = kept(*[F.when(F.expr(cond), name) for name, cond in rules.items()])
    return rows.withColumn("blockers", blockers).withColumn("safe", F.size("blockers") == 0)


def match_gains(tracks: DataFrame, key: str, lufs: str = "lufs") -> DataFrame:
    """Attenuation that brings every candidate of ``key`` to the quietest one; unusable levels count as -80."""
    v = F.col(lufs)
    level = F.when(F.isnan(v) | (F.abs(v) == float("inf")) | (v <= -80.0) | v.isNull(), -80.0).otherwise(v)
    t = tracks.withColumn("_l", level)
    low = t.groupBy(key).agg(F.min("_l").alias("_min"))
    return t.join(low, key).withColumn("gain_db", F.col("_min") - F.col("_l")).drop("_l", "_min")
