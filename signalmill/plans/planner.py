"""Two candidate plans per measured track, their adjustment, user controls and revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import clamp
from . import graph as g

TARGET_RANGE = {"a": (-12.0, -8.5), "b": (-13.0, -9.5)}


def _c(name: str) -> Column:
    return F.col(name)


def plan_ab(m: DataFrame) -> DataFrame:
    """One row per track and variant (``a`` recommended, ``b`` preserving): target, nodes, rationale.

    Input columns: integrated_lufs, true_peak_dbtp, crest_db, plr_db, short_term_variation, sub, bass, upper_mid,
    high (band ratios), centroid_hz, max_abs_dc, clipped_samples, channels, correlation, low_width, mid_width.
    """
    lufs = F.when((_c("integrated_lufs") > -80) & (_c("integrated_lufs") < 6), _c("integrated_lufs")).otherwise(-14.0)
    m = m.withColumns({
        "_lufs": lufs, "_crest": clamp(_c("crest_db"), 2, 24), "_plr": clamp(_c("plr_db"), 2, 24),
        "_low": _c("sub") + _c("bass")})
    crest, plr, low, now = _c("_crest"), _c("_plr"), _c("_low"), _c("_lufs")
    # the later rule wins
    base = F.when(now >= -9.0, now).when((crest <= 7) | (plr <= 7), -10.8).when((crest >= 12) & (plr >= 10), -9.2).otherwise(-10.0)
    m = m.withColumn("_ta", clamp(base, *TARGET_RANGE["a"]))
    m = m.withColumn("_tb", clamp(F.when(now >= -10.5, now).otherwise(_c("_ta") - 1.5), *TARGET_RANGE["b"]))

    def pre(target, share, offset, lo, hi, most):
        over = F.when(_c("true_peak_dbtp") > 0, F.least(_c("true_peak_dbtp"), F.lit(most))).otherwise(0.0)
        return clamp((target - now) * share - offset, lo, hi) - over

    um, hi, stereo = _c("upper_mid"), _c("high"), _c("channels") == 2
    tone = g.chosen(
        g.BANDS,
        [(_c("max_abs_dc") > 0.003, g.band("high_pass", 18, 0, 0.707))],
        [(low > 0.48, g.band("low_shelf", 105, -1.2, 0.707)), (low < 0.20, g.band("low_shelf", 95, 0.6, 0.707))],
        [(um > 0.23, g.band("peak", 3500, -0.8, 0.9))],
        [((hi > 0.13) & (_c("centroid_hz") > 3200), g.band("high_shelf", 8500, -0.6, 0.707)),
         ((hi < 0.045) & (_c("centroid_hz") < 2200), g.band("high_shelf", 9000, 0.45, 0.707))])
    dense = crest < 8
    width = F.when(_c("correlation") < 0.20, 0.95).when((_c("correlation") > 0.75) & (_c("mid_width") < 0.35), 1.08).otherwise(1.0)
    loud = _c("_ta") > -10.2
    limit = dict(ceiling_db=-1.0)
    a = g.chosen(
        g.NODES,
        g.node("a_pre_gain", "gain", gain_db=pre(_c("_ta"), 0.68, 0.6, -3, 6, 2.0)),
        [(F.size(tone) > 0, g.node("a_tonal_eq", "eq", bands=tone))],
        [(low > 0.42, g.node(
            "a_low_dynamic_eq", "dynamic_eq", frequency_hz=70, q=1, threshold_db=-20, ratio=2, attack_ms=18,
            release_ms=150, max_reduction_db=F.when(low > 0.55, 3.0).otherwise(2.0)))],
        [(um > 0.20, g.node(
            "a_upper_mid_dynamic_eq", "dynamic_eq", frequency_hz=3800, q=1.2, threshold_db=-24, ratio=1.8, attack_ms=8,
            release_ms=90, max_reduction_db=1.8))],
        g.node("a_glue", "compressor", threshold_db=-17, ratio=F.when(dense, 1.25).otherwise(1.55),
               attack_ms=F.when(dense, 35.0).otherwise(24.0), release_ms=120, knee_db=6, makeup_db=0,
               mix=F.when(dense, 0.45).otherwise(0.7)),
        [((_c("short_term_variation") > 5) | (low > 0.52), g.node(
            "a_multiband_control", "multiband", low_crossover_hz=125, high_crossover_hz=5200, low_threshold_db=-19,
            mid_threshold_db=-16, high_threshold_db=-18, low_ratio=1.45, mid_ratio=1.2, high_ratio=1.3, attack_ms=28,
            release_ms=170))],
        [(crest < 9, g.node("a_transient_restore", "transient", attack_db=1.25, sustain_db=-0.15, fast_ms=3,
                            slow_ms=32, mix=0.75))],
        [((_c("clipped_samples") == 0) & (_c("true_peak_dbtp") < 0.5),
          g.node("a_saturation", "saturation", drive_db=2, mix=0.10))],
        [(stereo, g.node("a_stereo", "stereo", width=width,
                         bass_mono_hz=F.when(_c("low_width") > 0.15, 115.0).otherwise(85.0)))],
        g.node("a_clipper", "clipper", threshold_db=F.when(loud, -1.7).otherwise(-1.25),
               softness=F.when(loud, 0.32).otherwise(0.20)),
        g.node("a_limiter", "limiter", release_ms=85, **limit))
    tone_b = g.chosen(g.BANDS, [(low > 0.52, g.band("low_shelf", 100, -0.55, 0.707))],
                      [(um > 0.26, g.band("peak", 3600, -0.4, 0.8))])
    b = g.chosen(
        g.NODES,
        g.node("b_pre_gain", "gain", gain_db=pre(_c("_tb"), 0.48, 0.25, -2, 3.5, 1.5)),
        [(F.size(tone_b) > 0, g.node("b_tonal_eq", "eq", bands=tone_b))],
        g.node("b_glue", "compressor", threshold_db=-14, ratio=1.22, attack_ms=40, release_ms=180, knee_db=8, makeup_db=0,
               mix=0.42),
        [(stereo & (_c("low_width") > 0.22), g.node("b_low_end_stereo_safety", "stereo", width=1, bass_mono_hz=100))],
        [((_c("clipped_samples") == 0) & (crest > 8), g.node("b_light_saturation", "saturation", drive_db=1, mix=0.04))],
        g.node("b_limiter", "limiter", release_ms=120, **limit))
    why = g.chosen(
        "array<string>",
        [(_c("max_abs_dc") > 0.003, F.lit("dc"))], [(low > 0.48, F.lit("heavy lows")), (low < 0.20, F.lit("thin lows"))],
        [(um > 0.23, F.lit("dense upper mids"))], [(low > 0.42, F.lit("reactive lows"))], [(crest < 9, F.lit("restore attacks"))])
    both = F.array(
        F.struct(F.lit("a").alias("variant"), _c("_ta").alias("target"), a.cast(g.NODES).alias("nodes"), why.alias("why")),
        F.struct(F.lit("b").alias("variant"), _c("_tb").alias("target"), b.cast(g.NODES).alias("nodes"),
                 F.array(F.lit("lighter intervention")).alias("why")))
    kept = [c for c in m.columns if not c.startswith("_")]
    return m.withColumn("_p", F.explode(both)).select(
        *kept, F.col("_p.variant").alias("variant"), F.col("_p.target").alias("target_lufs"),
        F.lit(-1.0).alias("ceiling_dbtp"), F.col("_p.nodes").alias("nodes"), F.col("_p.why").alias("rationale"))


def adjust_plan(p: DataFrame) -> DataFrame:
    """Back off, bypass or add nodes from deeper findings.

    Extra columns: defect_risk, hard_clip, intentional, harshness, resonance_hz and resonance_severity (the track's
    first strong resonance in 2.5..6.5 kHz, null if none), sub_buildup, section_contrast_db, negative_fraction, health.
    """
    is_a, risky = _c("variant") == "a", _c("defect_risk") >= 0.55
    shaped = ~risky & (_c("intentional") >= 0.60)
    t, low = _c("target_lufs"), F.when(is_a, -12.0).otherwise(-13.0)
    t = F.when(risky, F.greatest(low, t - F.when(is_a, 0.8).otherwise(0.5))).otherwise(t)
    t = F.when(_c("section_contrast_db") >= 8, F.greatest(low, t - F.when(is_a, 0.4).otherwise(0.25))).otherwise(t)
    healthy = (_c("health") >= 86) & (_c("defect_risk") < 0.25)
    t = F.when(is_a & healthy, F.least(t, F.lit(-9.8))).otherwise(t)
    t = F.when(is_a, clamp(t, *TARGET_RANGE["a"])).otherwise(clamp(t, *TARGET_RANGE["b"]))

    n = _c("nodes")
    n = g.set_bypass(n, "a_saturation", risky | shaped)
    n = g.set_bypass(n, "b_light_saturation", risky | shaped)
    n = g.set_bypass(n, "a_clipper", risky & (_c("hard_clip") >= 0.72))
    harsh = _c("harshness") >= 0.58
    strong = _c("resonance_severity") > _c("harshness") * 0.55
    hz = F.when(strong, _c("resonance_hz")).otherwise(3800.0)
    sev = F.when(strong, F.greatest("harshness", "resonance_severity")).otherwise(_c("harshness"))
    extra = [
        F.when(is_a & harsh, g.node("a_phase3_harshness_control", "dynamic_eq", frequency_hz=hz, q=1.35, threshold_db=-25,
                                    ratio=1.9, attack_ms=6, release_ms=85, max_reduction_db=1.2 + sev * 1.6)),
        F.when(~is_a & harsh & (sev >= 0.82), g.node(
            "b_phase3_harshness_safety", "dynamic_eq", frequency_hz=hz, q=1.15, threshold_db=-23, ratio=1.45,
            attack_ms=10, release_ms=110, max_reduction_db=0.9)),
        F.when(is_a & (_c("sub_buildup") >= 0.65) & ~g.contains(_c("nodes"), "a_low_dynamic_eq"), g.node(
            "a_phase3_sub_control", "dynamic_eq", frequency_hz=62, q=0.9, threshold_db=-20, ratio=2, attack_ms=22,
            release_ms=170, max_reduction_db=2.2)),
    ]
    phase = (_c("channels") == 2) & ((_c("correlation") < 0.05) | (_c("negative_fraction") > 0.18))
    extra += [
        F.when(is_a & phase, g.node("a_phase3_phase_safety", "stereo", width=0.92, bass_mono_hz=120)),
        F.when(~is_a & phase, g.node("b_phase3_phase_safety", "stereo", width=0.96, bass_mono_hz=110)),
        F.when(is_a & ((_c("crest_db") < 6.5) | (_c("plr_db") < 6)) & ~g.contains(_c("nodes"), "a_transient_restore"),
               g.node("a_phase3_transient_restore", "transient", attack_db=0.9, sustain_db=-0.1, fast_ms=3, slow_ms=34,
                      mix=0.60)),
    ]
    n = F.concat(n, g.nodes(*extra).cast(g.NODES))
    n = g.set_bypass(n, "a_multiband_control", healthy)
    n = g.set_bypass(n, "a_saturation", healthy)
    return p.withColumns({"target_lufs": t, "nodes": n})


def apply_controls(p: DataFrame) -> DataFrame:
    """User controls (columns style_*: target_lufs, bass_db, presence_db, width, punch, warmth) placed before the
    dynamics and peak stages; variant b takes 65% of each move and a target 1.5 LU lower."""
    is_a = _c("variant") == "a"
    s = F.when(is_a, 1.0).otherwise(0.65)
    target = clamp(_c("style_target_lufs"), -14, -8)
    bass, pres = clamp(_c("style_bass_db"), -3, 3), clamp(_c("style_presence_db"), -3, 3)
    width, punch = clamp(_c("style_width"), 0.80, 1.20), clamp(_c("style_punch"), 0, 1)
    warm = clamp(_c("style_warmth"), 0, 1)
    tone = g.chosen(g.BANDS, [(F.abs(bass) >= 0.05, g.band("low_shelf", 105, bass * s, 0.707))],
                    [(F.abs(pres) >= 0.05, g.band("peak", 4200, pres * s, 0.85))])
    attack = (punch - 0.5) * 3.0 * s
    def name(suffix):
        return F.concat(_c("variant"), F.lit(suffix))

    out = g.insert_all(
        _c("nodes"),
        (name("_glue"), [(F.size(tone) > 0, g.node(name("_user_tone"), "eq", bands=tone))]),
        (F.when(is_a, "a_clipper").otherwise("b_limiter"),
         [(F.abs(attack) >= 0.08, g.node(name("_user_punch"), "transient", attack_db=attack, sustain_db=-attack * 0.12,
                                         fast_ms=3, slow_ms=34, mix=0.72))],
         [(F.abs(width - 1) >= 0.005, g.node(name("_user_width"), "stereo", width=1.0 + (width - 1.0) * s, bass_mono_hz=105))],
         [(warm >= 0.01, g.node(name("_user_warmth"), "saturation", drive_db=0.8 + warm * 2.8, mix=warm * 0.12 * s))]))
    return p.withColumns({
        "target_lufs": F.when(is_a, target).otherwise(clamp(target - 1.5, -14, -9.5)), "nodes": out})


def apply_revision(p: DataFrame) -> DataFrame:
    """Edit plans by parsed requests (columns ``actions``, ``constraints``, ``violations``).

    A violated constraint leaves the plan as it was. Each action edits the nodes of its type; loudness moves the
    target; warmth has no edit. ``changes`` lists what was done.
    """
    def act(name: str) -> Column:
        return F.filter("actions", lambda a: a["action"] == name)

    def on(name: str) -> Column:
        return F.size(act(name)) > 0

    def first(name: str, field: str) -> Column:
        return F.get(act(name), F.lit(0))[field]

    ok = F.size("violations") == 0
    delta = first("adjust_bass_level", "delta_db")

    def edit_band(b: Column) -> Column:
        hz, v = b["frequency_hz"], b["gain_db"]
        v = F.when(on("adjust_bass_level") & (hz <= 150), clamp(v + delta, -6, 6)).otherwise(v)
        v = F.when(on("reduce_harshness") & hz.between(3000, 8000), clamp(v - 1.2, -6, 4)).otherwise(v)
        v = F.when(on("increase_brightness") & (hz >= 10000), clamp(v + 1.2, -6, 5)).otherwise(v)
        v = F.when(on("reduce_mud") & hz.between(200, 400), clamp(v - 1.5, -6, 4)).otherwise(v)
        return b.withField("gain_db", v)

    n = g.update_bands(_c("nodes"), edit_band)
    n = g.update_params(n, "transient", {"attack_db": lambda v: F.when(on("increase_punch"), clamp(v + 1.5, -4, 6))
                                         .when(on("reduce_punch"), clamp(v - 1.0, -4, 6)).otherwise(v)})
    side = F.when(first("adjust_stereo_width", "amount") > 0, 0.15).otherwise(-0.15)
    n = g.update_params(n, "stereo", {
        "width": lambda v: F.when(on("adjust_stereo_width"), clamp(v + side, 0.5, 1.6)).otherwise(v)})
    n = g.update_params(n, "saturation", {
        "drive_db": lambda v: F.when(on("adjust_saturation"), clamp(v + 2.0, 0, 8)).otherwise(v),
        "mix": lambda v: F.when(on("adjust_saturation"), clamp(v + 0.15, 0, 0.6)).otherwise(v)})
    loud = first("adjust_loudness", "delta_db")
    target = F.when(on("adjust_loudness"), clamp(_c("target_lufs") + loud, -16, -6)).otherwise(_c("target_lufs"))

    def has(kind: str) -> Column:
        return F.exists("nodes", lambda x: x["type"] == kind)

    changes = g.nodes(
        F.when(on("adjust_bass_level") & has("eq"), F.format_string("low eq %.1f dB", delta)),
        F.when(on("reduce_harshness") & has("eq"), "harshness -1.2 dB"),
        F.when(on("increase_brightness") & has("eq"), "air +1.2 dB"), F.when(on("reduce_mud") & has("eq"), "mud -1.5 dB"),
        F.when(on("increase_punch") & has("transient"), "attack +1.5 dB"),
        F.when(on("reduce_punch") & has("transient"), "attack -1.0 dB"),
        F.when(on("adjust_stereo_width") & has("stereo"), "width"), F.when(on("adjust_saturation") & has("saturation"), "drive"),
        F.when(on("adjust_loudness"), "target"))
    return p.withColumns({
        "nodes": F.when(ok, n).otherwise(_c("nodes")), "target_lufs": F.when(ok, target).otherwise(_c("target_lufs")),
        "changes": F.when(ok, changes).otherwise(F.array().cast("array<string>")), "accepted": ok})
