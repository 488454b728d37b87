"""Rule, plan and decision queries over one row of measurements per track.

The measurements are derived from every order (key and price) over the ranges in which the rules act.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import decision as de
from ..plans import dimensions as di
from ..plans import graph as g
from ..plans import issues as iss
from ..plans import planner as pl
from ..plans import revisions as rv
from ..sources import reports as rep
from ..sources.adapters import table
from . import query
from .common import MET, PRIMES, rd
from .measure import rounded

class _Uniform:
    """``U[i]`` is the column ``u<i>``; made on use, since columns need a session."""

    def __getitem__(self, i: int):
        return F.col(f"u{i}")


U = _Uniform()


def met(spark, sf):
    # three numbers of an order become a plan of some kilobytes: dealt out by key, however few row groups the table has
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").repartition("o_orderkey")
    base = F.floor("o_totalprice").cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("track_id"), "o_custkey",
        *[(((F.col("o_orderkey") * p + base) % 1009) / 1009.0).alias(f"u{i + 1}") for i, p in enumerate(PRIMES)])


# expressions over the u values, valid in both engines
FIELDS = {
    "integrated_lufs": "u1 * 20 - 26", "true_peak_dbtp": "u2 * 5 - 3.5",
    "crest_db": "u3 * 14 + 3", "plr_db": "u4 * 14 + 2.5",
    "short_term_variation": "u5 * 14", "sub": "u6 * 0.4", "bass": "u7 * 0.4",
    "upper_mid": "u8 * 0.35", "high": "u9 * 0.2", "centroid_hz": "u10 * 5000",
    "max_abs_dc": "u11 * u11 * 0.02", "correlation": "u12 * 1.4 - 0.4",
    "low_width": "u13 * 0.4", "mid_width": "u14 * 0.7",
    "defect_risk": "u3 * u6", "hard_clip": "u4 * 0.95", "intentional": "u7",
    "harshness": "u8", "mud": "u9", "sub_buildup": "u10",
    "section_contrast_db": "u11 * 14", "negative_fraction": "u14 * 0.4",
    "macro_range_db": "u1 * 22", "mono_fold_delta_db": "u2 * 6 - 6",
    "transient_fraction": "u4 * 0.05", "onset_density": "u5",
    "tempo_confidence": "u6", "bpm": "u7 * 120 + 60",
    "character_confidence": "u12 * 0.8 + 0.2", "tonal_imbalance": "u13", "health": "u9 * 60 + 40",
}
COUNTS = {
    "channels": "CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 2 END",
    "clipped_samples": "CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE 0 END",
    "nan_samples": "CASE WHEN o_custkey % 37 = 0 THEN 2 ELSE 0 END",
    "infinite_samples": "CASE WHEN o_custkey % 41 = 0 THEN 1 ELSE 0 END",
    "section_count": "o_custkey % 12",
}
REPORT = MET + ",\nm AS (SELECT track_id, o_custkey, " + ", ".join(
    f"{sql} AS {n}" for n, sql in {**FIELDS, **COUNTS}.items()) + ",\n  u1, u2, u3, u4, u5, u6 FROM met0)"


def report(spark, sf):
    return met(spark, sf).select("track_id", "o_custkey", *[F.expr(sql).alias(n) for n, sql in {**FIELDS, **COUNTS}.items()],
                                 *[f"u{i}" for i in range(1, 7)])


# --- health and findings -------------------------------------------------------------------------
HEALTH = f"""{REPORT},
hp AS (SELECT *, least(greatest(100 - tonal_imbalance * 48 - coalesce(top, 0) * 18, 0), 100) AS tonal_balance,
  least(greatest(100 - (CASE WHEN macro_range_db < 3 THEN (3 - macro_range_db) * 8 ELSE 0 END
    + CASE WHEN macro_range_db > 18 THEN (macro_range_db - 18) * 2 ELSE 0 END + CASE WHEN plr_db < 6 THEN (6 - plr_db) * 7 ELSE 0 END
    + CASE WHEN short_term_variation > 9 THEN (short_term_variation - 9) * 2.5 ELSE 0 END), 0), 100) AS dynamics,
  least(greatest(100 - CASE WHEN crest_db < 6 THEN (6 - crest_db) * 8 ELSE 0 END
    - CASE WHEN transient_fraction < 0.01 AND onset_density < 0.15 THEN 8 ELSE 0 END, 0), 100) AS transients,
  CASE WHEN channels < 2 THEN 100.0 ELSE least(greatest(100 - CASE WHEN correlation < 0 THEN 35 WHEN correlation < 0.2 THEN 16 ELSE 0 END
    - negative_fraction * 35 - CASE WHEN low_width > 0.25 THEN 15 ELSE 0 END
    - CASE WHEN mono_fold_delta_db < -3 THEN least(30, abs(mono_fold_delta_db + 3) * 5) ELSE 0 END, 0), 100) END AS stereo_translation,
  least(greatest(100 - CASE WHEN nan_samples + infinite_samples > 0 THEN 80 ELSE 0 END - least(max_abs_dc / 0.02, 1) * 25
    - defect_risk * 45 - CASE WHEN true_peak_dbtp > 1 THEN least(20, true_peak_dbtp * 6) ELSE 0 END, 0), 100) AS technical_integrity
  FROM (SELECT *, CASE WHEN u5 > 0.3 THEN u5 END AS top FROM m)),
h2 AS (SELECT *, tonal_balance * 0.25 + dynamics * 0.22 + transients * 0.16 + stereo_translation * 0.17 + technical_integrity * 0.2 AS total,
  0.78 * 0.25 + 0.86 * 0.22 + least(greatest(0.45 + section_count * 0.05, 0.45), 0.9) * 0.16
   + CASE WHEN channels >= 2 THEN 0.88 ELSE 0.65 END * 0.17 + greatest(0.75, character_confidence) * 0.2 AS conf FROM hp)"""


def health(spark, sf):
    return iss.mix_health(report(spark, sf).withColumn("top_resonance", F.when(F.col("u5") > 0.3, F.col("u5"))))


@query("d34_mix_health", f"""WITH {HEALTH}
SELECT track_id, {rd('tonal_balance')} AS tonal_balance, {rd('dynamics')} AS dynamics, {rd('transients')} AS transients,
  {rd('stereo_translation')} AS stereo_translation, {rd('technical_integrity')} AS technical_integrity, {rd('total')} AS health,
  {rd('conf')} AS health_confidence, CASE WHEN total >= 85 THEN 'strong' WHEN total >= 70 THEN 'generally_balanced'
  WHEN total >= 50 THEN 'attention_warranted' ELSE 'high_risk' END AS health_assessment FROM h2""")
def d34(spark, sf):
    return rounded(health(spark, sf).select("track_id", *iss.WEIGHTS, "health", "health_confidence", "health_assessment"))


def finding_report(spark, sf):
    r = F.array(*[
        F.struct((F.lit(1000.0 * (i + 1)) + F.col("u2") * 100).alias("frequency_hz"), F.col("u3").alias("persistence"),
                 (F.col(f"u{i + 4}") * 0.9).alias("severity"), F.lit(0.5).alias("first_s"), (F.lit(0.5) + F.col("u1") * i).alias("last_s"))
        for i in range(2)])
    return report(spark, sf).withColumn("resonances", r)


def _finding(cond, ix, id_, cat, sev, conf, heur, ev="NULL", s="NULL", e="NULL"):
    return (f"SELECT track_id, {ix} AS ix, {id_!r} AS id, {cat!r} AS category, {sev} AS severity, least(greatest({conf}, 0), 1) AS confidence, "
            f"{heur} AS heuristic, CAST({ev} AS DOUBLE) AS evidence, CAST({s} AS DOUBLE) AS start_s, CAST({e} AS DOUBLE) AS end_s FROM m WHERE {cond}")


_F = [
    _finding("nan_samples + infinite_samples > 0", 0, "invalid_samples", "technical", "'high'", 1, "false", "nan_samples + infinite_samples"),
    _finding("max_abs_dc > 0.003", 1, "dc_offset", "technical", "CASE WHEN max_abs_dc > 0.015 THEN 'high' ELSE 'moderate' END", 0.98, "false", "max_abs_dc"),
    _finding("defect_risk >= 0.55", 2, "clipping_defect_risk", "character", "CASE WHEN defect_risk >= 0.75 THEN 'high' ELSE 'moderate' END",
             "character_confidence", "true", "defect_risk"),
    _finding("defect_risk < 0.55 AND intentional >= 0.6", 3, "intentional_character", "character", "'info'", "character_confidence", "true", "intentional"),
    _finding("sub_buildup >= 0.65", 4, "sub_buildup", "tonal", "'moderate'", 0.78, "true", "sub_buildup"),
    _finding("mud >= 0.65", 5, "low_mid_mud", "tonal", "'moderate'", 0.76, "true", "mud"),
    _finding("harshness >= 0.62", 6, "harshness", "tonal", "CASE WHEN harshness >= 0.82 THEN 'high' ELSE 'moderate' END", 0.8, "true", "harshness"),
    _finding("u4 * 0.9 >= 0.5", 7, "resonance_0", "tonal", "CASE WHEN u4 * 0.9 >= 0.78 THEN 'high' ELSE 'moderate' END",
             "least(0.55 + u3 * 0.4, 0.95)", "true", "1000 + u2 * 100"),
    _finding("u5 * 0.9 >= 0.5", 8, "resonance_1", "tonal", "CASE WHEN u5 * 0.9 >= 0.78 THEN 'high' ELSE 'moderate' END",
             "least(0.55 + u3 * 0.4, 0.95)", "true", "2000 + u2 * 100", "CASE WHEN u1 > 0 THEN 0.5 END", "CASE WHEN u1 > 0 THEN 0.5 + u1 END"),
    _finding("channels >= 2 AND low_width > 0.25", 10, "wide_low_end", "stereo", "'moderate'", 0.88, "false", "low_width"),
    _finding("channels >= 2 AND (correlation < 0 OR negative_fraction > 0.2)", 11, "phase_instability", "stereo", "'high'", 0.92, "false", "correlation"),
    _finding("plr_db < 6 OR crest_db < 6", 12, "flattened_dynamics", "dynamics", "'moderate'", 0.88, "true", "plr_db"),
    _finding("section_contrast_db > 9", 13, "large_section_contrast", "structure", "'low'", 0.8, "false", "section_contrast_db"),
    _finding("tempo_confidence >= 0.55", 14, "tempo_structure", "structure", "'info'", "tempo_confidence", "true", "bpm"),
]
FINDINGS = REPORT + ",\nfd0 AS (" + "\n UNION ALL ".join(_F) + """),
fd AS (SELECT * FROM fd0 UNION ALL SELECT track_id, 15, 'no_major_issue', 'technical', 'info', 0.78, true, NULL, NULL, NULL FROM m
  WHERE track_id NOT IN (SELECT track_id FROM fd0 WHERE severity IN ('moderate', 'high'))),
fr AS (SELECT *, CASE severity WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sv FROM fd)"""


@query("r1_build_findings", f"""WITH {FINDINGS}
SELECT track_id, id, category, severity, {rd('confidence')} AS confidence, heuristic, {rd('evidence')} AS evidence, {rd('start_s')} AS start_s,
  {rd('end_s')} AS end_s FROM fr""")
def r1(spark, sf):
    return rounded(iss.build_findings(finding_report(spark, sf)).drop("rank"))


@query("t6_order_findings", f"""WITH {FINDINGS} SELECT track_id, id, severity,
  CAST(row_number() OVER (PARTITION BY track_id ORDER BY sv DESC, ix) - 1 AS INTEGER) AS rank FROM fr""")
def t6(spark, sf):
    return iss.build_findings(finding_report(spark, sf)).select("track_id", "id", "severity", "rank")


@query("r2_rule_gate", f"""WITH {MET}, d AS (SELECT track_id, u1 * 0.5 - 0.25 AS tp, u2 * 0.8 - 0.4 AS ld, u3 * 0.15 AS tl, u4 * 0.2 AS sp, u5 * 0.15 AS mo,
  u6 * 0.15 AS wi FROM met0)
SELECT track_id, concat_ws(',', CASE WHEN abs(tp) > 0.2 THEN 'true_peak' END, CASE WHEN abs(ld) > 0.3 THEN 'loudness' END,
  CASE WHEN tl > 0.1 THEN 'transient' END, CASE WHEN sp > 0.15 THEN 'spectral' END, CASE WHEN mo > 0.1 OR wi > 0.12 THEN 'stereo' END) AS blockers,
  NOT (abs(tp) > 0.2 OR abs(ld) > 0.3 OR tl > 0.1 OR sp > 0.15 OR mo > 0.1 OR wi > 0.12) AS safe FROM d""")
def r2(spark, sf):
    d = met(spark, sf).select(
        "track_id", (U[1] * 0.5 - 0.25).alias("true_peak_delta"), (U[2] * 0.8 - 0.4).alias("loudness_delta"), (U[3] * 0.15).alias("transient_loss"),
        (U[4] * 0.2).alias("spectral_side_effect"), (U[5] * 0.15).alias("mono_delta"), (U[6] * 0.15).alias("width_delta"))
    out = de.rule_gate(d, de.DAMAGE_GUARD)
    return out.select("track_id", F.array_join("blockers", ",").alias("blockers"), "safe")


# --- source issues -------------------------------------------------------------------------------
ROLES = ("drums", "bass", "vocals", "other", "kick", "unknown")
SRC = MET + """,
src AS (SELECT o_custkey AS track_id, track_id AS seq, ['drums', 'bass', 'vocals', 'other', 'kick', 'unknown'][track_id % 6 + 1] AS role,
  0.6 + u1 * 0.4 AS confidence, u2 * 30 - 40 AS lufs, u2 * 30 - 37.5 + u13 AS max_short_term, -14.0 AS program_lufs, -11.0 AS program_max_short_term,
  u3 * 0.7 AS presence, u4 * 0.7 AS air, u5 * 0.6 AS mud, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 2 END AS channels, u6 * 0.5 AS low_width,
  u7 * 0.8 AS mid_width, u8 * 0.3 AS negative_fraction, u9 * 8 - 8 AS mono_fold_delta_db, u10 * 14 + 9 AS crest_db, u11 * 10 - 10 AS sample_peak_db,
  u12 AS low, u13 * 14 AS duration_s FROM met0)"""


def sources(spark, sf):
    names = F.array(*[F.lit(x) for x in ROLES])
    m = met(spark, sf)
    return m.select(
        F.col("o_custkey").alias("track_id"), F.col("track_id").alias("seq"), F.get(names, (F.col("track_id") % 6).cast("int")).alias("role"),
        (U[1] * 0.4 + 0.6).alias("confidence"), (U[2] * 30 - 40).alias("lufs"), (U[2] * 30 - 37.5 + U[13]).alias("max_short_term"),
        F.lit(-14.0).alias("program_lufs"), F.lit(-11.0).alias("program_max_short_term"), (U[3] * 0.7).alias("presence"),
        (U[4] * 0.7).alias("air"), (U[5] * 0.6).alias("mud"), F.when(F.col("o_custkey") % 7 == 0, 1).otherwise(2).alias("channels"),
        (U[6] * 0.5).alias("low_width"), (U[7] * 0.8).alias("mid_width"), (U[8] * 0.3).alias("negative_fraction"),
        (U[9] * 8 - 8).alias("mono_fold_delta_db"), (U[10] * 14 + 9).alias("crest_db"), (U[11] * 10 - 10).alias("sample_peak_db"),
        U[12].alias("low"), (U[13] * 14).alias("duration_s"))


def ramp(v, lo, hi):
    return f"CASE WHEN {v} <= {lo} THEN 0.0 ELSE least(({v} - {lo}) / (({hi}) - ({lo})), 1) END"


_ISS = [
    ("excessive_level", 0, "role <> 'other' AND share > 0.86 AND gap > -0.7", f"0.65 * {ramp('share', '0.86', '1.2')} + 0.35 * {ramp('gap', '(-0.7)', '0.3')}", "NULL", "NULL"),
    ("harshness", 1, "(perc OR ton) AND hm > ht", f"{ramp('hm', 'ht', 'CASE WHEN perc THEN 0.82 ELSE 0.72 END')}",
     "CASE WHEN air > presence * 1.15 THEN 8500 ELSE 3500 END", "CASE WHEN air > presence * 1.15 THEN 0.85 ELSE 0.7 END"),
    ("muddiness", 2, "(ton OR role = 'drums') AND mud > mt", f"{ramp('mud', 'mt', '0.62')}", "350", "1.05"),
    ("excessive_width", 3, "channels >= 2 AND role = 'bass' AND low_width > 0.16", f"{ramp('low_width', '0.16', '0.48')}", "NULL", "NULL"),
    ("excessive_width", 3, "channels >= 2 AND role <> 'bass' AND mid_width > 0.42 AND (negative_fraction > 0.05 OR mono_fold_delta_db < -1)",
     f"0.65 * {ramp('mid_width', '0.42', '0.72')} + 0.35 * greatest({ramp('negative_fraction', '0.05', '0.3')}, {ramp('(-mono_fold_delta_db)', '1', '6')})", "NULL", "NULL"),
    ("transient_spike", 4, "perc AND crest_db > 13.5 AND sample_peak_db > -6", f"0.7 * {ramp('crest_db', '13.5', '21')} + 0.3 * {ramp('sample_peak_db', '(-6)', '(-0.25)')}", "NULL", "NULL"),
]
ISSUES = SRC + """,
s1 AS (SELECT *, least(pow(10, (lufs + 14) / 10), 2) AS share, max_short_term + 11 AS gap, role IN ('drums', 'kick') AS perc,
  role IN ('vocals', 'bass', 'other') AS ton, CASE WHEN role = 'bass' THEN 0.30 ELSE 0.34 END AS mt FROM src),
s2 AS (SELECT *, CASE WHEN perc THEN greatest(presence, air * 0.85) ELSE presence + 0.2 * air END AS hm,
  CASE WHEN perc THEN 0.5 ELSE 0.42 END AS ht FROM s1),
i0 AS (""" + "\nUNION ALL ".join(
    f"SELECT track_id, seq, role, confidence, {ix} AS rule_ix, '{n}' AS issue, {sev} AS severity, CAST({hz} AS DOUBLE) AS center_hz, CAST({oc} AS DOUBLE) AS octaves FROM s2 WHERE {cond}"
    for n, ix, cond, sev, hz, oc in _ISS) + """),
i1 AS (SELECT *, least(confidence * (0.78 + 0.22 * least(severity, 1)), 1) AS issue_confidence FROM i0),
single AS (SELECT * FROM i1 WHERE severity > 0 AND issue_confidence >= 0.65)"""


def single_issues(spark, sf):
    """Issues of every estimate; the estimate's number joins the track id, since a track has several of a role."""
    s = sources(spark, sf).withColumn("track_id", F.col("seq"))
    return iss.infer_source_issues(s)


@query("r4_infer_source_issues", f"""WITH {ISSUES} SELECT seq AS track_id, role, issue, {rd('severity')} AS severity,
  {rd('issue_confidence')} AS issue_confidence, {rd('center_hz')} AS center_hz, {rd('octaves')} AS octaves FROM single""")
def r4(spark, sf):
    return rounded(single_issues(spark, sf).drop("rule_ix"))


OVERLAP = "ov AS (SELECT o_custkey AS track_id, round(avg(u14) + 0.1, 9) AS overlap FROM met0 GROUP BY 1)"


def overlaps(spark, sf):
    return met(spark, sf).groupBy(F.col("o_custkey").alias("track_id")).agg(F.round(F.avg("u14") + 0.1, 9).alias("overlap"))


MASK = f"""{ISSUES},{OVERLAP},
ba AS (SELECT * FROM src WHERE role = 'bass' QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY confidence DESC, seq) = 1),
pe AS (SELECT *, low * confidence * CASE WHEN role = 'kick' THEN 1.1 ELSE 1 END AS sc FROM src WHERE role IN ('kick', 'drums')
       QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY sc DESC, seq) = 1),
mk0 AS (SELECT ba.track_id, least(ba.confidence, pe.confidence) AS conf, pe.role AS prole,
    0.35 * {ramp('ba.low', '0.55', '0.9')} + 0.25 * {ramp('pe.low', '0.18', '0.52')} + 0.4 * {ramp('overlap', '0.4', '0.9')} AS severity
  FROM ba JOIN pe USING (track_id) JOIN ov USING (track_id) WHERE ba.low > 0.55 AND pe.low > 0.18 AND overlap > 0.4),
mask AS (SELECT *, least(conf * (0.78 + 0.22 * severity), 1) AS issue_confidence FROM mk0
  WHERE severity > 0 AND least(conf * (0.78 + 0.22 * severity), 1) >= 0.65)"""


@query("j8_low_band_masking", f"""WITH {MASK} SELECT track_id, 'bass' AS role, 'masking' AS issue, {rd('severity')} AS severity,
  {rd('issue_confidence')} AS issue_confidence, CASE WHEN prole = 'kick' THEN 75.0::DOUBLE ELSE 95.0::DOUBLE END AS center_hz FROM mask""")
def j8(spark, sf):
    return rounded(iss.low_band_masking(sources(spark, sf), overlaps(spark, sf)).drop("rule_ix", "octaves"))


def all_issues(spark, sf):
    return iss.union_issues(iss.infer_source_issues(sources(spark, sf)), iss.low_band_masking(sources(spark, sf), overlaps(spark, sf)))


ALL = f"""{MASK},
alli AS (SELECT track_id, role, rule_ix, issue, severity, issue_confidence FROM single
  UNION ALL SELECT track_id, 'bass', 5, 'masking', severity, issue_confidence FROM mask)"""


@query("u1_union_issues", f"""WITH {ALL} SELECT track_id, role, issue, {rd('severity')} AS severity, {rd('issue_confidence')} AS issue_confidence
FROM alli""")
def u1(spark, sf):
    return rounded(all_issues(spark, sf).select("track_id", "role", "issue", "severity", "issue_confidence"))


@query("t2_cap_per_source", f"""WITH {ALL},
c AS (SELECT *, row_number() OVER (PARTITION BY track_id, role ORDER BY severity * issue_confidence DESC, rule_ix) AS place FROM alli)
SELECT track_id, role, issue, {rd('severity')} AS severity, CAST(place AS INTEGER) AS place FROM c WHERE place <= 3""")
def t2(spark, sf):
    return rounded(iss.cap_per_source(all_issues(spark, sf)).select("track_id", "role", "issue", "severity", "place"))


@query("d37_issue_evidence", f"""WITH {ALL} SELECT track_id, count(*) AS issues,
  {rd('least(0.1 + 0.75 * max(severity * issue_confidence) + 0.04 * least(count(*) - 1, 2), 1)')} AS benefit,
  {rd('avg(issue_confidence)')} AS guidance_confidence FROM alli GROUP BY 1""")
def d37(spark, sf):
    return rounded(iss.issue_evidence(all_issues(spark, sf)))


@query("r5_admit_sources", f"""WITH {SRC},
pg AS (SELECT o_custkey AS track_id, 0.7 + 0.3 * max(u14) AS overall, round(avg(u13) * 14, 9) AS program_s FROM met0 GROUP BY 1),
b AS (SELECT * FROM src WHERE role <> 'unknown' QUALIFY row_number() OVER (PARTITION BY track_id, role ORDER BY confidence DESC, seq) = 1),
a AS (SELECT *, least(overall, confidence) AS decl, least(0.82 + 0.1 * {ramp('duration_s', '2', '12')} + 0.08 * {ramp('lufs', '(-55)', '(-30)')}, 1) AS meas
      FROM b JOIN pg USING (track_id))
SELECT track_id, role, CASE WHEN decl < 0.7 THEN 'low confidence' WHEN duration_s < 2 THEN 'too short' WHEN lufs < -55 THEN 'inactive'
  WHEN abs(duration_s - program_s) > greatest(4, program_s * 0.002) THEN 'not aligned' END AS reason,
  {rd("CASE WHEN decl >= 0.7 AND duration_s >= 2 AND lufs >= -55 AND abs(duration_s - program_s) <= greatest(4, program_s * 0.002) THEN least(decl, meas) END")}
  AS effective_confidence FROM a""")
def r5(spark, sf):
    pg = met(spark, sf).groupBy(F.col("o_custkey").alias("track_id")).agg(
        (F.max("u14") * 0.3 + 0.7).alias("overall_confidence"), F.round(F.avg("u13") * 14, 9).alias("program_s"))
    return rounded(iss.admit_sources(sources(spark, sf), pg, 4.0).select("track_id", "role", "reason", "effective_confidence"))


INTERV = f"""{MET},
q0 AS (SELECT track_id, ['drums', 'bass', 'vocals', 'unknown'][track_id % 4 + 1] AS role,
  ['excessive_level', 'harshness', 'muddiness', 'masking', 'excessive_width', 'transient_spike'][track_id % 6 + 1] AS issue,
  CASE WHEN u1 < 0.05 THEN 0 ELSE u1 END AS severity, 0.5 + u2 * 0.5 AS issue_confidence, 0.6 + u3 * 0.4 AS mode_confidence,
  CASE WHEN u4 < 0.8 THEN u4 * 10 END AS start_s, CASE WHEN u5 < 0.9 THEN u5 * 20 END AS end_s,
  CASE WHEN u6 < 0.9 THEN u6 * 20000 END AS hz, CASE WHEN u7 < 0.5 THEN u7 * 5 END AS oc FROM met0),
q1 AS (SELECT *, least(issue_confidence, mode_confidence) AS cf, issue IN ('harshness', 'muddiness', 'masking') AS tonal FROM q0),
q2 AS (SELECT *, CASE WHEN role = 'unknown' THEN 'unknown role' WHEN severity <= 0 THEN 'zero severity' WHEN cf < 0.65 THEN 'low confidence'
  WHEN NOT ((start_s IS NULL AND end_s IS NULL) OR coalesce(start_s >= 0 AND end_s > start_s, false)) THEN 'invalid time range'
  WHEN tonal AND (hz IS NULL OR hz < 30 OR hz > 18000) THEN 'invalid frequency' END AS skipped FROM q1)"""


@query("r6_plan_interventions", f"""WITH {INTERV}
SELECT track_id, skipped, CASE WHEN skipped IS NULL THEN CASE WHEN issue = 'excessive_level' THEN 'gain_riding' WHEN tonal THEN 'dynamic_eq_attenuation'
    WHEN issue = 'excessive_width' THEN 'stereo_width_reduction' ELSE 'transient_taming' END END AS action,
  {rd('''CASE WHEN skipped IS NULL THEN CASE WHEN issue = 'excessive_level' THEN -severity * 1.5 WHEN tonal THEN -severity * 2.5
    WHEN issue = 'excessive_width' THEN severity * 0.3 ELSE severity * 0.35 END END''')} AS amount, {rd('CASE WHEN skipped IS NULL THEN cf END')} AS confidence,
  {rd('''CASE WHEN skipped IS NULL AND tonal THEN least(greatest(coalesce(oc, CASE issue WHEN 'harshness' THEN 0.7 WHEN 'muddiness' THEN 1.1 ELSE 0.9 END), 0.2), 2) END''')}
  AS bandwidth_octaves FROM q2""")
def r6(spark, sf):
    m = met(spark, sf)
    kinds = F.array(*[F.lit(x) for x in ("excessive_level", "harshness", "muddiness", "masking", "excessive_width", "transient_spike")])
    roles = F.array(*[F.lit(x) for x in ("drums", "bass", "vocals", "unknown")])
    i = m.select(
        "track_id", F.get(roles, (F.col("track_id") % 4).cast("int")).alias("role"), F.get(kinds, (F.col("track_id") % 6).cast("int")).alias("issue"),
        F.when(U[1] < 0.05, 0.0).otherwise(U[1]).alias("severity"), (U[2] * 0.5 + 0.5).alias("issue_confidence"),
        (U[3] * 0.4 + 0.6).alias("mode_confidence"), F.when(U[4] < 0.8, U[4] * 10).alias("start_s"), F.when(U[5] < 0.9, U[5] * 20).alias("end_s"),
        F.when(U[6] < 0.9, U[6] * 20000).alias("center_hz"), F.when(U[7] < 0.5, U[7] * 5).alias("octaves"))
    return rounded(iss.plan_interventions(i).select("track_id", "skipped", "action", "amount", "confidence", "bandwidth_octaves"))


RISK = f"""{MET},
k0 AS (SELECT *, 0.17 * u1 + 0.15 * u2 + 0.2 * u3 + 0.12 * u4 + 0.12 * u5 + 0.12 * u6 + 0.12 * u7 AS wgt, greatest(u1, u2, u3, u4, u5, u6, u7) AS wst FROM met0),
k1 AS (SELECT *, least(greatest(wgt, wst * 0.78) + (1 - u8) * 0.12, 1) AS risk, sqrt(u8 * u9) AS rconf FROM k0)"""


def risks(spark, sf):
    names = ["leakage", "musical_noise", "transient_damage", "phase_change", "hf_smearing", "source_residue", "residual",
             "model_confidence", "measurement_confidence"]
    return de.artifact_risk(met(spark, sf).select("track_id", *[U[i + 1].alias(n) for i, n in enumerate(names)], *[f"u{i}" for i in range(10, 15)]))


@query("d32_artifact_risk", f"""WITH {RISK} SELECT track_id, {rd('risk')} AS overall_risk, {rd('rconf')} AS risk_confidence FROM k1""")
def d32(spark, sf):
    return rounded(risks(spark, sf).select("track_id", "overall_risk", "risk_confidence"))


@query("d32_reconstruction_risk", f"""WITH {MET},
r AS (SELECT track_id, 1 - exp(-u1 * 0.5 * 4) AS rs, (1 - (u2 * 2 - 1)) * 0.5 AS ph, 1 - exp(-u3 * 2.5) AS tr, 1 - exp(-u4 * 2.0) AS hf, u5 AS mc, u6 AS md FROM met0)
SELECT track_id, {rd('least(greatest(0.46 * rs + 0.2 * ph + 0.22 * tr + 0.12 * hf, rs * 0.72) + (1 - mc) * 0.1 + (1 - md) * 0.1 + 0.03, 1)')} AS overall_risk,
  {rd('sqrt(md * mc) * 0.9')} AS risk_confidence FROM r""")
def d32b(spark, sf):
    m = met(spark, sf).select("track_id", (U[1] * 0.5).alias("residual_ratio"), (U[2] * 2 - 1).alias("correlation"), U[3].alias("transient_ratio"),
                              U[4].alias("hf_ratio"), U[5].alias("confidence"), U[6].alias("model_confidence"))
    return rounded(de.reconstruction_risk(m).select("track_id", "overall_risk", "risk_confidence"))


@query("r7_choose_mode", f"""WITH {RISK},
e AS (SELECT *, track_id % 9 <> 0 AS sp, track_id % 2 = 0 AS fl, u10 AS bf, u11 AS gc, u12 AS gs,
  u13 >= 0.8 AND rconf >= 0.55 AND risk <= 0.25 AND u10 - risk >= 0.2 AS q FROM (SELECT * REPLACE (risk * 0.35 AS risk) FROM k1))
SELECT track_id, CASE WHEN NOT sp OR bf < 0.18 THEN 'stereo_mastering' WHEN fl AND q THEN 'stem_reconstruction'
    WHEN gc >= 0.55 AND gs >= 0.45 THEN 'source_guided_stereo' ELSE 'stereo_mastering' END AS mode,
  {rd('''CASE WHEN NOT sp THEN 1 WHEN bf < 0.18 THEN 1 - bf WHEN fl AND q THEN least(u13, rconf)
    WHEN gc >= 0.55 AND gs >= 0.45 THEN least(gc, greatest(gs, rconf)) ELSE greatest(0.25, 1 - gc) END''')} AS mode_confidence,
  CASE WHEN NOT sp THEN 'no source-specific issue' WHEN bf < 0.18 THEN 'benefit too small' WHEN fl AND q THEN 'reconstruction gates passed'
    WHEN gc >= 0.55 AND gs >= 0.45 THEN 'estimates guide the mix' ELSE 'guidance too weak' END AS reason FROM e""")
def r7(spark, sf):
    e = risks(spark, sf).select(
        "track_id", (F.col("overall_risk") * 0.35).alias("overall_risk"), "risk_confidence", (F.col("track_id") % 9 != 0).alias("source_specific_issue"),
        (F.col("track_id") % 2 == 0).alias("reconstruction_required"), U[10].alias("benefit"), U[11].alias("guidance_confidence"),
        U[12].alias("guided_sufficiency"), U[13].alias("model_confidence"))
    return rounded(de.choose_mode(e).select("track_id", "mode", "mode_confidence", "reason"))


# --- decisions -----------------------------------------------------------------------------------
EVID = f"""{REPORT}, ev AS (SELECT *, o_custkey % 3 = 0 AS mask, o_custkey % 4 = 0 AS harsh_flag FROM m)"""


def evidence(spark, sf):
    return report(spark, sf).select(
        "track_id", "integrated_lufs", "true_peak_dbtp", "centroid_hz", F.col("correlation").alias("stereo_correlation"),
        (F.col("o_custkey") % 3 == 0).alias("kick_bass_masking"), (F.col("o_custkey") % 4 == 0).alias("harsh"))


@query("r14_diagnose", f"""WITH {EVID}
SELECT track_id, {rd('greatest(0, -1 - true_peak_dbtp)')} AS headroom_db, CASE WHEN integrated_lufs > -10 THEN 'loud_competitive'
  WHEN integrated_lufs < -16 THEN 'dynamic_acoustic' ELSE 'modern_streaming' END AS tendency,
  CASE WHEN correlation < 0.7 THEN 0.6::DOUBLE ELSE 1::DOUBLE END AS stereo_stability, CASE WHEN mask THEN 0.65::DOUBLE ELSE 1::DOUBLE END AS low_end_cleanliness,
  CASE WHEN harsh_flag THEN 0.7::DOUBLE ELSE 1::DOUBLE END AS high_smoothness, concat_ws(',', CASE WHEN correlation < 0.7 THEN 'wide low end' END,
  CASE WHEN mask THEN 'kick and bass overlap' END, CASE WHEN harsh_flag THEN 'harsh highs' END) AS issues FROM ev""")
def r14(spark, sf):
    d = de.diagnose(evidence(spark, sf))
    return rounded(d.select("track_id", "headroom_db", "tendency", "stereo_stability", "low_end_cleanliness", "high_smoothness",
                            F.array_join("issues", ",").alias("issues")))


@query("r13_explain_diagnosis", f"""WITH {EVID}
SELECT track_id, concat_ws('; ', CASE WHEN integrated_lufs > -10 THEN 'loud_competitive' WHEN integrated_lufs < -16 THEN 'dynamic_acoustic'
    ELSE 'modern_streaming' END, printf('headroom %.1f dB', greatest(0, -1 - true_peak_dbtp)),
  CASE WHEN correlation < 0.7 OR mask OR harsh_flag THEN 'issues: ' || concat_ws(', ', CASE WHEN correlation < 0.7 THEN 'wide low end' END,
    CASE WHEN mask THEN 'kick and bass overlap' END, CASE WHEN harsh_flag THEN 'harsh highs' END) END,
  CASE WHEN correlation >= 0.7 OR NOT mask THEN 'good: ' || concat_ws(', ', CASE WHEN correlation >= 0.7 THEN 'stable centre' END,
    CASE WHEN NOT mask THEN 'clean low end' END) END) AS text FROM ev""")
def r13(spark, sf):
    d = de.diagnose(evidence(spark, sf))
    return d.select("track_id", de.explain_diagnosis(d).alias("text"))


CAND = f"""{EVID},
cd(candidate, off, keep) AS (VALUES ('candidate_balanced', 0.0, 0.35), ('candidate_preservation', -1.5, 0.85), ('candidate_warm', -0.5, 0.60)),
sc AS (SELECT track_id, candidate, -11 + off AS target_lufs, 0.85 - CASE WHEN centroid_hz > 4000 AND keep < 0.5 THEN 0.1 ELSE 0 END AS tonal,
  0.9 - CASE WHEN mask AND keep < 0.4 THEN 0.15 ELSE 0 END AS low_end, CASE WHEN keep > 0.6 THEN 0.92 ELSE 0.82 END AS punch, correlation FROM ev, cd),
s2 AS (SELECT *, 0.25 * tonal + 0.25 * low_end + 0.2 * punch + 0.2 * 0.85 + 0.1 * 0.95 AS score FROM sc)"""


def scored(spark, sf):
    return de.score_candidates(de.generate_candidates(evidence(spark, sf)))


@query("r15_generate_candidates", f"""WITH {CAND} SELECT track_id, candidate, target_lufs::DOUBLE AS target_lufs, -1.0::DOUBLE AS ceiling_dbtp FROM s2""")
def r15(spark, sf):
    return de.generate_candidates(evidence(spark, sf)).select("track_id", "candidate", "target_lufs", "ceiling_dbtp")


@query("r16_score_candidates", f"""WITH {CAND} SELECT track_id, candidate, {rd('tonal')} AS tonal_balance, {rd('low_end')} AS low_end_stability,
  {rd('punch')} AS punch, {rd('correlation')} AS stereo_integrity, {rd('score')} AS score FROM s2""")
def r16(spark, sf):
    return rounded(scored(spark, sf).select("track_id", "candidate", "tonal_balance", "low_end_stability", "punch", "stereo_integrity", "score"))


@query("t3_select_finalists", f"""WITH {CAND},
rk AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(score, 9) DESC, candidate) AS n FROM s2)
SELECT track_id, max(candidate) FILTER (n = 1) AS master_a, {rd('max(score) FILTER (n = 1)')} AS score_a, max(candidate) FILTER (n = 2) AS master_b,
  {rd('max(score) FILTER (n = 2)')} AS score_b FROM rk GROUP BY 1""")
def t3(spark, sf):
    # equal scores differ by rounding noise: compare at nine digits
    return rounded(de.select_finalists(scored(spark, sf).withColumn("score", F.round("score", 9))))


@query("j15_reference_influence", f"""WITH {MET}, st(strength, w, lim) AS (VALUES ('loose', 0.25, 1.5), ('balanced', 0.5, 3.0), ('close', 0.8, 4.5)),
p AS (SELECT track_id, u1 * 20 - 20 AS rl, u2 * 20 - 20 AS sl, u3 * 30 - 60 AS rb, u4 * 30 - 60 AS sb, u5 * 30 - 60 AS rp, u6 * 30 - 60 AS sp FROM met0)
SELECT track_id, strength, {rd('sl + least(greatest((rl - sl) * w, -lim), lim)')} AS target_lufs, {rd('least(greatest((rb - sb) * w, -lim), lim)')} AS low_shelf_db,
  {rd('least(greatest((rp - sp) * w, -lim), lim)')} AS high_shelf_db, {rd('least(greatest((rl - sl) * w, -lim), lim) * 0.7')} AS pre_gain_db FROM p, st""")
def j15(spark, sf):
    p = met(spark, sf).select(
        "track_id", (U[1] * 20 - 20).alias("ref_lufs"), (U[2] * 20 - 20).alias("src_lufs"), (U[3] * 30 - 60).alias("ref_bass_db"),
        (U[4] * 30 - 60).alias("src_bass_db"), (U[5] * 30 - 60).alias("ref_presence_db"), (U[6] * 30 - 60).alias("src_presence_db"))
    return rounded(de.reference_influence(p).select("track_id", "strength", "target_lufs", "low_shelf_db", "high_shelf_db", "pre_gain_db"))


# --- plans ---------------------------------------------------------------------------------------
def plans(spark, sf):
    return pl.plan_ab(report(spark, sf))


def node_rows(p, *extra):
    # rounded once for each plan, not for each of its nodes
    p = p.select("track_id", "variant", F.round("target_lufs", 6).alias("target_lufs"), *extra, "nodes")
    return p.select("track_id", "variant", "target_lufs", *extra, F.posexplode(g.describe(F.col("nodes"))).alias("pos", "node"))


def _p(**kw):
    return " || ' ' || ".join(f"'{k}=' || printf('%.4f', {v})" for k, v in sorted(kw.items()))


_NODES_A = [
    ("a_pre_gain gain", "true", _p(gain_db="ga")),
    ("a_low_dynamic_eq dynamic_eq", "lw > 0.42", _p(frequency_hz=70., q=1., threshold_db=-20., ratio=2., attack_ms=18., release_ms=150., max_reduction_db="CASE WHEN lw > 0.55 THEN 3.0 ELSE 2.0 END")),
    ("a_upper_mid_dynamic_eq dynamic_eq", "upper_mid > 0.2", _p(frequency_hz=3800., q=1.2, threshold_db=-24., ratio=1.8, attack_ms=8., release_ms=90., max_reduction_db=1.8)),
    ("a_glue compressor", "true", _p(threshold_db=-17., ratio="CASE WHEN cr < 8 THEN 1.25 ELSE 1.55 END", attack_ms="CASE WHEN cr < 8 THEN 35.0 ELSE 24.0 END", release_ms=120., knee_db=6., makeup_db=0., mix="CASE WHEN cr < 8 THEN 0.45 ELSE 0.7 END")),
    ("a_multiband_control multiband", "short_term_variation > 5 OR lw > 0.52", _p(low_crossover_hz=125., high_crossover_hz=5200., low_threshold_db=-19., mid_threshold_db=-16., high_threshold_db=-18., low_ratio=1.45, mid_ratio=1.2, high_ratio=1.3, attack_ms=28., release_ms=170.)),
    ("a_transient_restore transient", "cr < 9", _p(attack_db=1.25, sustain_db=-0.15, fast_ms=3., slow_ms=32., mix=0.75)),
    ("a_saturation saturation", "clipped_samples = 0 AND true_peak_dbtp < 0.5", _p(drive_db=2., mix=0.1)),
    ("a_stereo stereo", "channels = 2", _p(width="CASE WHEN correlation < 0.2 THEN 0.95 WHEN correlation > 0.75 AND mid_width < 0.35 THEN 1.08 ELSE 1.0 END", bass_mono_hz="CASE WHEN low_width > 0.15 THEN 115.0 ELSE 85.0 END")),
    ("a_clipper clipper", "true", _p(threshold_db="CASE WHEN ta > -10.2 THEN -1.7 ELSE -1.25 END", softness="CASE WHEN ta > -10.2 THEN 0.32 ELSE 0.2 END")),
    ("a_limiter limiter", "true", _p(ceiling_db=-1., release_ms=85.)),
]
_NODES_B = [
    ("b_pre_gain gain", "true", _p(gain_db="gb")),
    ("b_glue compressor", "true", _p(threshold_db=-14., ratio=1.22, attack_ms=40., release_ms=180., knee_db=8., makeup_db=0., mix=0.42)),
    ("b_low_end_stereo_safety stereo", "channels = 2 AND low_width > 0.22", _p(width=1., bass_mono_hz=100.)),
    ("b_light_saturation saturation", "clipped_samples = 0 AND cr > 8", _p(drive_db=1., mix=0.04)),
    ("b_limiter limiter", "true", _p(ceiling_db=-1., release_ms=120.)),
]
_TONE_A = """concat_ws('|', CASE WHEN max_abs_dc > 0.003 THEN 'high_pass@18.0:0.000:0.707' END,
  CASE WHEN lw > 0.48 THEN 'low_shelf@105.0:-1.200:0.707' WHEN lw < 0.2 THEN 'low_shelf@95.0:0.600:0.707' END,
  CASE WHEN upper_mid > 0.23 THEN 'peak@3500.0:-0.800:0.900' END,
  CASE WHEN high > 0.13 AND centroid_hz > 3200 THEN 'high_shelf@8500.0:-0.600:0.707' WHEN high < 0.045 AND centroid_hz < 2200 THEN 'high_shelf@9000.0:0.450:0.707' END)"""
_TONE_B = "concat_ws('|', CASE WHEN lw > 0.52 THEN 'low_shelf@100.0:-0.550:0.707' END, CASE WHEN upper_mid > 0.26 THEN 'peak@3600.0:-0.400:0.800' END)"
PLANNED = f"""p0 AS (SELECT *, sub + bass AS lw, least(greatest(crest_db, 2), 24) AS cr, least(greatest(plr_db, 2), 24) AS pr, integrated_lufs AS nw FROM m),
p1 AS (SELECT *, least(greatest(CASE WHEN nw >= -9 THEN nw WHEN cr <= 7 OR pr <= 7 THEN -10.8 WHEN cr >= 12 AND pr >= 10 THEN -9.2 ELSE -10 END, -12), -8.5) AS ta FROM p0),
p2 AS (SELECT *, least(greatest(CASE WHEN nw >= -10.5 THEN nw ELSE ta - 1.5 END, -13), -9.5) AS tb FROM p1),
p3 AS (SELECT *, least(greatest((ta - nw) * 0.68 - 0.6, -3), 6) - CASE WHEN true_peak_dbtp > 0 THEN least(true_peak_dbtp, 2) ELSE 0 END AS ga,
  least(greatest((tb - nw) * 0.48 - 0.25, -2), 3.5) - CASE WHEN true_peak_dbtp > 0 THEN least(true_peak_dbtp, 1.5) ELSE 0 END AS gb,
  {_TONE_A} AS tone_a, {_TONE_B} AS tone_b FROM p2)"""
PLAN = f"""{REPORT},
{PLANNED},
nd AS (""" + "\nUNION ALL ".join(
    [f"SELECT track_id, 'a' AS variant, ta AS target, {0 if i == 0 else i + 1} AS ix, '{n} ' || {p} || ' ' AS node FROM p3 WHERE {c}" for i, (n, c, p) in enumerate(_NODES_A)]
    + [f"SELECT track_id, 'b', tb, {0 if i == 0 else i + 1}, '{n} ' || {p} || ' ' FROM p3 WHERE {c}" for i, (n, c, p) in enumerate(_NODES_B)]
    + ["SELECT track_id, 'a', ta, 1, 'a_tonal_eq eq ' || tone_a FROM p3 WHERE tone_a <> ''", "SELECT track_id, 'b', tb, 1, 'b_tonal_eq eq ' || tone_b FROM p3 WHERE tone_b <> ''"]) + ")"


@query("r8_plan_ab", f"""WITH {PLAN} SELECT track_id, variant, {rd('target')} AS target_lufs,
  CAST(row_number() OVER (PARTITION BY track_id, variant ORDER BY ix) - 1 AS INTEGER) AS pos, trim(node) AS node FROM nd""")
def r8(spark, sf):
    return node_rows(plans(spark, sf)).withColumn("node", F.trim("node"))


def adjusted(spark, sf):
    p = plans(spark, sf)
    return pl.adjust_plan(p.withColumns({
        "resonance_hz": F.when(F.col("u1") > 0.4, F.col("u1") * 3000 + 2500), "resonance_severity": F.when(F.col("u1") > 0.4, F.col("u2"))}))


@query("r9_adjust_plan")
def r9(spark, sf):
    return node_rows(adjusted(spark, sf))


@query("r9_adjusted_targets", f"""WITH {PLAN},
v AS (SELECT *, 'a' AS variant, ta AS t0 FROM p3 UNION ALL SELECT *, 'b', tb FROM p3),
t1 AS (SELECT *, CASE WHEN defect_risk >= 0.55 THEN greatest(CASE variant WHEN 'a' THEN -12 ELSE -13 END, t0 - CASE variant WHEN 'a' THEN 0.8 ELSE 0.5 END) ELSE t0 END AS t FROM v),
t2 AS (SELECT * REPLACE (CASE WHEN section_contrast_db >= 8 THEN greatest(CASE variant WHEN 'a' THEN -12 ELSE -13 END, t - CASE variant WHEN 'a' THEN 0.4 ELSE 0.25 END) ELSE t END AS t) FROM t1),
t3 AS (SELECT * REPLACE (CASE WHEN variant = 'a' AND health >= 86 AND defect_risk < 0.25 THEN least(t, -9.8) ELSE t END AS t) FROM t2)
SELECT track_id, variant, {rd("CASE variant WHEN 'a' THEN least(greatest(t, -12), -8.5) ELSE least(greatest(t, -13), -9.5) END")} AS target_lufs FROM t3""")
def r9_targets(spark, sf):
    return rounded(adjusted(spark, sf).select("track_id", "variant", "target_lufs"))


def styled(spark, sf):
    names = F.array(*[F.lit(x[0]) for x in di.STYLES])
    p = plans(spark, sf).withColumn("style", F.get(names, (F.col("o_custkey") % 6).cast("int")))
    s = di.styles(spark)
    s = s.select("style", *[F.col(c).alias(f"style_{c}") for c in s.columns if c != "style"])
    return pl.apply_controls(p.join(F.broadcast(s), "style"))  # six fixed rows


@query("r10_apply_controls")
def r10(spark, sf):
    return node_rows(styled(spark, sf), "style")


@query("r11_graph_edit", f"""WITH {PLAN},
c AS (SELECT track_id, variant, count(*) AS n, count(*) FILTER (node LIKE '%limiter limiter%') AS lim FROM nd GROUP BY ALL)
SELECT track_id, variant, CAST(n + 1 AS INTEGER) AS nodes, variant = 'a' AS has_clipper, true AS glue_bypassed, '' AS problems FROM c""")
def r11(spark, sf):
    """Insert a node before the limiter, bypass the glue stage, validate."""
    p = plans(spark, sf)
    n = F.col("nodes")
    anchor = F.when(F.col("variant") == "a", "a_limiter").otherwise("b_limiter")
    n = g.insert_before(n, anchor, g.node("check", "gain", gain_db=0.0).cast(g.NODE))
    n = g.set_bypass(g.set_bypass(n, "a_glue", F.lit(True)), "b_glue", F.lit(True))
    p = p.withColumn("nodes", n)
    return p.select(
        "track_id", "variant", F.size("nodes").alias("nodes"), g.contains(F.col("nodes"), "a_clipper").alias("has_clipper"),
        F.exists("nodes", lambda x: x["id"].isin("a_glue", "b_glue") & x["bypass"]).alias("glue_bypassed"),
        F.array_join(g.validate(F.col("nodes")), ",").alias("problems"))


# --- phrase rules: frequent tokens of the given texts stand for the request phrases ------------------
TOKEN_ACTIONS = [
    ("punch", "increase_punch", "stem_drums", "drums", 0.6, 0.0, ["le ", "the"]),
    ("punch", "reduce_punch", "stem_drums", "drums", 0.5, 0.0, ["la", "en"]),
    ("highs", "reduce_harshness", "global", "highs", 0.6, 0.0, ["qui", "ung"]),
    ("highs", "increase_brightness", "global", "air", 0.5, 0.0, ["ion", "ing"]),
    ("bass", "adjust_bass_level", "stem_bass", "bass", 0.5, 1.5, ["eau", "ver"]),
    ("loudness", "adjust_loudness", "global", "master", 0.9, 1.0, ["tion", "der"]),
    ("width", "adjust_stereo_width", "global", "stereo_field", -0.4, 0.0, ["ment", "ich"]),
    ("saturation", "adjust_saturation", "global", "saturation", 0.5, 0.0, ["aux", "sch"]),
]
TOKEN_CONSTRAINTS = [("stem_bass", "bass", "keep bass", ["mentre", "lich"]), ("instrument_snare", "snare", "keep snare", ["dans", "und"])]


def parsed(spark, sf):
    return rv.match_phrases(table(spark, sf, "conversations"), "text", TOKEN_ACTIONS, TOKEN_CONSTRAINTS)


_CATS = {}
for _r in TOKEN_ACTIONS:
    _CATS.setdefault(_r[0], []).append(_r)


def _has(phrases):
    return "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in phrases) + ")"


PARSED = "pa AS (SELECT conv_id, turn, " + ", ".join(
    "CASE " + " ".join(f"WHEN {_has(x[6])} THEN '{x[1]}'" for x in rs) + f" END AS c_{c}" for c, rs in _CATS.items()) + ", " + ", ".join(
    f"{_has(x[3])} AS k_{x[0]}" for x in TOKEN_CONSTRAINTS) + " FROM conversations)"
_ACTS = "concat_ws(',', " + ", ".join(f"c_{c}" for c in _CATS) + ")"


@query("j12_match_phrases", f"""WITH {PARSED}, q AS (SELECT *, {_ACTS} AS acts, concat_ws(',', CASE WHEN k_stem_bass THEN 'stem_bass' END,
  CASE WHEN k_instrument_snare THEN 'instrument_snare' END) AS cons FROM pa)
SELECT conv_id, turn, CASE WHEN acts = '' AND cons = '' THEN 'custom' ELSE acts END AS actions, cons AS constraints FROM q""")
def j12(spark, sf):
    return parsed(spark, sf).select(
        "conv_id", "turn", F.array_join(F.transform("actions", lambda a: a["action"]), ",").alias("actions"),
        F.array_join(F.transform("constraints", lambda c: c["target"]), ",").alias("constraints"))


@query("j13_constraint_conflicts", f"""WITH {PARSED} SELECT conv_id, turn, k_stem_bass AND c_bass IS NOT NULL AS violated,
  k_instrument_snare AND c_loudness IS NOT NULL AS warned FROM pa""")
def j13(spark, sf):
    c = rv.constraint_conflicts(parsed(spark, sf))
    return c.select("conv_id", "turn", (F.size("violations") > 0).alias("violated"), (F.size("warnings") > 0).alias("warned"))


@query("j14_resolve_targets", f"""WITH {MET},
a AS (SELECT track_id, o_custkey, ['global', 'instrument_808', 'instrument_kick', 'instrument_snare', 'stem_vocal'][track_id % 5 + 1] AS target FROM met0),
e AS (SELECT p_partkey // 4 AS o_custkey, ['sub_808', 'kick', 'snare', 'lead_vocal', 'organ'][p_size % 5 + 1] AS label, p_retailprice / 5000 AS confidence FROM part),
b AS (SELECT a.track_id, a.target, count(e.label) AS any_, max(confidence) FILTER (
    (target = 'instrument_808' AND label = 'sub_808') OR (target = 'instrument_kick' AND label = 'kick') OR (target = 'instrument_snare' AND label = 'snare')
    OR (target = 'stem_vocal' AND label = 'lead_vocal')) AS f FROM a LEFT JOIN e USING (o_custkey) GROUP BY ALL)
SELECT track_id, target, target = 'global' OR any_ = 0 OR f IS NOT NULL AS present,
  {rd("CASE WHEN target = 'global' OR any_ = 0 THEN 1 ELSE coalesce(f, 0.2) END")} AS target_confidence FROM b""")
def j14(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("global", "instrument_808", "instrument_kick", "instrument_snare", "stem_vocal")])
    a = met(spark, sf).select(F.col("track_id").alias("request"), F.col("o_custkey").alias("track_id"),
                              F.get(kinds, (F.col("track_id") % 5).cast("int")).alias("target")).withColumn("target_name", F.col("target"))
    names = F.array(*[F.lit(x) for x in ("sub_808", "kick", "snare", "lead_vocal", "organ")])
    p = table(spark, sf, "part").select(
        F.expr("p_partkey div 4").alias("track_id"), F.get(names, (F.col("p_size") % 5).cast("int")).alias("label"),
        (F.col("p_retailprice") / 5000).alias("confidence")).withColumn(
        "role", F.when(F.col("label") == "lead_vocal", "vocals").otherwise("other"))
    out = rv.resolve_targets(a, p)
    return rounded(out.select(F.col("request").alias("track_id"), "target", "present", "target_confidence"))


def revised(spark, sf):
    """The plan of each order revised by the conversation of the same number."""
    c = rv.constraint_conflicts(parsed(spark, sf)).select(
        F.col("conv_id"), "turn", "actions", "constraints", "violations")
    # some numbers of an order become a plan of some kilobytes: plans are made only of orders that a conversation revises
    asked = table(spark, sf, "conversations").select(F.col("conv_id").alias("track_id")).distinct()
    p = pl.plan_ab(report(spark, sf).join(asked, "track_id", "left_semi")).withColumn("conv_id", F.col("track_id"))
    return pl.apply_revision(p.join(c, "conv_id"))


@query("r12_apply_revision", f"""WITH {PARSED}, {PLAN},
j AS (SELECT track_id, turn, v.variant, CASE v.variant WHEN 'a' THEN ta ELSE tb END AS t, k_stem_bass AND c_bass IS NOT NULL AS bad, c_loudness
      FROM p3 JOIN pa ON pa.conv_id = p3.track_id, (VALUES ('a'), ('b')) AS v(variant))
SELECT track_id, turn, variant, NOT bad AS accepted, {rd('CASE WHEN NOT bad AND c_loudness IS NOT NULL THEN least(greatest(t + 1, -16), -6) ELSE t END')}
  AS target_lufs FROM j""")
def r12(spark, sf):
    return rounded(revised(spark, sf).select("track_id", "turn", "variant", "accepted", "target_lufs"))


@query("r12_revised_nodes")
def r12_nodes(spark, sf):
    r = revised(spark, sf)
    return r.select("track_id", "turn", "variant", F.array_join("changes", "; ").alias("changes"), rv.explain_revision(r).alias("explanation"),
                    F.array_join(g.describe(F.col("nodes")), "\n").alias("nodes"))


@query("a8_report_json")
def a8(spark, sf):
    r = report(spark, sf)
    return rep.report_json(r, {"loudness": ["integrated_lufs", "true_peak_dbtp", "crest_db"], "stereo": ["correlation", "low_width"],
                               "integrity": ["nan_samples", "max_abs_dc"]})


@query("a9_graph_json")
def a9(spark, sf):
    return plans(spark, sf).select("track_id", "variant", g.to_json(F.col("nodes")).alias("graph"))
