"""Column-function, identity and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels as lv
from ..operators import frames as fr
from ..plans import dimensions as di
from ..sources import identity as idn
from ..sources.adapters import sig_line, table
from . import query
from .common import SIG_LINE, rd
from .measure import rounded

def per_frame(name: str, cols, sql: dict[str, str], digits: int = 7):
    """Register a projection ``cols(l, r)`` over the line series with its SQL."""
    body = ", ".join(f"{rd(e, digits)} AS {n}" for n, e in sql.items())

    @query(name, f"WITH {SIG_LINE} SELECT track_id, frame_ix, {body} FROM sig_line")
    def run(spark, sf):
        return rounded(sig_line(spark, sf).select("track_id", "frame_ix", *[c.alias(n) for n, c in cols(F.col("l"), F.col("r")).items()]), digits=digits)


per_frame("b1_downmix", lambda l, r: {"mono": fr.downmix(l, r)}, {"mono": "(l + r) / 2"})
per_frame("b2_mid_side", lambda l, r: dict(zip(("mid", "side", "mid_half", "side_half"), (*fr.mid_side(l, r, 0.5**0.5), *fr.mid_side(l, r, 0.5)))),
          {"mid": "(l + r) * sqrt(0.5)", "side": "(l - r) * sqrt(0.5)", "mid_half": "(l + r) * 0.5", "side_half": "(l - r) * 0.5"})
per_frame("b3_decibels", lambda l, r: {"floor200": lv.amplitude_db(F.abs(r)), "floor120": lv.amplitude_db_min(F.abs(r)), "power": lv.power_db(r * r),
     "clamped": lv.amplitude_db_clamped(F.abs(r)), "linear": lv.to_linear(r * 6)},
    {"floor200": "CASE WHEN abs(r) > 0 THEN 20 * log10(abs(r)) ELSE -200 END",
     "floor120": "CASE WHEN abs(r) > 1e-12 THEN 20 * log10(abs(r)) ELSE -120 END",
     "power": "10 * log10(greatest(r * r, 1e-18))", "clamped": "20 * log10(greatest(abs(r), 1e-12))", "linear": "pow(10, r * 6 / 20)"})
per_frame("b4_clamp_ramp", lambda l, r: {"clamped": lv.clamp(r, -0.5, 0.5), "ramped": lv.ramp(l, 0.2, 0.9), "step": lv.ramp(l, 0.5, 0.5),
                            "score": lv.score_from_ratio(l, 0.18, 0.35)},
          {"clamped": "least(greatest(r, -0.5), 0.5)", "ramped": "least(greatest((l - 0.2) / 0.7, 0), 1)",
           "step": "CASE WHEN l <= 0.5 THEN 0 ELSE 1 END", "score": "least(greatest((l - 0.18) / 0.35, 0), 1)"})
per_frame("b6_gain", lambda l, r: {"y": lv.gain(l, -3.0)}, {"y": "l * pow(10, -3.0 / 20)"})
per_frame("b7_saturate", lambda l, r: {"y": lv.saturate(r, 6.0, 0.4)},
          {"y": "r * 0.6 + tanh(r * pow(10, 0.3)) / tanh(pow(10, 0.3)) * 0.4"})
per_frame("b8_clip_soft", lambda l, r: {"y": lv.clip_soft(r, -3.0, 0.4)}, {
    "y": """CASE WHEN abs(r) >= pow(10, -0.15) THEN sign(r) * pow(10, -0.15) WHEN abs(r) > pow(10, -0.15) * 0.6
      THEN sign(r) * (pow(10, -0.15) * 0.6 + pow(10, -0.15) * 0.4 * (1 - pow(1 - (abs(r) - pow(10, -0.15) * 0.6) / (pow(10, -0.15) * 0.4), 2)))
      ELSE r END"""})
per_frame("b9_soft_knee_gain", lambda l, r: {"g": lv.knee_gain_db(lv.amplitude_db_clamped(l), -12.0, 3.0, 6.0)}, {
    "g": """CASE WHEN 20 * log10(greatest(l, 1e-12)) + 12 <= -3 THEN 0 WHEN 20 * log10(greatest(l, 1e-12)) + 12 >= 3
      THEN (1.0 / 3 - 1) * (20 * log10(greatest(l, 1e-12)) + 12)
      ELSE (1.0 / 3 - 1) * pow(20 * log10(greatest(l, 1e-12)) + 15, 2) / 12 END"""})
per_frame("b10_width_scale", lambda l, r: dict(zip(("l2", "r2"), lv.narrow_width(l, r, l, 0.30))), {
    "l2": "(l + r) / 2 + (l - r) / 2 * (1 - least(greatest(l, 0), 0.3))",
    "r2": "(l + r) / 2 - (l - r) / 2 * (1 - least(greatest(l, 0), 0.3))"})
per_frame("b15_loudness_power_share", lambda l, r: {"share": lv.power_share(l * -20, r * 10)}, {"share": "least(pow(10, (l * -20 - r * 10) / 10), 2)"})
per_frame("b17_risk_from_ratio", lambda l, r: {"risk": lv.risk_from_ratio(l, 2.5)}, {"risk": "1 - exp(-l * 2.5)"})
per_frame("b14_quantize", lambda l, r: {"q8": lv.quantize(r * 0.7, 8)}, {
    "q8": "least(greatest(sign(r) * floor(abs(r * 0.7 * 128) + 0.5) / 128, -1), 1 - 1.0 / 128)"})


@query("b5_non_finite_guard", f"""WITH {SIG_LINE},
v AS (SELECT track_id, CASE WHEN frame_ix % 50 = 7 THEN 'NaN'::DOUBLE WHEN frame_ix % 50 = 9 THEN 'Infinity'::DOUBLE ELSE l END AS x FROM sig_line)
SELECT track_id, count(*) FILTER (isnan(x)) AS nan_samples, count(*) FILTER (isinf(x)) AS infinite_samples,
  {rd('sum(x) FILTER (isfinite(x))')} AS finite_sum FROM v GROUP BY 1""")
def b5(spark, sf):
    """Some samples are replaced by NaN and infinity to see that sums skip and counters find them."""
    x = F.when(F.col("frame_ix") % 50 == 7, float("nan")).when(F.col("frame_ix") % 50 == 9, float("inf")).otherwise(F.col("l"))
    v = sig_line(spark, sf).select("track_id", x.alias("x"))
    return rounded(v.groupBy("track_id").agg(
        F.count_if(F.isnan("x")).alias("nan_samples"), F.count_if(F.abs("x") == float("inf")).alias("infinite_samples"),
        F.sum(F.when(lv.is_finite(F.col("x")), F.col("x"))).alias("finite_sum")))


@query("b12_bucket_assessment", """SELECT o_orderkey, CASE WHEN o_totalprice / 5000 >= 85 THEN 'strong' WHEN o_totalprice / 5000 >= 70
  THEN 'generally_balanced' WHEN o_totalprice / 5000 >= 50 THEN 'attention_warranted' ELSE 'high_risk' END AS assessment FROM orders""")
def b12(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", lv.assessment(F.col("o_totalprice") / 5000).alias("assessment"))


@query("b13_dither_tpdf")
def b13(spark, sf):
    s = fr.to_long(sig_line(spark, sf))
    noise = lv.tpdf_noise(16, 11, F.col("track_id"), F.col("ch"), F.col("frame_ix"))
    return rounded(s.select("track_id", "ch", "frame_ix", lv.quantize(F.col("x") + noise, 16).alias("x")), digits=9)


@query("b18_recipe_lookup", """WITH r(recipe, extension, sample_format, rate) AS (VALUES ('studio_master', '.wav', 'pcm24', NULL),
  ('distribution_wav', '.wav', 'pcm24', NULL), ('distribution_flac', '.flac', 'pcm24', NULL), ('cd', '.wav', 'pcm16', 44100),
  ('client_preview', '.mp3', 'compressed', NULL), ('archive_float', '.wav', 'float32', NULL)),
o AS (SELECT o_orderkey, ['studio_master', 'distribution_wav', 'distribution_flac', 'cd', 'client_preview', 'archive_float'][o_custkey % 6 + 1]
      AS recipe FROM orders)
SELECT o_orderkey, recipe, extension, sample_format, CAST(rate AS INTEGER) AS rate FROM o JOIN r USING (recipe)""")
def b18(spark, sf):
    names = F.array(*[F.lit(x[0]) for x in di.RECIPES])
    o = table(spark, sf, "orders").select("o_orderkey", F.get(names, (F.col("o_custkey") % 6).cast("int")).alias("recipe"))
    return o.join(F.broadcast(di.recipes(spark)), "recipe").select("o_orderkey", "recipe", "extension", "sample_format", "rate")


@query("b18_style_preset", f"""WITH s(style, target_lufs, width, punch) AS (VALUES ('balanced', -11.0, 1.0, 0.5), ('transparent', -13.0, 1.0, 0.35),
  ('punchy', -10.5, 1.04, 0.85), ('warm', -11.5, 1.0, 0.45), ('wide', -11.5, 1.14, 0.5), ('loud', -9.0, 1.03, 0.7)),
p AS (SELECT p_partkey, ['balanced', 'transparent', 'punchy', 'warm', 'wide', 'loud'][p_size % 6 + 1] AS style FROM part)
SELECT p_partkey, style, target_lufs::DOUBLE AS target_lufs, width::DOUBLE AS width, punch::DOUBLE AS punch FROM p JOIN s USING (style)""")
def b18_style(spark, sf):
    names = F.array(*[F.lit(x[0]) for x in di.STYLES])
    p = table(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_size") % 6).cast("int")).alias("style"))
    return p.join(F.broadcast(di.styles(spark)), "style").select("p_partkey", "style", "target_lufs", "width", "punch")


@query("b20_time_window_valid", """WITH w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000 - 20 END AS s,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 300 END AS e FROM orders)
SELECT o_orderkey, (s IS NULL AND e IS NULL) OR (s IS NOT NULL AND e IS NOT NULL AND s >= 0 AND e > s) AS valid FROM w""")
def b20(spark, sf):
    o = table(spark, sf, "orders")
    s = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 1000 - 20)
    e = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") % 300).cast("double"))
    return o.select("o_orderkey", lv.time_range_valid(s, e).alias("valid"))


@query("b22_filter_coefficients", f"""WITH b AS (SELECT p_partkey, least(greatest(p_size * 900.0, 10), 0.49 * 48000) AS hz,
    p_retailprice / 500 - 3 AS g FROM part),
w AS (SELECT *, 2 * pi() * hz / 48000 AS w0, pow(10, g / 40) AS a FROM b),
k AS (SELECT *, sin(w0) / 1.8 AS al, cos(w0) AS c FROM w)
SELECT p_partkey, {rd('(1 + al * a) / (1 + al / a)')} AS b0, {rd('-2 * c / (1 + al / a)')} AS b1,
  {rd('(1 - al * a) / (1 + al / a)')} AS b2, {rd('-2 * c / (1 + al / a)')} AS a1, {rd('(1 - al / a) / (1 + al / a)')} AS a2 FROM k""")
def b22(spark, sf):
    from ..functions.coefficients import biquad_coefficients

    p = table(spark, sf, "part").select(
        "p_partkey", F.lit("peak").alias("shape"), (F.col("p_size") * 900.0).alias("frequency_hz"),
        (F.col("p_retailprice") / 500 - 3).alias("gain_db"), F.lit(0.9).alias("q"))
    return rounded(p.select("p_partkey", biquad_coefficients("shape", "frequency_hz", "gain_db", "q", 48000.0).alias("k"))
                   .select("p_partkey", "k.*"))


@query("a4_probe", """SELECT page_id, CASE lower(regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1)) WHEN '.wav' THEN 'wav' ELSE 'unknown' END
    AS url_container,
  ['wav', 'wav', 'aiff', 'flac', 'ogg', 'mp3', 'aac_m4a', 'opus', 'unknown'][page_id % 9 + 1] AS container,
  CASE page_id % 8 WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 3 THEN 'three_zero' WHEN 4 THEN 'quad' WHEN 5 THEN 'five_zero'
    WHEN 6 THEN 'five_one' ELSE 'unknown' END AS layout,
  CAST([16, 24, 32, 0][page_id % 4 + 1] AS INTEGER) AS bit_depth FROM pages""")
def a4(spark, sf):
    from ..sources.wav import probe

    i = F.col("page_id")
    ext = F.get(F.array(*[F.lit(x) for x in (".WAV", ".wave", ".AIF", ".flac", ".ogg", ".Mp3", ".m4a", ".opus", ".txt")]), (i % 9).cast("int"))
    fmt = F.get(F.array(*[F.lit(x) for x in ("pcm16", "pcm24", "pcm32", "float32")]), (i % 4).cast("int"))
    p = probe(F.concat(F.lit("take"), i.cast("string"), ext), i % 8, fmt)
    u = probe(F.col("url"), i % 8, fmt)
    return table(spark, sf, "pages").select("page_id", u["container"].alias("url_container"), *[c.alias(n) for n, c in p.items()])


@query("a11_fingerprint", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents")
def a11(spark, sf):
    size, digest = idn.fingerprint(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", size.alias("size_bytes"), digest.alias("sha256"))


def document_work(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    key = idn.work_key(F.lit(2), F.sha2("text", 256), F.col("source"), F.lit("v1"), F.lit("none"), F.lit("audio=1"),
                       F.array(F.col("lang"), F.lit("drums"), F.col("lang"), F.lit("bass")))
    return d.select("doc_id", key.alias("work_key"))


WORK = """wk AS (SELECT doc_id, sha256('2;' || sha256(text) || ';' || source || ';v1;none;audio=1;' ||
  array_to_string(list_sort(list_distinct([lang, 'drums', 'bass'])), ';')) AS work_key FROM documents)"""


@query("a12_work_key", f"WITH {WORK} SELECT doc_id, work_key FROM wk")
def a12(spark, sf):
    return document_work(spark, sf)


@query("a13_skip_completed", f"""WITH {WORK}, dn AS (SELECT DISTINCT work_key FROM wk WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN work_key IN (SELECT work_key FROM dn) THEN 'reuse' ELSE 'compute' END AS action FROM wk""")
def a13(spark, sf):
    w = document_work(spark, sf)
    done = w.filter(F.col("doc_id") % 3 == 0).select(
        "work_key", F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("complete").alias("status"))
    todo, hits = idn.split_completed(w, done)
    return todo.select("doc_id", F.lit("compute").alias("action")).unionByName(hits.select("doc_id", F.lit("reuse").alias("action")))


@query("u2_distinct_parts", """SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ';') AS roles FROM conversations GROUP BY 1""")
def u2(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r")).select(
        "conv_id", F.array_join(F.array_sort("r"), ";").alias("roles"))


@query("a7_read_study_jsonl", """WITH s AS (SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'alreadyGood must be boolean' WHEN doc_id % 17 = 1 THEN 'unknown preference'
  WHEN doc_id % 17 = 2 THEN 'category must be a non-empty string' ELSE '' END AS errors,
  CASE WHEN doc_id % 17 = 2 THEN NULL ELSE lang END AS category FROM s""")
def a7(spark, sf):
    from ..sources.logs import _typed, check_study_lines

    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    i = F.col("doc_id") % 17
    q = lambda c: F.when(c, "true").otherwise("false")
    line = F.concat(
        F.lit('{"trackId": "t'), F.col("doc_id").cast("string"), F.lit('", '),
        F.when(i == 2, "").otherwise(F.concat(F.lit('"category": "'), F.col("lang"), F.lit('", '))),
        F.lit('"alreadyGood": '), F.when(i == 0, '"yes"').otherwise(q(F.col("quality") == 1)),
        F.lit(', "sourceGuidanceApplied": true, "blindPreference": "'), F.when(i == 1, "maybe").otherwise("tie"),
        F.lit('", "artifactAudible": '), q(F.col("toxic") == 1),
        F.lit(', "transientDamage": false, "monoCompatibilityWorse": false, "stereoImageWorse": false, '
              '"sectionConsistencyWorse": false, "tonalSideEffect": false}'))
    out = _typed(check_study_lines(d.select("doc_id", line.alias("value"))), False)
    return out.select("doc_id", F.array_join("errors", "; ").alias("errors"), "category")
