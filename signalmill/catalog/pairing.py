"""Comparisons, as-of matches, intervals, envelopes, mixing, labels and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import amplitude_db
from ..operators import collections as co
from ..operators import events as evn
from ..operators import frames as fr
from ..operators import pairing as pa
from ..operators import reconstruction as rc
from ..operators.ordering import position
from ..plans import decision as de
from ..plans.dimensions import TAXONOMY, ancestor_closure
from ..sources.adapters import sig_event, sig_line, table
from . import query
from .common import EMBED_MONO, LONG_LINE, SIG_EVENT, SIG_LINE, VECS, rd
from .measure import BLOCK, RATE, rounded


def long_line(spark, sf, reused=False):
    return fr.to_long(sig_line(spark, sf, reused))


def damaged(long):
    """A second version of the series: small errors on some frames, some frames missing."""
    x = F.col("x") + F.when(F.col("frame_ix") % 97 == 50, 0.01).otherwise(0.0)
    return long.filter(F.col("frame_ix") % 211 != 210).withColumn("x", x)


DAMAGED = """dmg AS (SELECT track_id, ch, frame_ix, x + CASE WHEN frame_ix % 97 = 50 THEN 0.01 ELSE 0 END AS x
  FROM long_line WHERE frame_ix % 211 <> 210)"""


@query("j1_compare_series", f"""WITH {LONG_LINE},{DAMAGED},
j AS (SELECT track_id, ch, frame_ix, a.x AS a, b.x AS b FROM long_line a FULL JOIN dmg b USING (track_id, ch, frame_ix))
SELECT track_id, ch, count(a) AS frames_a, count(b) AS frames_b, {rd('max(abs(a - b))')} AS max_difference,
  min(frame_ix) FILTER (a IS NULL OR b IS NULL OR abs(a - b) > 0.001) AS first_bad_frame FROM j GROUP BY ALL""")
def j1(spark, sf):
    x = long_line(spark, sf, True)
    return rounded(pa.compare_series(x, damaged(x), 0.001))


@query("k13_validate_repair", f"""WITH {LONG_LINE},{DAMAGED},
j AS (SELECT track_id, a.x AS o, b.x AS p FROM long_line a FULL JOIN dmg b USING (track_id, ch, frame_ix))
SELECT track_id, count(*) FILTER (o IS NULL OR p IS NULL) = 0 AS same_geometry,
  {rd('20 * log10(max(abs(p)) / max(abs(o)))')} AS peak_delta_db, {rd('sqrt(sum((p - o) * (p - o)) / sum(o * o))')}
  AS relative_residual FROM j GROUP BY 1""")
def k13(spark, sf):
    x = long_line(spark, sf, True)
    return rounded(pa.repair_validation(x, damaged(x)))


@query("j2_mix_sources", f"""WITH {LONG_LINE},
g(role, db) AS (VALUES ('drums', -3.0), ('bass', 2.0), ('vocals', 0.0), ('other', 1.5)),
st(role, k) AS (VALUES ('drums', 0.5), ('bass', 0.25), ('vocals', 0.15), ('other', 0.1)),
m AS (SELECT track_id, ch, frame_ix, x FROM long_line UNION ALL
  SELECT track_id, ch, frame_ix, x * k * (pow(10, db / 20) - 1) FROM long_line, st JOIN g USING (role) WHERE db <> 0)
SELECT track_id, ch, frame_ix, {rd('least(greatest(sum(x), -8), 8)')} AS x FROM m GROUP BY ALL""")
def j2(spark, sf):
    x = long_line(spark, sf, True)
    from ..plans.dimensions import expand

    stems = expand(x, [("drums", 0.5), ("bass", 0.25), ("vocals", 0.15), ("other", 0.1)], ["role", "k"]).withColumn(
        "x", F.col("x") * F.col("k"))
    gains = spark.createDataFrame(
        [("drums", -3.0), ("bass", 2.0), ("vocals", 0.0), ("other", 1.5)], "role string, gain_db double")
    return rounded(pa.mix_sources(x, stems, gains))


def event_level(spark, sf, kind):
    return sig_event(spark, sf).filter(F.col("source") == kind).select(
        "user_id", "t", amplitude_db(F.col("x")).alias("v"))


@query("j3_asof_overlap", f"""WITH {SIG_EVENT},
a AS (SELECT user_id, t, 20 * log10(x) AS v FROM sig_event WHERE source = 'click'),
b AS (SELECT user_id, t, 20 * log10(x) AS v FROM sig_event WHERE source = 'view'),
n AS (SELECT a.user_id, a.t, a.v, b.v AS ov FROM a JOIN b USING (user_id)
      QUALIFY row_number() OVER (PARTITION BY a.user_id, a.t ORDER BY abs(b.t - a.t), b.t DESC) = 1
        AND abs(b.t - a.t) <= 43200),
la AS (SELECT user_id, greatest(-60, max(v) - 18) AS la FROM a GROUP BY 1),
lb AS (SELECT user_id, greatest(-60, max(v) - 18) AS lb FROM b GROUP BY 1),
g AS (SELECT user_id, count(*) AS matched, count(*) FILTER (v >= la) AS a_active, count(*) FILTER (ov >= lb) AS b_active,
        count(*) FILTER (v >= la AND ov >= lb) AS both_active FROM n JOIN la USING (user_id) JOIN lb USING (user_id) GROUP BY 1)
SELECT *, {rd('CASE WHEN least(a_active, b_active) > 0 THEN both_active / least(a_active, b_active) ELSE 0 END')} AS overlap FROM g""")
def j3(spark, sf):
    return rounded(pa.activity_overlap(
        event_level(spark, sf, "click"), event_level(spark, sf, "view"), ["user_id"], 43200.0, 86400.0))


ENVELOPE_CTE = LONG_LINE + """,
hp AS (SELECT track_id, frame_ix // 16 AS hop_ix, sqrt(avg(x * x)) AS rms FROM long_line GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY rms) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n
       FROM hp WHERE rms > 1e-12),
rf AS (SELECT track_id, rms AS ref FROM rk WHERE i = floor(0.95 * (n - 1) + 0.5)),
env AS (SELECT track_id, hop_ix, rms, CASE WHEN ref IS NOT NULL AND rms > 1e-12
          THEN least(greatest((20 * log10(greatest(rms / ref, 1e-12)) + 60) / 60, 0), 1) ELSE 0 END AS activity
        FROM hp LEFT JOIN rf USING (track_id))"""


@query("d33_activity_envelope", f"""WITH {ENVELOPE_CTE}
SELECT track_id, hop_ix, {rd('rms')} AS rms, {rd('activity')} AS activity FROM env""")
def d33(spark, sf):
    return rounded(pa.activity_envelope(long_line(spark, sf), 16))


@query("j4_interp_lookup", f"""WITH {ENVELOPE_CTE},
nx AS (SELECT *, coalesce(lead(activity) OVER (PARTITION BY track_id ORDER BY hop_ix), activity) AS nxt FROM env)
SELECT track_id, frame_ix, {rd('activity + (nxt - activity) * (frame_ix % 16) / 16.0')} AS activity
FROM sig_line JOIN nx USING (track_id) WHERE hop_ix = frame_ix // 16""")
def j4(spark, sf):
    f = sig_line(spark, sf, reused=True)
    env = pa.activity_envelope(fr.to_long(f), 16)
    return rounded(pa.interpolate_activity(f.select("track_id", "frame_ix"), env, 16, 32))


def interventions(spark, sf):
    """Fifteen customers for each series: as many as there are per supplier, at any size of the tables."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    start = F.when(k % 11 != 0, (k % 7) * 0.4 + 0.003)
    return c.select(
        "c_custkey", F.expr("(c_custkey + 14) div 15").alias("track_id"), F.col("c_mktsegment").alias("source"), start.alias("start_s"),
        (start + 0.25 + (k % 3) * 0.5).alias("end_s"), (F.col("c_acctbal") / 10000).alias("amount"))


INTERVENTIONS = """iv AS (SELECT c_custkey, (c_custkey + 14) // 15 AS track_id, c_mktsegment AS source,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 7) * 0.4::DOUBLE + 0.003::DOUBLE END AS start_s, c_acctbal / 10000 AS amount FROM customer),
iv2 AS (SELECT *, start_s + 0.25::DOUBLE + (c_custkey % 3) * 0.5::DOUBLE AS end_s FROM iv)"""


@query("j5_interval_apply", f"""WITH {SIG_LINE},{INTERVENTIONS}
SELECT s.track_id, s.frame_ix, {rd('coalesce(sum(amount), 0)', 8)} AS amount
FROM sig_line s LEFT JOIN iv2 ON s.track_id = iv2.track_id
  AND (start_s IS NULL OR (s.frame_ix / 100.0::DOUBLE >= start_s AND s.frame_ix / 100.0::DOUBLE < end_s)) GROUP BY ALL""")
def j5(spark, sf):
    f = sig_line(spark, sf, reused=True).select("track_id", "frame_ix")
    return rounded(pa.interval_amounts(f, interventions(spark, sf), RATE, 0.5), digits=8)


def envelope_list(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    seg = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "none")])
    return p.select(
        F.expr("(p_partkey + 19) div 20").alias("track_id"), F.get(seg, (F.col("p_size") % 6).cast("int")).alias("source"),
        (F.col("p_retailprice") / 5000).alias("confidence"), F.col("p_partkey").alias("seq"))


@query("j6_bind_best", f"""WITH {INTERVENTIONS},
en AS (SELECT (p_partkey + 19) // 20 AS track_id, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'none'][p_size % 6 + 1]
         AS source, p_retailprice / 5000 AS confidence, p_partkey AS seq FROM part),
be AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY track_id, source ORDER BY confidence DESC, seq) = 1)
SELECT c_custkey, {rd('confidence')} AS envelope_confidence, seq AS envelope_seq,
  CASE WHEN seq IS NULL THEN 'no matching envelope' END AS reason FROM iv2 LEFT JOIN be USING (track_id, source)""")
def j6(spark, sf):
    bound, skipped = pa.bind_best(interventions(spark, sf), envelope_list(spark, sf))
    out = bound.select("c_custkey", "envelope_confidence", "envelope_seq").unionByName(
        skipped.select("c_custkey", "reason"), allowMissingColumns=True)
    return rounded(out)


def activities(spark, sf):
    """Per user and event type: measured activity of one source."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return e.groupBy(F.col("user_id").alias("track_id"), F.col("event_type").alias("taxonomy_id")).agg(
        F.least(F.lit(1.0), 0.6 + F.count(F.lit(1)) / 50).alias("confidence"), (F.avg("value") / 100).alias("low_band_energy"),
        F.avg("k").alias("fundamental_hz"), F.least(F.lit(1.0), F.max("value") / 300).alias("transient_strength"),
        F.least(F.lit(1.0), F.stddev_pop("k") / 40).alias("stereo_width"),
        F.least(F.lit(1.0), F.min("k") / 25).alias("phase_coherence"),
        F.sum("value").alias("active_seconds"), (F.sum("k") / 3).alias("overlap_seconds"))


ACTIVITIES = """act AS (SELECT user_id AS track_id, event_type AS taxonomy_id, least(1.0, 0.6 + count(*) / 50) AS confidence,
  avg(value) / 100 AS low_band_energy, avg(k) AS fundamental_hz, least(1.0, max(value) / 300) AS transient_strength,
  least(1.0, stddev_pop(k) / 40) AS stereo_width, least(1.0, min(k) / 25) AS phase_coherence, sum(value) AS active_seconds,
  sum(k) / 3 AS overlap_seconds
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY ALL)"""
PAIRS_CTE = ACTIVITIES + """,
pr0 AS (SELECT a.track_id, a.taxonomy_id AS first_id, b.taxonomy_id AS second_id, least(a.confidence, b.confidence) AS confidence,
    least(greatest(least(a.overlap_seconds, b.overlap_seconds) / greatest(0.001, least(a.active_seconds, b.active_seconds)), 0), 1) AS t_ov,
    least(greatest(least(a.low_band_energy, b.low_band_energy) / greatest(0.001, greatest(a.low_band_energy, b.low_band_energy))
      * CASE WHEN abs(a.fundamental_hz - b.fundamental_hz) < 35 THEN 1.0 ELSE 0.55 END, 0), 1) AS s_ov,
    least(greatest(1 - least(a.phase_coherence, b.phase_coherence), 0), 1) AS phase_risk,
    least(a.transient_strength, b.transient_strength) AS tl, greatest(a.stereo_width, b.stereo_width) AS w,
    a.transient_strength + b.transient_strength AS ts
  FROM act a JOIN act b ON a.track_id = b.track_id AND a.taxonomy_id < b.taxonomy_id),
pairs AS (SELECT *, t_ov * s_ov AS low_band_masking, least(t_ov * tl, 1) AS onset_masking,
    least(phase_risk * w, 1) AS mono_survival_risk, least(t_ov * s_ov * ts * 0.5, 1) AS limiter_contribution FROM pr0)"""


@query("j7_pairwise_interaction", f"""WITH {PAIRS_CTE}
SELECT track_id, first_id, second_id, {rd('confidence')} AS confidence, {rd('t_ov')} AS temporal_overlap,
  {rd('s_ov')} AS spectral_overlap, {rd('phase_risk')} AS phase_risk, {rd('low_band_masking')} AS low_band_masking,
  {rd('onset_masking')} AS onset_masking, {rd('mono_survival_risk')} AS mono_survival_risk,
  {rd('limiter_contribution')} AS limiter_contribution FROM pairs""")
def j7(spark, sf):
    return rounded(pa.pairwise_interactions(activities(spark, sf)))


@query("r3_plan_bounded_repairs", f"""WITH {PAIRS_CTE},
r AS (
  SELECT track_id, first_id, second_id, 'dynamic_low_band_attenuation' AS action, least(2.0, low_band_masking * 3) AS amount
  FROM pairs WHERE confidence >= 0.7 AND low_band_masking > 0.42
  UNION ALL SELECT track_id, first_id, second_id, 'transient_sidechain_control', least(0.35, onset_masking * 0.4)
  FROM pairs WHERE confidence >= 0.7 AND onset_masking > 0.5
  UNION ALL SELECT track_id, first_id, second_id, 'low_band_mono_stabilization', least(0.3, mono_survival_risk * 0.5)
  FROM pairs WHERE confidence >= 0.7 AND mono_survival_risk > 0.32)
SELECT track_id, first_id, second_id, action, {rd('amount')} AS amount FROM r""")
def r3(spark, sf):
    return rounded(de.plan_bounded_repairs(pa.pairwise_interactions(activities(spark, sf))))


TREE = "tree(id, parent, role, minimum) AS (VALUES " + ", ".join(
    f"('{i}', '{p}', '{r}', {m}::DOUBLE)" for i, p, r, m in TAXONOMY) + ")"
LABELS = [t[0] for t in TAXONOMY[1:]]


def segment_scores(spark, sf):
    """Vector components 0..23 as scores of the 24 labels: ``segment_id, label, confidence``."""
    names = F.array(*[F.lit(x) for x in LABELS])
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("segment_id"), F.posexplode(F.slice("embedding", 1, len(LABELS))).alias("i", "v")
    ).select("segment_id", F.get(names, F.col("i")).alias("label"), F.abs(F.col("v").cast("double") * 3).alias("confidence"), "i")


SCORES = f"""sco AS (SELECT vec_id AS segment_id, {LABELS!r}[i + 1] AS label, abs(CAST(embedding[i + 1] AS DOUBLE) * 3) AS confidence, i
  FROM embeddings, (SELECT unnest(range({len(LABELS)})) AS i))"""
BEST = "bst AS (SELECT * FROM sco QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY confidence DESC, i) = 1)"


@query("t5_argmax_score", f"""WITH {SCORES},{BEST}
SELECT segment_id, label, {rd('confidence')} AS confidence FROM bst""")
def t5(spark, sf):
    return rounded(evn.best_label(segment_scores(spark, sf)))


@query("j10_taxonomy_backoff", f"""WITH RECURSIVE {SCORES},{BEST},{TREE},
up AS (SELECT segment_id, label AS node, least(confidence, 1) AS c FROM bst
  UNION ALL SELECT segment_id, t.parent, c FROM up JOIN tree t ON t.id = up.node WHERE c < t.minimum),
fin AS (SELECT segment_id, node, c, t.role FROM up JOIN tree t ON t.id = up.node WHERE c >= t.minimum)
SELECT segment_id, node AS label, role, {rd("CASE WHEN node = 'unknown' THEN 0 ELSE c END")} AS confidence FROM fin""")
def j10(spark, sf):
    return rounded(evn.taxonomy_backoff(segment_scores(spark, sf), ancestor_closure(spark)))


def labelled_events(spark, sf):
    e = sig_event(spark, sf)
    e = position(e, ["user_id"], [F.to_date("ts")], [F.col("ts"), F.col("event_id")], "seq")
    return e.select(
        F.col("user_id").alias("track_id"), "seq", F.when(F.col("source") == "error", "unknown").otherwise(F.col("source")).alias("label"),
        F.col("t").alias("start_s"), (F.col("t") + (F.col("x") * 500 - 2) * 3000).alias("end_s"), F.col("x").alias("confidence"))


LABELLED = SIG_EVENT + """,
le AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         CASE WHEN source = 'error' THEN 'unknown' ELSE source END AS label, t AS start_s, t + (x * 500 - 2) * 3000 AS end_s,
         x AS confidence FROM sig_event)"""


@query("e11_merge_events", f"""WITH {LABELLED},
ok AS (SELECT * FROM le WHERE end_s >= start_s),
c AS (SELECT *, CASE WHEN lag(label) OVER w = label AND label <> 'unknown' THEN 0 ELSE 1 END AS chg FROM ok
      WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
g AS (SELECT *, sum(chg) OVER (PARTITION BY track_id ORDER BY seq) AS run FROM c),
m AS (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY track_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING) + 20000 THEN 0 ELSE 1 END AS brk FROM g),
s AS (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY seq) AS grp FROM m)
SELECT track_id, min(label) AS label, {rd('min(start_s)', 3)} AS start_s, {rd('max(end_s)', 3)} AS end_s,
  {rd('max(confidence)')} AS confidence, count(*) AS merged FROM s GROUP BY track_id, grp""")
def e11(spark, sf):
    out = co.merge_events(labelled_events(spark, sf), 20000.0, 1024)
    return rounded(out.withColumns({"start_s": F.round("start_s", 3), "end_s": F.round("end_s", 3)}), "start_s", "end_s")


@query("d38_kick_regularity", f"""WITH {SIG_EVENT},
k AS (SELECT user_id, source, count(*) AS n, (max(t) - min(t)) / 3600 AS d FROM sig_event GROUP BY ALL),
b AS (SELECT *, CASE WHEN n > 1 AND d > 0.5 AND d / (n - 1) > 0.1 THEN 60 / (d / (n - 1)) END AS raw FROM k)
SELECT user_id, source, n AS picks, {rd('''CASE WHEN raw IS NULL THEN 0 WHEN raw < 70 THEN raw * pow(2, ceil(log2(70 / raw)))
  WHEN raw > 180 THEN raw / pow(2, ceil(log2(raw / 180))) ELSE raw END''', 4)} AS bpm FROM b""")
def d38(spark, sf):
    picks = sig_event(spark, sf).select("user_id", "source", (F.col("t") / 3600).alias("time_s"))
    return rounded(evn.pick_regularity(picks, ["user_id", "source"]), digits=4)


@query("k12_match_gains", f"""WITH v AS (SELECT o_custkey AS album_id, o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED'
    THEN -80.0 ELSE -30 + o_totalprice / 20000 END AS lufs FROM orders)
SELECT album_id, o_orderkey, {rd('min(lufs) OVER (PARTITION BY album_id) - lufs', 8)} AS gain_db FROM v""")
def k12(spark, sf):
    o = table(spark, sf, "orders")
    lufs = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(float("-inf"))).otherwise(-30 + F.col("o_totalprice") / 20000)
    t = o.select(F.col("o_custkey").alias("album_id"), "o_orderkey", lufs.alias("lufs"))
    return rounded(de.match_gains(t, "album_id").select("album_id", "o_orderkey", "gain_db"), digits=8)


RECON = LONG_LINE + """,
rr AS (SELECT track_id, ch, frame_ix, x AS o, x * 0.9 + 0.02 * (frame_ix % 5) AS p FROM long_line),
dd AS (SELECT *, o - lag(o) OVER w AS o1, p - lag(p) OVER w AS p1, o - 2 * lag(o) OVER w + lag(o, 2) OVER w AS o2,
         p - 2 * lag(p) OVER w + lag(p, 2) OVER w AS p2 FROM rr WINDOW w AS (PARTITION BY track_id, ch ORDER BY frame_ix)),
rm AS (SELECT track_id, sqrt(sum((o - p) * (o - p)) / sum(o * o)) AS residual,
    sqrt(sum((o1 - p1) * (o1 - p1)) / sum(o1 * o1)) AS transient, sqrt(sum((o2 - p2) * (o2 - p2)) / sum(o2 * o2)) AS hf,
    sum(o * p) / sqrt(sum(o * o) * sum(p * p)) AS corr, (max(frame_ix) + 1) / 100.0 AS secs FROM dd GROUP BY 1)"""


def reconstruction(spark, sf):
    x = long_line(spark, sf)
    pairs = x.withColumnRenamed("x", "o").withColumn("p", F.col("o") * 0.9 + F.lit(0.02) * (F.col("frame_ix") % 5))
    return rc.reconstruction_metrics(pairs, RATE, BLOCK)


@query("d31_reconstruction_metrics", f"""WITH {RECON}
SELECT track_id, {rd('residual')} AS residual_ratio, {rd('transient')} AS transient_ratio, {rd('hf')} AS hf_ratio,
  {rd('least(greatest(corr, -1), 1)')} AS correlation, {rd('0.55 + 0.35 * least(1, secs / 30)')} AS confidence FROM rm""")
def d31(spark, sf):
    return rounded(reconstruction(spark, sf))


@query("e8_rolling_energy", f"""WITH {SIG_LINE},
h AS (SELECT track_id, frame_ix // 10 AS hop_ix, sum(l * l + r * r) AS e, count(*) AS n FROM sig_line GROUP BY ALL)
SELECT track_id, hop_ix, {rd('sum(e) OVER w / sum(n) OVER w', 9)} AS energy FROM h
WINDOW w AS (PARTITION BY track_id ORDER BY hop_ix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def e8(spark, sf):
    from ..operators.loudness import rolling_energy

    f = sig_line(spark, sf).withColumn("_e", F.col("l") * F.col("l") + F.col("r") * F.col("r"))
    h = f.groupBy("track_id", F.floor(F.col("frame_ix") / 10).cast("bigint").alias("hop_ix")).agg(
        F.sum("_e").alias("e"), F.count(F.lit(1)).alias("n"))
    return rounded(rolling_energy(h, 3, "energy", 16).select("track_id", "hop_ix", "energy"), digits=9)


@query("a2_scan_blocks", f"""WITH {SIG_LINE} SELECT track_id, frame_ix // 64 AS block_ix, count(*) AS n, {rd('sum(l)')} AS total
FROM sig_line WHERE frame_ix // 64 BETWEEN 1 AND 3 GROUP BY ALL""")
def a2(spark, sf):
    """A range of stored blocks: the comparison reaches the files."""
    from ..operators.scans import to_blocks
    from ..session import cut_lineage

    stored = cut_lineage(to_blocks(sig_line(spark, sf), ["track_id"], "frame_ix", ["l"], 64))
    b = fr.scan_blocks(stored, 1, 3)
    return rounded(b.select("track_id", "block_ix", F.size("l").cast("bigint").alias("n"),
                            F.aggregate("l", F.lit(0.0), lambda a, v: a + v).alias("total")))


@query("a3_interleave", f"""WITH {LONG_LINE} SELECT track_id, ch, frame_ix, {rd('x')} AS x FROM long_line""")
def a3(spark, sf):
    return rounded(fr.deinterleave(fr.interleave(sig_line(spark, sf), 64), 64))


@query("j17_with_halo", f"""WITH {LONG_LINE},
b AS (SELECT track_id, frame_ix // 32 AS block_ix, frame_ix % 32 AS i, x FROM long_line WHERE ch = 0),
bl AS (SELECT track_id, block_ix, count(*) AS n, max(i) AS last_i FROM b GROUP BY ALL),
h AS (SELECT track_id, block_ix + 1 AS block_ix, sum(x) AS s, count(*) AS c FROM b JOIN bl USING (track_id, block_ix)
      WHERE i > last_i - 3 GROUP BY ALL),
t AS (SELECT track_id, block_ix - 1 AS block_ix, sum(x) AS s, count(*) AS c FROM b WHERE i < 5 GROUP BY ALL)
SELECT bl.track_id, bl.block_ix, coalesce(h.c, 0) AS head_n, coalesce(t.c, 0) AS tail_n, {rd('coalesce(h.s, 0)')} AS head_sum,
  {rd('coalesce(t.s, 0)')} AS tail_sum FROM bl LEFT JOIN h USING (track_id, block_ix) LEFT JOIN t USING (track_id, block_ix)""")
def j17(spark, sf):
    from ..operators.scans import to_blocks

    b = to_blocks(sig_line(spark, sf).select("track_id", "frame_ix", F.col("l").alias("x")), ["track_id"], "frame_ix", ["x"], 32)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(fr.block_halos(b, ["track_id"], 3, 5).select(
        "track_id", "block_ix", F.size("head").cast("bigint").alias("head_n"), F.size("tail").cast("bigint").alias("tail_n"),
        add("head").alias("head_sum"), add("tail").alias("tail_sum")))


@query("j18_overlap_add", f"""WITH {LONG_LINE},
s AS (SELECT track_id, ch, frame_ix, x, max(frame_ix) OVER (PARTITION BY track_id, ch) AS last FROM long_line),
ck AS (SELECT track_id, ch, frame_ix, c, frame_ix - c * 24 AS pos, x, last // 24 AS lc
       FROM s, (SELECT unnest(range(100000)) AS c) WHERE false
       UNION ALL SELECT track_id, ch, frame_ix, frame_ix // 24 AS c, frame_ix % 24 AS pos, x, last // 24 AS lc FROM s
       UNION ALL SELECT track_id, ch, frame_ix, frame_ix // 24 - 1, frame_ix % 24 + 24, x, last // 24 FROM s
         WHERE frame_ix >= 24 AND frame_ix % 24 < 8),
y AS (SELECT track_id, ch, frame_ix, x * (1 + 0.1 * (c % 3))
    * CASE WHEN c > 0 AND pos < 8 THEN pos / 7.0 ELSE 1 END
    * CASE WHEN pos >= 24 AND c < lc THEN 1 - (pos - 24) / 7.0 ELSE 1 END AS v FROM ck)
SELECT track_id, ch, frame_ix, {rd('sum(v)')} AS x FROM y GROUP BY ALL""")
def j18(spark, sf):
    # the per-chunk work stands for a model: each chunk gets its own gain
    ck = fr.cut_chunks(long_line(spark, sf), 32, 8).withColumn("x", F.col("x") * (1 + F.lit(0.1) * (F.col("chunk_ix") % 3)))
    return rounded(fr.overlap_add(ck, 32, 8))
