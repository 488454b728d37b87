"""Album, preference, retention, revision, study and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collections as co
from ..operators import study as sy
from ..operators.ordering import position
from ..sources.adapters import album_tracks, inventory, study_records, table
from . import query
from .common import ALB, STUDY, rd
from .measure import rounded

STATS_CTE = ALB + """,
st AS (SELECT album_id, count(*) AS track_count, min(i) AS min_lufs, max(i) AS max_lufs, avg(i) AS mean_lufs,
         var_pop(i) AS lufs_variance, list_sort(list(i) FILTER (i IS NOT NULL))[count(i) // 2 + 1] AS median_lufs,
         max(i) - min(i) AS span_lu
       FROM (SELECT album_id, CASE WHEN input_lufs > -70 THEN input_lufs END AS i FROM alb) GROUP BY 1)"""


@query("d25_collection_stats", f"""WITH {STATS_CTE}
SELECT album_id, track_count, {rd('min_lufs', 8)} AS min_lufs, {rd('max_lufs', 8)} AS max_lufs, {rd('mean_lufs', 11)} AS mean_lufs,
  {rd('lufs_variance', 8)} AS lufs_variance, {rd('median_lufs', 8)} AS median_lufs, {rd('span_lu', 8)} AS span_lu FROM st""")
def d25(spark, sf):
    out = co.collection_stats(album_tracks(spark, sf))
    return rounded(out.withColumn("mean_lufs", F.round("mean_lufs", 11)), "mean_lufs", digits=8)


@query("e13_track_transitions", f"""WITH {ALB},
lv AS (SELECT album_id, track_index, CASE WHEN master_lufs > -70 THEN master_lufs ELSE input_lufs END AS v FROM alb),
n AS (SELECT *, lead(v) OVER (PARTITION BY album_id ORDER BY track_index) - v AS j FROM lv)
SELECT album_id, track_index AS from_track, track_index + 1 AS to_track, {rd('j', 8)} AS jump_lu,
  abs(j) > 3.5 AS jump_warning, CAST(2.0 AS DOUBLE) AS gap_s FROM n WHERE j IS NOT NULL""")
def e13(spark, sf):
    return rounded(co.transitions(album_tracks(spark, sf)), digits=8)


@query("e14_cohesion_plan", f"""WITH {STATS_CTE},
p AS (SELECT alb.*, CASE WHEN input_lufs <= -70 THEN 0.0
        ELSE least(greatest((input_lufs - coalesce(median_lufs, -14)) * 0.5, -2.5), 2.5) END AS o
      FROM alb JOIN st USING (album_id))
SELECT album_id, track_index, {rd('o - 14', 8)} AS target_lufs, {rd('o', 8)} AS offset_lu,
  CASE WHEN input_lufs <= -70 THEN 'album default' WHEN abs(o) < 0.2 THEN 'kept at album baseline'
    WHEN o > 0 THEN 'louder than album by ' || substr(printf('%.6f', o), 1, 3) || ' LU'
    ELSE 'softer than album by ' || substr(printf('%.6f', o), 1, 4) || ' LU' END AS explanation FROM p""")
def e14(spark, sf):
    t = album_tracks(spark, sf)
    return rounded(co.cohesion_plan(t, co.collection_stats(t)), digits=8)


@query("a10_album_report", f"""WITH {ALB}
SELECT album_id, track_index, printf('| %d | %s | %.1f | %.1f | %.1f | %s |', track_index + 1, title,
  input_lufs, master_lufs, master_true_peak, status) AS line FROM alb""")
def a10(spark, sf):
    return co.album_report(album_tracks(spark, sf))


@query("a10_album_manifest")
def a10_manifest(spark, sf):
    return co.album_manifest(album_tracks(spark, sf))


def preference_events(spark, sf):
    """Events as a preference log: profile = event type, deltas from the value and the parsed properties."""
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", "value", "props")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    d = (F.col("value") - 50.0) / 25.0
    e = position(e, ["event_type"], [F.to_date("ts"), F.hour("ts"), F.minute("ts")], [F.col("ts"), F.col("event_id")], "seq")
    return e.select(
        F.col("event_type").alias("profile_name"), "event_id", "seq", d.alias("delta_lufs"),
        (k / 25 - 2).alias("delta_brightness"), (d * 1.5).alias("delta_bass"), (k / 100 - 0.5).alias("delta_width"),
        (d / 4).alias("delta_saturation"), F.lit(0.1).alias("delta_punch"))


PREF_CTE = """pe AS (
  SELECT event_type AS profile_name, event_id,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq,
    count(*) OVER (PARTITION BY event_type) AS n, (value - 50.0) / 25 AS d,
    coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events),
pw AS (SELECT *, pow(1.02, seq - n + 1) AS w FROM pe)"""


@query("d26_preference_vector", f"""WITH {PREF_CTE},
s AS (SELECT profile_name, count(*) AS event_count, 0.25 / sum(w) AS sc, sum(d * w) AS a, sum((k / 25 - 2) * w) AS b,
        sum((k / 100 - 0.5) * w) AS wd, sum(0.1 * w) AS pu FROM pw GROUP BY 1)
SELECT profile_name, event_count, {rd('least(greatest(a * sc, -2), 2)')} AS lufs_bias,
  {rd('least(greatest(b * sc, -3), 3)')} AS brightness_bias, {rd('least(greatest(a * 1.5 * sc, -3), 3)')} AS bass_bias,
  {rd('least(greatest(a / 4 * sc, -0.5), 0.5)')} AS saturation_bias, {rd('least(greatest(pu * sc, -0.5), 0.5)')} AS punch_bias,
  {rd('least(greatest(1 + wd * sc, 0.8), 1.25)')} AS width_scale FROM s""")
def d26(spark, sf):
    return rounded(co.preference_vector(co.preference_sums(preference_events(spark, sf))))


@query("b21_parse_event_json", """SELECT event_id,
  coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k,
  coalesce(CAST(json_extract_string(props, '$.absent') AS DOUBLE), 0.0) AS absent FROM events""")
def b21(spark, sf):
    from ..sources.logs import json_number

    return table(spark, sf, "events").select(
        "event_id", json_number("props", "k").alias("k"), json_number("props", "absent").alias("absent"))


@query("d27_aggregate_profiles", f"""SELECT l_returnflag AS profile, count(*) AS reference_count,
  {rd('avg(-l_quantity)')} AS integrated_lufs, {rd('avg(-l_tax)')} AS true_peak_dbtp,
  {rd('avg(l_discount * 100)')} AS bass_db, {rd('avg(l_extendedprice / 10000)', 4)} AS presence_db FROM lineitem GROUP BY 1""")
def d27(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("profile"), (-F.col("l_quantity")).alias("integrated_lufs"),
        (-F.col("l_tax")).alias("true_peak_dbtp"), (F.col("l_discount") * 100).alias("bass_db"),
        (F.col("l_extendedprice") / 10000).alias("presence_db"))
    out = co.aggregate_profiles(li, "profile")
    return rounded(out.withColumn("presence_db", F.round("presence_db", 4)), "presence_db")


@query("e15_retention_plan", """WITH inv AS (SELECT doc_id AS item_id, n_chars AS size_bytes, doc_id AS modified_ms,
  lang = 'de' AS owned FROM documents),
t AS (SELECT sum(size_bytes) AS total FROM inv),
c AS (SELECT *, sum(size_bytes) OVER (ORDER BY modified_ms, item_id) AS cum FROM inv WHERE NOT owned)
SELECT item_id, size_bytes, modified_ms, total - (cum - size_bytes) > 400000 AS remove,
  CAST(CASE WHEN total - (cum - size_bytes) > 400000 THEN total - cum END AS BIGINT) AS bytes_after FROM c, t""")
def e15(spark, sf):
    return co.retention_plan(inventory(spark, sf), 400_000, *[F.shiftright("modified_ms", k) for k in (28, 18, 7)])


def order_revisions(spark, sf):
    """Orders as revision chains: project = customer, parent = the customer's order before."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    o = position(o, ["o_custkey"], [F.trunc(F.col("o_orderdate").cast("date"), "month")],
                 [F.col("o_orderdate"), F.col("o_orderkey")], "pos")
    o = o.select(F.col("o_custkey").alias("project_id"), "pos", F.col("o_orderkey").alias("id"),
                 F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"),
                 F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("summary"))
    parent = o.select("project_id", (F.col("pos") + 1).alias("pos"), F.col("id").alias("parent_id"))
    return o.join(parent, ["project_id", "pos"], "left")


@query("e16_latest_revision", """SELECT o_custkey AS project_id, count(*) OVER (PARTITION BY o_custkey) AS revisions,
  epoch_ms(o_orderdate) AS ts_ms, o_orderkey AS id, o_orderstatus AS kind, o_orderpriority AS summary FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def e16(spark, sf):
    return co.latest_revision(order_revisions(spark, sf))


@query("e16_head_of_chain", """SELECT o_custkey AS project_id, o_orderkey AS id FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def e16_head(spark, sf):
    return co.head_of_chain(order_revisions(spark, sf)).select("project_id", "id")


@query("e16_history_conflicts", """WITH h AS (SELECT o_custkey AS project_id, o_orderkey AS id, o_orderstatus AS s,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders),
b AS (SELECT project_id, pos, CASE WHEN project_id % 5 = 0 AND pos = 2 THEN -id ELSE id END AS id FROM h
      WHERE NOT (project_id % 3 = 0 AND pos > 3)),
j AS (SELECT project_id, h.id AS a_id, b.id AS b_id FROM h FULL JOIN b USING (project_id, pos)),
c AS (SELECT project_id, count(a_id) AS a_len, count(b_id) AS b_len, count(*) FILTER (a_id <> b_id) AS mismatches
      FROM j GROUP BY 1)
SELECT *, CASE WHEN mismatches > 0 THEN 'conflict' WHEN a_len = b_len THEN 'same' WHEN a_len < b_len THEN 'a_behind'
  ELSE 'b_behind' END AS verdict FROM c""")
def e16_conflicts(spark, sf):
    a = order_revisions(spark, sf)
    # the second copy of each history: some are shorter, some differ in one revision
    edited = F.when((F.col("project_id") % 5 == 0) & (F.col("pos") == 2), -F.col("id")).otherwise(F.col("id"))
    b = a.filter(~((F.col("project_id") % 3 == 0) & (F.col("pos") > 3))).withColumn("id", edited)
    return co.history_conflicts(a, b)


@query("t4_list_recent", """SELECT o_orderkey AS project_id, epoch_ms(o_orderdate) AS updated_ms FROM orders
ORDER BY updated_ms DESC, project_id LIMIT 25""")
def t4(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_ms"))
    return co.list_recent(o, 25)


# --- listening study ---------------------------------------------------------------------------
METRICS_CTE = STUDY + """,
f AS (SELECT category, guidance_applied AS applied, guidance_applied AND already_good AS good,
        guidance_applied AND NOT already_good AS target, preference,
        artifact_audible OR transient_damage OR mono_worse OR image_worse OR sections_worse OR tonal_side_effect AS dmg,
        artifact_audible FROM study),
m AS (SELECT category, CAST(grouping(category) AS INTEGER) AS is_total, count(*) AS records,
    count(*) FILTER (applied) AS applied_count, count(*) FILTER (good) AS good_count,
    count(*) FILTER (target) AS target_count, count(*) FILTER (applied AND dmg) AS damaged_count,
    count(*) FILTER (good AND dmg) AS good_damaged_count, count(*) FILTER (applied AND artifact_audible) AS artifact_count,
    count(*) FILTER (target AND preference = 'guided') AS win_count,
    count(*) FILTER (target AND preference = 'stereo') AS loss_count
  FROM f GROUP BY GROUPING SETS ((category), ()))"""


def _wilson(name: str, k: str, n: str) -> str:
    p, z = f"({k} / nullif({n}, 0))", "1.959963984540054"
    z2 = f"({z} * {z})"
    c = f"(({p} + {z2} / (2.0 * {n})) / (1 + {z2} / {n}))"
    s = f"({z} * sqrt(({p} * (1 - {p}) + {z2} / (4.0 * {n})) / {n}) / (1 + {z2} / {n}))"
    lo, hi = (f"CASE WHEN {n} > 0 THEN greatest(0.0, {c} - {s}) END", f"CASE WHEN {n} > 0 THEN least(1.0, {c} + {s}) END")
    return f"{rd(p)} AS {name}_rate, {rd(lo)} AS {name}_low, {rd(hi)} AS {name}_high"


@query("d35_study_metrics", f"""WITH {METRICS_CTE} SELECT *, {_wilson('good_damage', 'good_damaged_count', 'good_count')},
  {_wilson('artifact', 'artifact_count', 'applied_count')}, {_wilson('win', 'win_count', 'target_count')},
  {_wilson('loss', 'loss_count', 'target_count')} FROM m""")
def d35(spark, sf):
    return rounded(sy.study_metrics(study_records(spark, sf)))


@query("b16_wilson_interval", f"""WITH c AS (SELECT l_suppkey AS track_id, count(*) FILTER (l_returnflag = 'R') AS k,
  count(*) AS n FROM lineitem GROUP BY 1) SELECT track_id, {_wilson('returned', 'k', 'n')} FROM c""")
def b16(spark, sf):
    from ..functions.levels import wilson_bounds

    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("track_id")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson_bounds(F.col("k"), F.col("n"))
    return rounded(c.select("track_id", (F.col("k") / F.col("n")).alias("returned_rate"),
                            lo.alias("returned_low"), hi.alias("returned_high")))


@query("d36_policy_gate", f"""WITH {METRICS_CTE},
g AS (SELECT category, is_total, good_count >= 20 AS enough_good, target_count >= 20 AS enough_target,
  coalesce(good_damaged_count / nullif(good_count, 0) <= 0.5, false) AS good_damage_ok,
  coalesce(artifact_count / nullif(applied_count, 0) <= 0.3, false) AS artifact_ok,
  coalesce(win_count / nullif(target_count, 0) >= 0.3, false) AS win_ok,
  coalesce(loss_count / nullif(target_count, 0) <= 0.4, false) AS loss_ok FROM m)
SELECT *, enough_good AND enough_target AND good_damage_ok AND artifact_ok AND win_ok AND loss_ok AS approved FROM g""")
def d36(spark, sf):
    g = sy.policy_gate(sy.study_metrics(study_records(spark, sf)), 20, 20, 0.5, 0.3, 0.3, 0.4)
    return g.select("category", "is_total", "enough_good", "enough_target", "good_damage_ok", "artifact_ok", "win_ok",
                    "loss_ok", "approved")


def blind_responses(spark, sf):
    """Study records as blind responses; every ninth trial has no key and every tenth record answers twice."""
    s = study_records(spark, sf)
    num = F.col("track_id").cast("bigint")
    r = s.select(
        F.col("track_id").alias("trial_id"), "category", "already_good",
        F.when(num % 4 == 0, "A").when(num % 4 == 1, "B").when(num % 4 == 2, "tie").otherwise("C").alias("preference"),
        F.col("artifact_audible").alias("a"), F.col("tonal_side_effect").alias("b"))
    again = r.filter(F.col("trial_id").cast("bigint") % 10 == 0)
    key = s.filter(num % 9 != 0).select(
        F.col("track_id").alias("trial_id"), F.when(num % 2 == 0, "guided").otherwise("stereo").alias("side_a"),
        F.when(num % 2 == 0, "stereo").otherwise("guided").alias("side_b"))
    return r.unionByName(again), key


@query("j11_decode_blind", f"""WITH {STUDY},
r0 AS (SELECT track_id AS trial_id, category, already_good, CAST(track_id AS BIGINT) AS i,
         CASE CAST(track_id AS BIGINT) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'tie' ELSE 'C' END AS preference,
         artifact_audible AS a, tonal_side_effect AS b FROM study),
rs AS (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE i % 10 = 0),
k AS (SELECT trial_id, CASE WHEN i % 2 = 0 THEN 'guided' ELSE 'stereo' END AS side_a,
        CASE WHEN i % 2 = 0 THEN 'stereo' ELSE 'guided' END AS side_b FROM r0 WHERE i % 9 <> 0),
e AS (SELECT rs.*, side_a, side_b, CASE WHEN side_a IS NULL THEN 'trial missing from key'
        WHEN count(*) OVER (PARTITION BY rs.trial_id) > 1 THEN 'duplicate response'
        WHEN preference NOT IN ('A', 'B', 'tie') THEN 'invalid preference' END AS error
      FROM rs LEFT JOIN k USING (trial_id))
SELECT trial_id, category, already_good, CASE WHEN error IS NULL THEN CASE preference WHEN 'tie' THEN 'tie'
    WHEN 'A' THEN side_a ELSE side_b END END AS decoded,
  CASE WHEN error IS NULL THEN CASE WHEN side_a = 'guided' THEN a ELSE b END END AS guided_rating, error FROM e""")
def j11(spark, sf):
    return sy.decode_blind(*blind_responses(spark, sf))


@query("u6_assign_blind")
def u6(spark, sf):
    key, _ = sy.assign_blind(study_records(spark, sf).select(F.col("track_id").alias("trial_id")), 7)
    return key


def manifest(spark, sf):
    """Documents as corpus items; some lack fields or carry bad values."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    split = F.when(i % 10 < 6, "train").when(i % 10 == 6, "validation").when(i % 10 == 7, "test").when(
        i % 10 == 8, "negative").otherwise("holdout")
    return d.select(
        F.col("source").alias("corpus_id"), split.alias("split"), (i % 400).cast("string").alias("item_id"),
        F.when(i % 23 == 0, "not-a-digest").otherwise(F.sha2("text", 256)).alias("audio_sha256"),
        F.array(F.col("lang"), F.when(i % 29 == 0, "").otherwise("voice")).alias("labels"),
        F.when(i % 31 == 0, " ").otherwise("cc-by").alias("license_provenance"),
        F.concat(F.lit("group-"), (i % 37 + F.when(i % 10 == 7, i % 3 * 37).otherwise(0))
                 .cast("string")).alias("artist_group"),
        F.when(i % 19 != 0, "research").alias("usage"), "doc_id")


MANIFEST_CTE = """mf AS (SELECT source AS corpus_id, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 = 6 THEN 'validation'
    WHEN doc_id % 10 = 7 THEN 'test' WHEN doc_id % 10 = 8 THEN 'negative' ELSE 'holdout' END AS split,
    CAST(doc_id % 400 AS VARCHAR) AS item_id,
    CASE WHEN doc_id % 23 = 0 THEN 'not-a-digest' ELSE sha256(text) END AS audio_sha256,
    CASE WHEN doc_id % 29 = 0 THEN '' ELSE 'voice' END AS label2,
    CASE WHEN doc_id % 31 = 0 THEN ' ' ELSE 'cc-by' END AS license_provenance,
    'group-' || (doc_id % 37 + CASE WHEN doc_id % 10 = 7 THEN doc_id % 3 * 37 ELSE 0 END) AS artist_group,
    CASE WHEN doc_id % 19 <> 0 THEN 'research' END AS usage, doc_id FROM documents)"""


@query("b19_manifest_rules", f"""WITH {MANIFEST_CTE}
SELECT doc_id, concat_ws('; ', CASE WHEN usage IS NULL THEN 'missing usage' END,
  CASE WHEN split = 'holdout' THEN 'unsupported split' END, CASE WHEN label2 = '' THEN 'empty label' END,
  CASE WHEN NOT regexp_matches(audio_sha256, '^[0-9a-fA-F]{{64}}$') THEN 'bad digest' END,
  CASE WHEN trim(license_provenance) = '' OR trim(artist_group) = '' THEN 'license and group required' END) AS errors FROM mf""")
def b19(spark, sf):
    return sy.manifest_errors(manifest(spark, sf)).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("u3_missing_fields", f"""WITH {MANIFEST_CTE} SELECT doc_id, CASE WHEN usage IS NULL THEN 'usage' ELSE '' END AS missing
FROM mf""")
def u3(spark, sf):
    m = manifest(spark, sf)
    present = F.filter(F.array(*[F.when(F.col(f).isNotNull(), f) for f in sy.MANIFEST_FIELDS]), lambda x: x.isNotNull())
    need = F.array(*[F.lit(f) for f in sy.MANIFEST_FIELDS])
    return m.select("doc_id", F.array_join(F.array_except(need, present), ",").alias("missing"))


@query("u4_split_leakage", f"""WITH {MANIFEST_CTE}
SELECT artist_group FROM mf WHERE split = 'test' INTERSECT SELECT artist_group FROM mf WHERE split IN ('train', 'validation')""")
def u4(spark, sf):
    return sy.split_leakage(manifest(spark, sf))


@query("u5_duplicate_identity", f"""WITH {MANIFEST_CTE}
SELECT corpus_id, item_id, count(*) AS copies FROM mf GROUP BY 1, 2 HAVING count(*) > 1""")
def u5(spark, sf):
    return sy.duplicate_identity(manifest(spark, sf), "corpus_id", "item_id")


def event_log(spark, sf):
    """The events appended to a log folder in two steps."""
    from ..sources import logs
    from ..streaming.runner import scratch_folder

    folder = scratch_folder(spark, "event-log")
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("profile_name"), F.col("event_id").cast("string").alias("event_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.lit(1).alias("event_type"),
        ((F.col("value") - 50.0) / 25).alias("delta_lufs"))
    logs.append_events(e.filter("event_id % 2 = 0"), folder)
    logs.append_events(e.filter("event_id % 2 = 1"), folder)
    return folder


@query("a5_read_event_log", f"""SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS profile_name, epoch_us(ts) // 1000 AS timestamp_ms,
  {rd('(value - 50.0) / 25')} AS delta_lufs, 0.0::DOUBLE AS delta_punch FROM events""")
def a5(spark, sf):
    from ..sources import logs

    log = logs.read_event_log(spark, event_log(spark, sf))
    return rounded(log.select("event_id", "profile_name", "timestamp_ms", "delta_lufs", "delta_punch"))


@query("a6_export_import_reset", """SELECT event_type AS profile_name, count(*) AS events FROM events WHERE event_type <> 'error' GROUP BY 1""")
def a6(spark, sf):
    """Export all logs, import them elsewhere, reset one profile there."""
    from ..sources import logs
    from ..streaming.runner import scratch_folder

    out, other = scratch_folder(spark, "export"), scratch_folder(spark, "import")
    logs.export_all(spark, event_log(spark, sf), out)
    logs.import_all(spark, out, other)
    logs.reset_profile(spark, other, "error")
    return logs.read_live_events(spark, other).groupBy("profile_name").agg(F.count(F.lit(1)).alias("events"))


@query("a1_decode_wav", f"""WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '....') AS pairs FROM documents),
v AS (SELECT doc_id, len(pairs) AS frames, unnest(pairs) AS p, unnest(range(len(pairs))) AS i FROM h),
x AS (SELECT doc_id, frames, i, (CAST('0x' || substr(p, 3, 2) || substr(p, 1, 2) AS INTEGER) + 32768) % 65536 - 32768 AS s FROM v)
SELECT CAST(doc_id AS VARCHAR) AS track_id, i // 500 AS block_ix, CAST(count(*) AS INTEGER) AS n, i // 500 = (any_value(frames) - 1) // 500 AS is_last,
  {rd('sum(s / 32768.0::DOUBLE)')} AS total, {rd('sum(s / 32768.0::DOUBLE * (i % 500 + 1))')} AS weighted, {rd('min(s) / 32768.0::DOUBLE')} AS least
FROM x GROUP BY doc_id, i // 500""")
def a1(spark, sf):
    """Each text's bytes as the 16-bit samples of a mono WAV file of open length; sums tell the samples and their order."""
    import struct

    from ..sources.wav import decode_files

    head = b"RIFF" + struct.pack("<I", 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF)
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    files = d.select("path", F.concat(F.lit(head), F.encode("text", "UTF-8")).alias("content"))
    x = F.transform(F.get("ch", F.lit(0)), lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return rounded(decode_files(files, 500).select(
        "track_id", "block_ix", "n", "is_last", total(x).alias("total"), total(F.transform(x, lambda v, i: v * (i + 1))).alias("weighted"),
        F.array_min(x).alias("least")))
