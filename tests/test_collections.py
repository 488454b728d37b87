import numpy as np
import pandas as pd
import pytest
from helpers import frames, long
from pyspark.sql import functions as F

from signalmill.operators import collections as co
from signalmill.operators import events, pairing, study
from signalmill.plans import decision, dimensions, issues
from signalmill.plans import graph as g
from signalmill.plans import planner, revisions

ALBUM = "album_id string, track_index bigint, title string, input_lufs double, master_lufs double"


def album(spark, lufs, master=None):
    m = master or [-80.0] * len(lufs)
    return spark.createDataFrame([("a", i, f"t{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(lufs, m))], ALBUM)


def test_album_statistics_use_the_upper_median(spark):
    s = co.collection_stats(album(spark, [-18, -11, -20, -13])).first()
    assert (s.track_count, s.min_lufs, s.max_lufs, s.span_lu, s.median_lufs) == (4, -20, -11, 9, -13)
    assert s.mean_lufs < -14 and s.lufs_variance == pytest.approx(np.var([-18, -11, -20, -13]))


def test_unmeasured_tracks_count_but_do_not_average(spark):
    t = album(spark, [-80, -12])
    s = co.collection_stats(t).first()
    assert s.track_count == 2 and s.min_lufs == s.max_lufs == -12
    p = {r.track_index: r for r in co.cohesion_plan(t, co.collection_stats(t)).collect()}
    assert p[0].offset_lu == 0.0 and p[0].explanation == "album default"


def test_cohesion_keeps_half_of_the_contrast(spark):
    t = album(spark, [-22, -10, -15])
    p = [r for r in co.cohesion_plan(t, co.collection_stats(t), -14.0).orderBy("track_index").collect()]
    assert len(p) == 3 and p[0].target_lufs < p[1].target_lufs
    assert p[0].offset_lu == -2.5 and p[1].offset_lu == 2.5 and p[2].offset_lu == 0.0


def test_transitions_warn_on_large_steps(spark):
    t = co.transitions(album(spark, [0, 0, 0], [-14, -13.5, -18])).orderBy("from_track").collect()
    assert [r.jump_warning for r in t] == [False, True]


PREF = "profile_name string, seq bigint, delta_lufs double, delta_brightness double, delta_bass double, delta_width double, delta_saturation double, delta_punch double"


def test_preferences_weight_recent_events(spark):
    e = spark.createDataFrame([("electronic", 0, .2, 0., 0., 0., 0., 0.), ("electronic", 1, 1., 0., 0., 0., 0., 0.),
                               ("electronic", 2, 0., 1.5, 0., 0., 0., 0.)], PREF)
    v = co.preference_vector(co.preference_sums(e)).first()
    w = 1.02 ** np.arange(3)
    assert v.event_count == 3
    assert v.lufs_bias == pytest.approx(0.25 * (w @ [.2, 1, 0]) / w.sum())
    assert v.brightness_bias == pytest.approx(0.25 * (w @ [0, 0, 1.5]) / w.sum()) and v.width_scale == 1.0


def test_very_long_logs_do_not_overflow(spark):
    e = spark.range(60000).select(F.lit("p").alias("profile_name"), F.col("id").alias("seq"), F.lit(1.0).alias("delta_lufs"),
                                  *[F.lit(0.0).alias(f"delta_{x}") for x in ("brightness", "bass", "width", "saturation", "punch")])
    assert co.preference_vector(co.preference_sums(e)).first().lufs_bias == pytest.approx(0.25)


def test_profiles_average(spark):
    p = spark.createDataFrame([("m", -12., -1., 2., 3.), ("m", -14., -.5, 4., 1.)],
                              "profile string, integrated_lufs double, true_peak_dbtp double, bass_db double, presence_db double")
    r = co.aggregate_profiles(p, "profile").first()
    assert (r.integrated_lufs, r.true_peak_dbtp, r.reference_count) == (-13.0, -0.75, 2)


def test_retention_matches_a_loop(spark):
    rng = np.random.default_rng(4)
    items = pd.DataFrame({"item_id": range(200), "size_bytes": rng.integers(1, 50, 200), "modified_ms": rng.integers(0, 90, 200),
                          "owned": rng.random(200) < .3})
    got = co.retention_plan(spark.createDataFrame(items), 2500, F.floor(F.col("modified_ms") / 10)).toPandas().set_index("item_id")
    total = items.size_bytes.sum()
    for _, it in items[~items.owned].sort_values(["modified_ms", "item_id"]).iterrows():
        assert bool(got.loc[it.item_id, "remove"]) == bool(total > 2500)
        if total > 2500:
            total -= it.size_bytes


def test_events_merge_only_with_the_row_before(spark):
    rows = [("t", 0, "kick", 0., 1., .5), ("t", 1, "kick", 1.2, 1.6, .9), ("t", 2, "snare", 1.7, 1.8, .4), ("t", 3, "kick", 1.8, 2., .4),
            ("t", 4, "unknown", 2., 2.1, .1), ("t", 5, "unknown", 2.1, 2.2, .1), ("t", 6, "kick", 5., 4., .9), ("t", 7, "kick", 6., 7., .3)]
    e = spark.createDataFrame(rows, "track_id string, seq bigint, label string, start_s double, end_s double, confidence double")
    for block in (2, 3, 64):
        m = co.merge_events(e, 0.25, block).orderBy("start_s").collect()
        assert [(r.label, r.start_s, r.end_s) for r in m] == [
            ("kick", 0., 1.6), ("snare", 1.7, 1.8), ("kick", 1.8, 2.), ("unknown", 2., 2.1), ("unknown", 2.1, 2.2), ("kick", 6., 7.)]
        assert m[0].confidence == 0.9


def test_taxonomy_falls_back_to_ancestors(spark):
    s = spark.createDataFrame([(1, "rhodes", .9, 0), (2, "rhodes", .75, 0), (3, "rhodes", .2, 0), (4, "rhodes", .6, 0)],
                              "segment_id int, label string, confidence double, i int")
    got = {r.segment_id: r.label for r in events.taxonomy_backoff(s, dimensions.ancestor_closure(spark)).collect()}
    assert got == {1: "rhodes", 2: "electric_piano", 3: "unknown", 4: "tonal_source"}


ACT = "track_id string, taxonomy_id string, confidence double, low_band_energy double, fundamental_hz double, transient_strength double, stereo_width double, phase_coherence double, active_seconds double, overlap_seconds double"


def test_pairs_and_bounded_repairs(spark):
    a = spark.createDataFrame([("t", "kick", .9, .8, 55., .9, .2, .9, 10., 8.), ("t", "sub_808", .95, .7, 48., .4, .3, .85, 9., 8.)], ACT)
    p = pairing.pairwise_interactions(a)
    r = p.first()
    assert p.count() == 1 and r.low_band_masking > 0.4
    assert "dynamic_low_band_attenuation" in [x.action for x in decision.plan_bounded_repairs(p).collect()]
    d = spark.createDataFrame([(0., 0., .2, 0., 0., 0.)],
                              "true_peak_delta double, loudness_delta double, transient_loss double, spectral_side_effect double, mono_delta double, width_delta double")
    gate = decision.rule_gate(d, decision.DAMAGE_GUARD).first()
    assert not gate.safe and gate.blockers == ["transient"]


def risk(spark, value, conf):
    names = ["leakage", "musical_noise", "transient_damage", "phase_change", "hf_smearing", "source_residue", "residual"]
    df = spark.createDataFrame([tuple([value] * 7 + [conf, conf])], ", ".join(f"{n} double" for n in [*names, "model_confidence", "measurement_confidence"]))
    return decision.artifact_risk(df).first()


def test_artifact_risk_levels(spark):
    clean, bad = risk(spark, 0.05, 0.95), risk(spark, 0.8, 0.9)
    assert clean.overall_risk < 0.15 and clean.risk_confidence > 0.85 and clean.evidence == []
    assert bad.overall_risk > 0.60 and "leakage" in bad.evidence


def test_mode_ladder(spark):
    cols = "source_specific_issue boolean, reconstruction_required boolean, benefit double, guidance_confidence double, guided_sufficiency double, model_confidence double, overall_risk double, risk_confidence double"
    rows = [(False, False, .9, .9, .9, .9, .1, .9), (True, False, .1, .9, .9, .9, .1, .9), (True, True, .8, .9, .9, .9, .1, .9),
            (True, True, .8, .9, .9, .5, .1, .9), (True, False, .8, .3, .9, .9, .1, .9)]
    got = [r.mode for r in decision.choose_mode(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["stereo_mastering", "stereo_mastering", "stem_reconstruction", "source_guided_stereo", "stereo_mastering"]


STUDY = "track_id string, category string, already_good boolean, guidance_applied boolean, preference string, artifact_audible boolean, transient_damage boolean, mono_worse boolean, image_worse boolean, sections_worse boolean, tonal_side_effect boolean"


def test_study_policy(spark):
    f = [False] * 6
    s = spark.createDataFrame([("good-1", "c", True, True, "tie", *f), ("good-2", "c", True, True, "stereo", *f),
                               ("target-1", "c", False, True, "guided", *f), ("target-2", "c", False, True, "guided", *f)], STUDY)
    m = study.study_metrics(s).filter("is_total = 1")
    assert study.policy_gate(m, 2, 2, 0.0, 0.1, 0.5, 0.2).first().approved
    assert not study.policy_gate(m, 3, 2, 0.0, 0.1, 0.5, 0.2).first().approved
    r = m.first()
    assert r.win_rate == 1.0 and r.win_low == pytest.approx(0.342, abs=1e-3) and r.win_high == 1.0


def test_empty_group_has_no_rate_and_fails(spark):
    s = spark.createDataFrame([("g", "c", True, True, "tie", *[False] * 6)], STUDY)
    r = study.policy_gate(study.study_metrics(s).filter("is_total = 1"), 1, 1, 1., 1., 0., 1.).first()
    assert r.win_rate is None and r.win_low is None and not r.win_ok and not r.approved


def test_blind_assignment_round_trip(spark):
    trials = spark.createDataFrame([(f"x{i}",) for i in range(200)], "trial_id string")
    key, sheet = study.assign_blind(trials, 3)
    n = key.filter("side_a = 'guided'").count()
    assert 60 < n < 140 and key.filter("side_a = side_b").count() == 0 and "side_a" not in sheet.columns
    again, _ = study.assign_blind(trials.repartition(7), 3)
    assert sorted(key.collect()) == sorted(again.collect())
    answers = key.select("trial_id", F.lit("c").alias("category"), F.lit(True).alias("already_good"),
                         F.when(F.col("side_a") == "guided", "A").otherwise("B").alias("preference"), F.lit(1).alias("a"), F.lit(2).alias("b"))
    d = study.decode_blind(answers, key)
    assert d.filter("decoded = 'guided' and error is null").count() == 200


def test_manifest_rules(spark):
    schema = "corpus_id string, split string, item_id string, audio_sha256 string, labels array<string>, license_provenance string, artist_group string, usage string"
    ok = ("c", "train", "1", "a" * 64, ["x"], "cc", "artist-a", "r")
    rows = [ok, ("c", "train", "2", "zz", ["x"], "cc", "b", "r"), ("c", "test", "3", "A" * 64, [""], "cc", "artist-a", None), ("c", "dev", "1", "b" * 64, [], " ", "c", "r")]
    m = spark.createDataFrame(rows, schema)
    got = {r.item_id + r.split: r.errors for r in study.manifest_errors(m).collect()}
    assert got["1train"] == [] and got["2train"] == ["bad digest"]
    assert got["3test"] == ["missing usage", "empty label"] and got["1dev"] == ["unsupported split", "license and group required"]
    assert [r.artist_group for r in study.split_leakage(m).collect()] == ["artist-a"]
    assert study.duplicate_identity(m, "corpus_id", "item_id").count() == 1


PROMPTS = [
    ("p1", "Make the drums HIT HARDER and don't touch the bass", ["increase_punch"], ["stem_bass"]),
    ("p2", "back the 808 down, hats are too sharp", ["reduce_harshness", "adjust_bass_level"], []),
    ("p3", "hello there", ["custom"], []),
    ("p4", "more air but leave vocals alone", ["increase_brightness"], ["stem_vocal"]),
    ("p5", "preserve the bass but more bass", ["adjust_bass_level"], ["stem_bass"]),
    ("p6", "preserve snare", [], ["instrument_snare"]),
    ("p7", "warmer, wider, louder, more grit", ["increase_warmth", "adjust_stereo_width", "adjust_loudness", "adjust_saturation"], []),
]


def test_request_phrases(spark):
    m = revisions.match_phrases(spark.createDataFrame([(a, b) for a, b, *_ in PROMPTS], "msg_id string, text string"))
    got = {r.msg_id: r for r in revisions.constraint_conflicts(m).collect()}
    for key, _, actions, constraints in PROMPTS:
        assert [a.action for a in got[key].actions] == actions and [c.target for c in got[key].constraints] == constraints
    assert got["p5"].violations and not got["p1"].violations
    assert got["p2"].actions[1].delta_db == -1.5


def test_parser_hook_falls_back(spark):
    m = spark.createDataFrame([("a", "louder"), ("b", "wider")], "msg_id string, text string")
    base = revisions.match_phrases(m)
    kind = dict(base.dtypes)["actions"]
    hook = F.when(F.col("msg_id") == "a", F.array().cast(kind))
    got = {r.msg_id: len(r.actions) for r in revisions.with_parser_hook(m, hook).collect()}
    assert got == {"a": 0, "b": 1}


MET = dict(track_id="t", integrated_lufs=-18., true_peak_dbtp=-1., crest_db=10., plr_db=11., short_term_variation=3., sub=.2, bass=.3,
           upper_mid=.1, high=.08, centroid_hz=2500., max_abs_dc=0., clipped_samples=0, channels=2, correlation=.8, low_width=.05, mid_width=.2)


def one(spark, **kw):
    row = {**MET, **kw}
    return spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}" for k, v in row.items()))


def test_planner_variants(spark):
    p = {r.variant: r for r in planner.plan_ab(one(spark)).collect()}
    assert -12 <= p["a"].target_lufs <= -8.5 and p["b"].target_lufs < p["a"].target_lufs
    ids = [n.id for n in p["a"].nodes]
    assert ids[0] == "a_pre_gain" and ids[-1] == "a_limiter" and "a_low_dynamic_eq" in ids
    ok = planner.plan_ab(one(spark)).select(g.validate(F.col("nodes")).alias("e")).collect()
    assert all(r.e == [] for r in ok)


def test_graph_edits(spark):
    df = planner.plan_ab(one(spark)).filter("variant = 'a'")
    extra = g.node("x", "gain", gain_db=1.0).cast(g.NODE)
    row = df.select(
        g.insert_before(F.col("nodes"), "a_clipper", extra).alias("ins"), g.insert_before(F.col("nodes"), "none", extra).alias("app"),
        g.validate(F.concat("nodes", "nodes")).alias("twice"), g.validate(F.array().cast(g.NODES)).alias("empty"),
        g.set_bypass(F.col("nodes"), "a_glue", F.lit(True)).alias("off")).first()
    ids = [n.id for n in row.ins]
    assert ids.index("x") == ids.index("a_clipper") - 1 and row.app[-1].id == "x"
    assert row.twice == ["repeated id"] and row.empty == ["empty plan"]
    assert [n.id for n in row.off if n.bypass] == ["a_glue"]


def test_revision_moves_target_and_bands(spark):
    df = planner.plan_ab(one(spark, bass=.4)).crossJoin(revisions.constraint_conflicts(revisions.match_phrases(
        spark.createDataFrame([("louder, less bass, wider",)], "text string"))))
    r = {x.variant: x for x in planner.apply_revision(df).collect()}["a"]
    before = {x.variant: x for x in df.collect()}["a"]
    assert r.accepted and r.target_lufs == pytest.approx(before.target_lufs + 1)
    low = [b for n in r.nodes if n.type == "eq" for b in n.bands if b.frequency_hz <= 150][0]
    assert low.gain_db == pytest.approx(-1.2 - 1.5)
    width = [n.params["width"] for n in r.nodes if n.type == "stereo"][0]
    assert width == pytest.approx(1.08 + .15)


def test_revision_is_refused_on_conflict(spark):
    df = planner.plan_ab(one(spark)).crossJoin(revisions.constraint_conflicts(revisions.match_phrases(
        spark.createDataFrame([("more bass but preserve the bass",)], "text string"))))
    out = planner.apply_revision(df)
    assert out.filter("accepted").count() == 0
    assert out.select(revisions.explain_revision(out).alias("t")).first().t.startswith("refused")


def test_overlap_and_envelope(spark):
    a = spark.createDataFrame([("t", float(i), -20.) for i in range(10)], "track_id string, t double, v double")
    b = spark.createDataFrame([("t", i + 0.5, -20. if i < 5 else -90.) for i in range(10)], "track_id string, t double, v double")
    for bucket in (1.0, 3.0, 100.0):
        m = pairing.nearest_match(a, b, ["track_id"], 0.5, bucket).orderBy("t").collect()
        assert [r.other_t for r in m] == [0.5 + i for i in range(10)]  # ties go to the later point
    o = pairing.activity_overlap(a, b, ["track_id"]).first()
    assert (o.matched, o.b_active, o.overlap) == (10, 5, 1.0)
    env = pairing.activity_envelope(long(spark, np.r_[np.zeros(16), np.ones(16) * .5]), 8).orderBy("hop_ix").collect()
    assert [r.activity for r in env] == [0.0, 0.0, 1.0, 1.0]


def test_best_source_and_skip_reasons(spark):
    art = spark.createDataFrame([("t", "bass", 1, .9, 10., -20.), ("t", "bass", 0, .9, 99., -20.), ("t", "drums", 2, .5, 10., -20.),
                                 ("t", "vocals", 3, .9, 1., -20.), ("t", "other", 4, .9, 10., -60.), ("t", "unknown", 5, .9, 10., -20.)],
                                "track_id string, role string, seq int, confidence double, duration_s double, lufs double")
    prog = spark.createDataFrame([("t", .95, 10.)], "track_id string, overall_confidence double, program_s double")
    got = {r.role: r.reason for r in issues.admit_sources(art, prog).collect()}
    assert got == {"bass": "not aligned", "drums": "low confidence", "vocals": "too short", "other": "inactive"}


def test_repeated_trials_of_a_key_do_not_double_answers(spark):
    from signalmill.operators.study import decode_blind

    key = spark.createDataFrame([("t1", "guided", "stereo"), ("t1", "stereo", "guided"), ("t2", "stereo", "guided")], "trial_id string, side_a string, side_b string")
    answers = spark.createDataFrame([("t1", "c", True, "A", 1, 2), ("t2", "c", True, "B", 3, 4), ("t3", "c", True, "A", 5, 6), ("t2x", "c", False, None, 1, 1)],
                                    "trial_id string, category string, already_good boolean, preference string, a int, b int")
    got = {r.trial_id: r for r in decode_blind(answers, key).collect()}
    assert len(got) == 4 and got["t1"].error == "trial repeated in key" and got["t3"].error == "trial missing from key"
    assert (got["t2"].decoded, got["t2"].guided_rating, got["t2"].error) == ("guided", 4, None)
    one = decode_blind(answers.filter("trial_id = 't2x'").withColumn("trial_id", F.lit("t2")), key).first()
    assert one.error == "invalid preference" and one.decoded is None
