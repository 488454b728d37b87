import math

import numpy as np
import pandas as pd
import pytest
from helpers import frames, long, tone, values
from pyspark.sql import functions as F

from signalmill.operators import frames as fr
from signalmill.operators import integrity, loudness, ordering, quantiles, spectrum, stereo, structure
from signalmill.operators.waveform import waveform_pyramid


def test_damaged_frames_are_counted(spark):
    nan, inf = float("nan"), float("inf")
    l = [0.0, nan, 0.5, inf, 1.2, 0.1, 0.0, 0.0]
    r = [0.0, 0.1, 1.0, 1.0, 1.0, 0.2, 0.1, 0.0]
    f = frames(spark, l, r)
    m = integrity.integrity_metrics(f, 8.0).first()
    assert (m.nan_samples, m.infinite_samples) == (1, 1)
    assert m.clipped_samples == 4
    runs = integrity.full_scale_runs(f, block=3).first()
    assert (runs.longest_run, runs.repeated_runs) == (3, 1)
    assert m.head_silence_s == pytest.approx(1 / 8) and m.tail_silence_s == pytest.approx(1 / 8)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_runs_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(3)
    hit = (rng.random(200) < 0.7).astype(float)
    got = ordering.runs(long(spark, hit), ["track_id", "ch"], "frame_ix", F.col("x") > 0.5, block)
    starts, ends = values(got, "start_ix", "start_ix", "end_ix")
    edge = np.diff(np.concatenate([[0], hit, [0]]))
    assert starts.tolist() == np.flatnonzero(edge == 1).tolist()
    assert ends.tolist() == (np.flatnonzero(edge == -1) - 1).tolist()


def test_running_total_levels_agree(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "o": rng.permutation(500), "v": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf)
    out = ordering.running_total(
        df, ["k"], [F.floor(F.col("o") / 100), F.floor(F.col("o") / 10)], [F.col("o")], F.col("v"), "cum").toPandas()
    want = pdf.sort_values("o").assign(cum=lambda d: d.groupby("k").v.cumsum()).set_index("o").cum
    assert (out.set_index("o").cum.sort_index() == want.sort_index()).all()


def test_fill_crosses_empty_blocks(spark):
    x = np.full(100, np.nan)
    x[[3, 77]] = [1.0, 2.0]
    pdf = pd.DataFrame({"track_id": "t", "p": np.arange(100), "v": x})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = ordering.fill_from_neighbours(df, ["track_id"], "p", 8, "v", "prev", "next").orderBy("p").toPandas()
    assert out.prev[:3].isna().all() and (out.prev[3:77] == 1.0).all() and (out.prev[77:] == 2.0).all()
    assert (out.next[:4] == 1.0).all() and (out.next[4:78] == 2.0).all() and out.next[78:].isna().all()


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(-20, 6, 301), 2)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": x}))
    got = quantiles.linear_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}).first()
    assert [got.a, got.b, got.c] == pytest.approx(list(np.quantile(x, [0.1, 0.5, 0.95])))
    upper = quantiles.ranked_value(df, ["k"], "v", lambda n: F.floor(n / 2), "m").first().m
    assert upper == np.sort(x)[len(x) // 2]


def test_ramp_pyramid(spark):
    p = waveform_pyramid(long(spark, np.arange(16) / 15), 4, 2).toPandas()
    assert p.groupby("level").size().tolist() == [4, 2, 1]
    first = p[(p.level == 0) & (p.bin_ix == 0)].iloc[0]
    assert first["min"] == 0.0 and first["max"] == pytest.approx(0.2)
    top = p[p.level == 2].iloc[0]
    assert top["rms"] == pytest.approx(np.sqrt(np.mean((np.arange(16) / 15) ** 2))) and top["frames"] == 16


def test_interleave_round_trip(spark):
    f = frames(spark, [1, 0.5, 0.25], [-1, -0.5, -0.25])
    i = fr.interleave(f, 8)
    assert i.first().samples == [1, -1, 0.5, -0.5, 0.25, -0.25]
    back = fr.deinterleave(i, 8)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, fr.to_long(f).collect()))


def test_mono_and_opposed_channels(spark):
    x = tone(440, 8000, 0.5)
    same = stereo.stereo_sums(frames(spark, x)).first()
    assert same.correlation > 0.999 and abs(same.mono_fold_delta_db) < 1e-6
    opposed = frames(spark, x, -x)
    flip = stereo.stereo_sums(opposed).first()
    assert flip.correlation < -0.999 and flip.mono_fold_delta_db < -100
    assert stereo.negative_correlation_fraction(opposed, 512).first().negative_fraction > 0.9
    assert stereo.band_widths(frames(spark, x), 8000, block=1000).first().low_band_width < 1e-6


def test_silence_defaults(spark):
    f = frames(spark, np.zeros(32))
    s = stereo.stereo_sums(f).first()
    assert s.correlation == 1.0 and s.mono_fold_delta_db == 0.0
    m = integrity.integrity_metrics(f, 8.0).first()
    assert m.head_silence_s == m.tail_silence_s == 4.0
    assert stereo.centered_correlation(f).first().centered_correlation == 1.0


def test_tone_spectrum(spark):
    x = tone(1000, 48000, 1, 0.5)
    df = long(spark, x).select("track_id", "frame_ix", "x")
    s = spectrum.power_spectrum(df, 2048, 8192)
    shape = spectrum.spectral_shape(s, 48000, 2048).first()
    assert abs(shape.centroid_hz - 1000) < 30 and abs(shape.rolloff_hz - 1000) < 40
    assert s.first().windows == (48000 - 2048) // 1024 + 1
    other = spectrum.power_spectrum(df, 2048, 4096).agg(F.sum("power")).first()[0]
    assert other == pytest.approx(s.agg(F.sum("power")).first()[0])


def test_short_series_is_zero_padded(spark):
    x = tone(1000, 8000, 0.005)
    s = spectrum.power_spectrum(long(spark, x).select("track_id", "frame_ix", "x"), 64, 128).orderBy("bin").toPandas()
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 63)
    want = np.abs(np.fft.rfft(np.pad(x, (0, 64 - len(x))) * taper)) ** 2
    assert np.allclose(s.power, want)


def test_band_powers_equal_direct_sums(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=150)
    got = spectrum.window_band_powers(long(spark, x).select("track_id", "frame_ix", "x"), 8000, 64, 8, 200.0, block=128).toPandas()
    assert sorted(got.win.unique()) == [0, 1]  # the last 22 samples are too few
    hz = spectrum.band_frequencies(8000, 8, 200.0)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 63)
    want = abs(np.sum(x[64:128] * taper * np.exp(-2j * np.pi * hz[3] * np.arange(64) / 8000))) ** 2 / 64**2
    assert got[(got.win == 1) & (got.band == 3)].power.iloc[0] == pytest.approx(want)


def test_loudness_of_a_reference_tone(spark):
    rate = 8000
    x = tone(1000, rate, 20, 10 ** (-23 / 20))
    got = loudness.loudness(loudness.weighted_hops(frames(spark, x), rate, block=16384)).first()
    for v in (got.integrated_lufs, got.max_momentary, got.max_short_term):
        assert v == pytest.approx(-23.0, abs=0.1)


def test_loudness_of_five_channels(spark):
    rate = 8000
    levels = [-28, -28, -24, -30, -30]
    names = ["c0", "c1", "c2", "c3", "c4"]
    pdf = pd.DataFrame({"track_id": "t", "frame_ix": np.arange(rate * 20)})
    for n, db in zip(names, levels):
        pdf[n] = tone(1000, rate, 20, 10 ** (db / 20))
    hops = loudness.weighted_hops(spark.createDataFrame(pdf), rate, names, block=40000)
    assert loudness.loudness(hops).first().integrated_lufs == pytest.approx(-23.0, abs=0.1)


def test_k_weighting_at_48k_matches_the_published_table():
    from signalmill.functions.filters import k_weighting

    sys = k_weighting(48000)
    x = np.zeros(4)
    x[0] = 1
    state, h = np.zeros(sys.order), []
    for v in x:
        h.append(sys.c @ state + sys.d * v)
        state = sys.a @ state + sys.b * v
    # first impulse samples of the two published biquads in series
    b, a = [1.53512485958697, -2.69169618940638, 1.19839281085285], [1.0, -1.69065929318241, 0.73248077421585]
    d, c = [1.0, -2.0, 1.0], [1.0, -1.99004745483398, 0.99007225036621]
    want = []
    y1, y2 = [0.0] * 2, [0.0] * 2
    xs = [0.0, 0.0, *x]
    u = [0.0, 0.0]
    out = [0.0, 0.0]
    for n in range(2, 6):
        u.append(b[0] * xs[n] + b[1] * xs[n - 1] + b[2] * xs[n - 2] - a[1] * u[n - 1] - a[2] * u[n - 2])
        out.append(d[0] * u[n] + d[1] * u[n - 1] + d[2] * u[n - 2] - c[1] * out[n - 1] - c[2] * out[n - 2])
    want = out[2:]
    assert np.allclose(h, want, atol=1e-9)


def test_true_peak_between_samples(spark):
    rate = 48000
    x = tone(rate / 4, rate, 0.5, 1.41, math.pi / 4)
    t = loudness.true_peak(frames(spark, x), block=5000).first()
    sample = integrity.peak_rms_crest(frames(spark, x)).first().sample_peak_db
    assert sample < 0.2 and 2.6 <= t.true_peak_dbtp <= 3.2
    whole = loudness.true_peak(frames(spark, x), block=65536).first()
    assert whole.true_peak == pytest.approx(t.true_peak)


def program(rate=8000):
    """A pulse twice a second, quiet for the first half and loud with added 3.2 kHz in the second."""
    t = np.arange(rate * 16) / rate
    pulse = np.exp(-((t % 0.5) * 30))
    level = np.where(t < 8, 0.08, 0.5)
    return level * pulse * np.sin(2 * np.pi * 180 * t) + np.where(t < 8, 0.0, 0.05) * np.sin(2 * np.pi * 3200 * t)


def test_structure_of_a_pulsed_program(spark):
    rate, size = 8000, 256
    f = frames(spark, program(rate))
    onsets = structure.onset_strength(structure.feature_frames(f, size, 4096)).cache()
    picked = structure.pick_onsets(onsets, structure.onset_threshold(onsets), rate)
    tempo = structure.tempo(onsets, picked, rate / size).first()
    # a two-pulse period is as regular as one pulse; both are the right pulse
    assert min(abs(tempo.bpm - 120), abs(tempo.bpm - 60)) < 8 and tempo.tempo_confidence > 0.3
    assert picked.first().onset_density > 1
    s = structure.sections(f, rate, size, 2.0, 4096)
    c = structure.section_contrast(s).first()
    assert c.section_count >= 2 and c.section_contrast_db > 5


def test_hard_clipping_is_recognised(spark):
    x = np.clip(tone(80, 8000, 4, 1.45), -1, 1)
    f = frames(spark, x)
    m = (integrity.window_character(f, 2048).join(integrity.plateau_samples(f, 1000), "track_id")
         .join(integrity.integrity_metrics(f, 8000).select("track_id", "clipped_samples"), "track_id")
         .join(integrity.full_scale_runs(f, block=1000), "track_id"))
    got = integrity.character_likelihoods(m, 8000).first()
    assert got.hard_clip > 0.5 and got.clipping_window_fraction > 0.5


def test_positions_agree_whether_sorted_whole_or_by_bucket(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 4, 400), "o": rng.permutation(400)}))
    df = df.withColumn("k", F.expr("nullif(k, 3)"))  # rows without a key are a series too
    bucket = [F.floor(F.col("o") / 50), F.floor(F.col("o") / 5)]
    whole = ordering.position(df, ["k"], [], [F.col("o")], "p").orderBy("o").collect()
    split = ordering.position(df, ["k"], bucket, [F.col("o")], "p").orderBy("o").collect()
    assert [r.p for r in whole] == [r.p for r in split]


def test_loudness_of_one_to_six_channels(spark):
    """Each track with its own channels, against direct sums with the weights of its layout."""
    from helpers import long

    from signalmill.functions import filters as fl
    from signalmill.operators import loudness as lo
    from signalmill.operators.scans import run_linear

    rate, rng, rows, signals = 8000.0, np.random.default_rng(6), None, {}
    for n in range(1, 7):
        for ch in range(n):
            signals[n, ch] = rng.normal(0, 0.1 * (ch + 1), 1250)
            own = long(spark, signals[n, ch], f"t{n}", ch)
            rows = own if rows is None else rows.unionByName(own)
    weights = {1: [1], 2: [1, 1], 3: [1, 1, 1], 4: [1, 1, 1.41, 1.41], 5: [1, 1, 1, 1.41, 1.41], 6: [1, 1, 1, 0, 1.41, 1.41]}
    for block in (128, 4096):
        hops = {(r.track_id, r.hop_ix): r for r in lo.weighted_hops_of_samples(rows, rate, 0.0125, block=block).collect()}
        for n in range(1, 7):
            total = sum(w * run_linear(fl.k_weighting(rate), signals[n, ch][None], np.zeros((1, 4)))[0][0] ** 2 for ch, w in enumerate(weights[n]))
            for hop in range(13):
                got = hops[f"t{n}", hop]
                assert got.e == pytest.approx(total[hop * 100: hop * 100 + 100].sum()) and got.n == min(100, 1250 - hop * 100)
    peaks = {r.track_id: r.true_peak for r in lo.true_peak_of_samples(rows, block=300).collect()}
    assert all(peaks[f"t{n}"] >= max(np.abs(signals[n, c]).max() for c in range(n)) for n in range(1, 7))
    two = lo.weighted_hops(rows.filter("track_id = 't2'").groupBy("track_id", "frame_ix").agg(
        F.max(F.when(F.col("ch") == 0, F.col("x"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("x"))).alias("r")), rate, hop_s=0.0125, block=256)
    assert all(r.e == pytest.approx(hops["t2", r.hop_ix].e) for r in two.collect())
