import inspect
import re

import numpy as np
import pytest
from helpers import frames, long, tone, values
from pyspark.sql import functions as F

from signalmill.functions import filters as fl
from signalmill.operators import dynamics as dy
from signalmill.operators import events, repair
from signalmill.operators import scans as sc

K = ["track_id"]


def noise(n=500, seed=0):
    return np.random.default_rng(seed).normal(0, 0.5, n)


def blocks(spark, l, r, block):
    return sc.to_blocks(frames(spark, l, r), K, "frame_ix", ["l", "r"], block)


def run(b, block):
    return values(sc.from_blocks(b, K, "frame_ix", ["l", "r"], block), "frame_ix", "l", "r")


def sequential(sys, x):
    s, y = np.zeros(sys.order), []
    for v in x:
        y.append(sys.c @ s + sys.d * v)
        s = sys.a @ s + sys.b * v
    return np.array(y)


def follow(t, fall, rise, g=0.0):
    out = []
    for v in t:
        k = fall if v < g else rise
        g = k * g + (1 - k) * v
        out.append(g)
    return np.array(out)


def db(x):
    return 20 * np.log10(np.maximum(x, 1e-12))


def curve(level, thr, ratio, knee):
    over, slope = level - thr, 1 / ratio - 1
    mid = slope * (over + knee / 2) ** 2 / (2 * knee)
    return np.where(over <= -knee / 2, 0.0, np.where(over >= knee / 2, slope * over, mid))


@pytest.mark.parametrize("block", [16, 50, 70, 512])
def test_filter_cascade_matches_the_sequential_loop(spark, block):
    x = noise()
    sys = fl.series(fl.design("high_pass", 40, 8000), fl.design("peak", 900, 8000, 4.0, 1.1),
                    fl.design("low_shelf", 200, 8000, -3.0), fl.design("high_shelf", 2000, 8000, 2.0), fl.one_pole(0.03))
    b = sc.to_blocks(frames(spark, x), K, "frame_ix", ["l"], block)
    y = values(sc.from_blocks(sc.linear_scan(b, K, {"y": ("l", sys)}, block), K, "frame_ix", ["y"], block), "frame_ix", "y")[0]
    assert np.allclose(y, sequential(sys, x), atol=1e-9)


@pytest.mark.parametrize("block", [8, 33, 100, 512])
def test_followers_are_exact_across_blocks(spark, block):
    t = np.abs(noise())
    b = sc.to_blocks(frames(spark, t), K, "frame_ix", ["l"], block)
    f = sc.follower_scan(b, K, {"y": ("l", 0.99, 0.6), "z": ("l", 0.5, 0.97)}, 0.0, block)
    y, z = values(sc.from_blocks(f, K, "frame_ix", ["y", "z"], block), "frame_ix", "y", "z")
    assert np.allclose(y, follow(t, 0.99, 0.6), atol=1e-12) and np.allclose(z, follow(t, 0.5, 0.97), atol=1e-12)


@pytest.mark.parametrize("block", [16, 64, 200])
def test_followers_know_no_bounds(spark, block):
    """Targets and starts of any size, states that fall for several blocks."""
    t = np.concatenate([np.full(150, 1.0), [3e4], np.full(300, -700.0), noise(77) * 1e-3])
    b = sc.to_blocks(frames(spark, t), K, "frame_ix", ["l"], block)
    for start in (20.0, -1e5):
        f = sc.follower_scan(b, K, {"y": ("l", 0.98, 0.9), "z": ("l", 0.999, 0.999)}, start, block)
        y, z = values(sc.from_blocks(f, K, "frame_ix", ["y", "z"], block), "frame_ix", "y", "z")
        assert np.allclose(y, follow(t, 0.98, 0.9, start), rtol=1e-10) and np.allclose(z, follow(t, 0.999, 0.999, start), rtol=1e-10)
    assert abs(follow(np.zeros(1), 0.938, 0.9, 20.0)[0] - 18.76) < 1e-12


@pytest.mark.parametrize("group", [1, 3, 256])
def test_states_are_carried_in_two_levels(spark, monkeypatch, group):
    """Many groups of blocks, a last group that is full, partial or only begun, several series, one of them without a key."""
    monkeypatch.setattr(sc, "GROUP", group)
    block = 16
    series = {"a": noise(block * 9), "b": noise(block * 7 + 5), "c": noise(block * 3), "d": noise(7), None: noise(block * 6 + 1)}
    rows = None
    for k, (name, x) in enumerate(series.items()):
        own = frames(spark, x, x + 0.1, "x").withColumn("track_id", F.lit(name).cast("string"))
        rows = own if rows is None else rows.unionByName(own)
    b = sc.to_blocks(rows, K, "frame_ix", ["l", "r"], block)
    sys = fl.series(fl.design("peak", 90, 1000, 4.0, 1.1), fl.one_pole(0.01))
    out = sc.linear_scan(b, K, {"u": ("l", sys)}, block)
    out = sc.follower_scan(out, K, {"v": ("r", 0.99, 0.6)}, -3.0, block)
    out = sc.limiter_scan(out, K, "l", "w", 0.97, block)
    out = sc.from_blocks(out, K, "frame_ix", ["u", "v", "w"], block)
    for name, x in series.items():
        own = out.where(F.col("track_id").eqNullSafe(F.lit(name)))
        u, v, w = values(own, "frame_ix", "u", "v", "w")
        g, want = 1.0, []
        for t in x:
            g = min(t, 0.97 * g + 0.03 * t)
            want.append(g)
        assert np.allclose(u, sequential(sys, x), atol=1e-9) and np.allclose(v, follow(x + 0.1, 0.99, 0.6, -3.0), atol=1e-12)
        assert np.allclose(w, want, atol=1e-12)


def test_maps_compose():
    r = np.random.default_rng(4)
    for kind in range(60):
        t = [np.abs(r.normal(0, 1, 150)), np.zeros(150), np.repeat(r.normal(0, 3, 50), 3), np.sin(np.arange(150) / 7) * 100 - 50][kind % 4]
        falling, rising = r.choice([0, 0.001, 0.5, 0.9, 0.999, 0.99999], 2)
        a, b = sc.follower_map(t[:70], falling, rising), sc.follower_map(t[70:], falling, rising)
        for g in (0.0, 20.0, -5.0, 1e6, -1e6, t[0], t.max()):
            want = follow(t, falling, rising, g)
            for m in (b.after(a), sc.Pieces.read(b.after(a).flat())[0], b.after(a).within(-2e6, 2e6)):
                assert abs(float(m(g)) - want[-1]) <= 1e-9 * max(1, abs(g))
            assert np.allclose(sc.follow(t[None], np.array([g]), falling, rising)[0], want, rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("block", [8, 64, 512])
def test_limiter_is_exact_and_holds_the_ceiling(spark, block):
    l, r = noise() * 2, noise(seed=1) * 2
    got = run(dy.limit(blocks(spark, l, r, block), 1000, -2.0, 50.0, block), block)
    top, keep, g, want = 10 ** (-0.1), fl.time_keep(50, 1000), 1.0, []
    for a, b in zip(l, r):
        p = max(abs(a), abs(b))
        t = top / p if p > top else 1.0
        g = t if t < g else keep * g + (1 - keep) * t
        want.append(np.clip(a * g, -top, top))
    assert np.allclose(got[0], want, atol=1e-12) and np.abs(got[1]).max() <= top + 1e-12


@pytest.mark.parametrize("block", [40, 512])
def test_compressor(spark, block):
    l, r = noise(), noise(seed=2)
    got = run(dy.compress(blocks(spark, l, r, block), 1000, -14, 3, 5, 60, 6, 2.0, 0.7, block), block)[0]
    t = curve(db(np.maximum(abs(l), abs(r))), -14, 3, 6)
    gain = follow(t, fl.time_keep(5, 1000), fl.time_keep(60, 1000))
    wet = l * 10 ** (gain / 20) * 10 ** (2 / 20)
    assert np.allclose(got, l + (wet - l) * 0.7, atol=1e-10)


@pytest.mark.parametrize("block", [64, 512])
def test_dynamic_eq(spark, block):
    l, r = noise(), noise(seed=2)
    got = run(dy.dynamic_eq(blocks(spark, l, r, block), 1000, 80, 1.0, -22, 2, 15, 140, 3, block), block)[0]
    bp = fl.design("band_pass", 80, 1000, q=1.0)
    bl, br = sequential(bp, l), sequential(bp, r)
    t = np.maximum(curve(db(np.maximum(abs(bl), abs(br))), -22, 2, 3.0), -3.0)
    g = 10 ** (follow(t, fl.time_keep(15, 1000), fl.time_keep(140, 1000)) / 20)
    assert np.allclose(got, l + bl * (g - 1), atol=1e-9)


def test_multiband(spark):
    l, r = noise(), noise(seed=2)
    got = run(dy.multiband(blocks(spark, l, r, 128), 1000, 60, 200, block=128), 128)[1]
    lo, hi = fl.design("low_pass", 60, 1000, q=0.70710678), fl.design("high_pass", 200, 1000, q=0.70710678)
    parts = {}
    for c, x in (("l", l), ("r", r)):
        a, b = sequential(lo, sequential(lo, x)), sequential(hi, sequential(hi, x))
        parts[c] = (a, x - a - b, b)
    out = 0
    for i, (thr, ratio) in enumerate(((-18, 1.4), (-16, 1.3), (-18, 1.4))):
        t = curve(db(np.maximum(abs(parts["l"][i]), abs(parts["r"][i]))), thr, ratio, 4.0)
        out = out + parts["r"][i] * 10 ** (follow(t, fl.time_keep(25, 1000), fl.time_keep(160, 1000)) / 20)
    assert np.allclose(got, out, atol=1e-9)


def test_denoise_gate(spark):
    l = noise() * 0.1
    got = run(dy.denoise_gate(blocks(spark, l, l, 96), 1000, -20.0, 6.0, 0.1, 96), 96)[0]
    dt, floor, least = 0.001, 0.2, 10 ** (-6 / 20)
    env = follow(abs(l), 1 - dt / (0.080 + dt), 1 - dt / (0.005 + dt))
    want = np.where(env < floor, l * np.clip(env / floor, least, 1), l)
    assert np.allclose(got, want, atol=1e-12)


def test_guided_apply_keeps_its_hard_limits(spark):
    l, r = noise(), noise(seed=4)
    f = frames(spark, l, r).withColumns({"gain_db": F.lit(-9.0), "cut_db": F.lit(0.0), "tame": F.lit(0.0), "narrow": F.lit(1.0)})
    for block in (64, 512):
        b = sc.to_blocks(f, K, "frame_ix", ["l", "r", "gain_db", "cut_db", "tame", "narrow"], block)
        a, c = run(dy.guided_apply(b, 1000, 100, 1.0, block=block), block)
        g = 10 ** (-1.5 / 20)
        mid, side = (l + r) / 2 * g, (l - r) / 2 * g * 0.7
        assert np.allclose(a, mid + side) and np.allclose(c, mid - side)


def test_graph_skips_bypassed_nodes_and_rejects_repeats(spark):
    l = noise()
    plan = [{"id": "a", "type": "gain", "params": {"gain_db": 3.0}}, {"id": "b", "type": "gain", "params": {"gain_db": -3.0}},
            {"id": "c", "type": "saturation", "bypass": True, "params": {"drive_db": 6.0, "mix": 1.0}}]
    assert np.allclose(run(dy.run_graph(blocks(spark, l, l, 128), plan, 1000, 128), 128)[0], l)
    with pytest.raises(ValueError):
        dy.run_graph(blocks(spark, l, l, 128), plan + plan, 1000)
    with pytest.raises(ValueError):
        dy.run_graph(blocks(spark, l, l, 128), [], 1000)


def test_custom_processor(spark):
    dy.register_processor("flip", lambda b, rate, p, block: dy._both(b, lambda c: F.transform(c, lambda x: -x)))
    l = noise(50)
    out = run(dy.run_graph(blocks(spark, l, l, 16), [{"id": "f", "type": "flip", "params": {}}], 1000, 16), 16)
    assert np.allclose(out[0], -l)


@pytest.mark.parametrize("block", [512, 701, 4096])
def test_resampling_length_and_tone(spark, block):
    x = tone(1000, 48000, 0.1)
    y = values(repair.resample(long(spark, x), 48000, 44100, block=block), "frame_ix", "x")[0]
    assert len(y) == 4410
    want = np.sin(2 * np.pi * 1000 * np.arange(4410) / 44100)
    assert np.abs(y[100:-100] - want[100:-100]).max() < 2e-3


def test_resampling_removes_what_would_alias(spark):
    x = tone(20000, 48000, 0.1, 0.8)
    y = values(repair.resample(long(spark, x), 48000, 32000, block=1024), "frame_ix", "x")[0]
    assert np.sqrt(np.mean(y**2)) < 0.08


def test_resampling_does_not_depend_on_blocks(spark):
    x = noise(3000)
    a = values(repair.resample(long(spark, x), 480, 441, block=256), "frame_ix", "x")[0]
    b = values(repair.resample(long(spark, x), 480, 441, block=4096), "frame_ix", "x")[0]
    assert np.allclose(a, b)


def test_declip_rebuilds_and_reports(spark):
    x = np.clip(1.3 * np.sin(2 * np.pi * 200 * np.arange(800) / 8000), -1, 1)
    out = repair.declip(long(spark, x), 0.98, block=50)
    rep = repair.declip_report(out).first()
    assert rep.repaired_samples > 0 and rep.peak_gain_db >= 0
    y = values(out, "frame_ix", "x")[0]
    same = np.abs(x) < 0.98
    assert np.allclose(y[same], x[same]) and (np.abs(y[~same]) >= 0.98 - 1e-12).all()


@pytest.mark.parametrize("block", [4, 13, 200])
def test_refractory_pick_is_greedy(spark, block):
    rng = np.random.default_rng(8)
    hit = rng.random(180) < 0.4
    df = long(spark, hit.astype(float)).select("track_id", F.col("frame_ix").alias("pos"), (F.col("x") > 0).alias("hit"))
    got = [r.pos for r in events.refractory_pick(df, K, 6, block).orderBy("pos").collect()]
    want, last = [], -100
    for i in np.flatnonzero(hit):
        if i - last > 6:
            want.append(int(i))
            last = i
    assert got == want


def test_f0_and_reference_profile(spark):
    x = tone(100, 8000, 1, 0.5)
    s = repair.segment_characteristics(frames(spark, x), 8000, 2000).filter("segment = 0").first()
    assert s.f0_hz == pytest.approx(100, rel=0.02) and s.correlation == pytest.approx(1.0)
    assert s.harmonicity == pytest.approx(np.clip(s.crest_db / 20, 0.2, 0.95))
    p = repair.reference_profile(frames(spark, x), 8000).first()
    assert p.integrated_lufs == pytest.approx(20 * np.log10(0.5 / np.sqrt(2)) - 0.691, abs=0.01)
    assert p.bass_db > p.mid_db


def test_profiles_against_a_plain_loop(spark):
    l, r = noise() * 2, noise(seed=9) * 2
    got = {x.profile: x for x in repair.profile_fanout(frames(spark, l, r), 44100.0, block=128).collect()}
    name, lo, hi, emph, mono, top_db = repair.PROFILES[3]
    top, chans = 10 ** (top_db / 20), []
    for x in (l, r):
        keep = (1 / (2 * np.pi * lo)) / (1 / (2 * np.pi * lo) + 1 / 44100)
        hp = keep * (x - np.concatenate([[0], x[:-1]]))
        y = sequential(fl.one_pole(fl.rc_alpha(hi, 44100)), hp) * 10 ** (emph * 0.25 / 20)
        chans.append(np.where(y > top, top + (y - top) * 0.2, np.where(y < -top, -top + (y + top) * 0.2, y)))
    m = (chans[0] + chans[1]) / 2
    assert got[name].peak == pytest.approx(np.abs(m).max()) and got[name].rms == pytest.approx(np.sqrt(np.mean(m**2)))


def test_chunked_function_is_stitched_back(spark):
    from signalmill.operators import frames as fr

    x = noise(150)
    y = values(fr.map_chunks(long(spark, x), 32, 8, lambda v: v * 2), "frame_ix", "x")[0]
    assert np.allclose(y, x * 2)


def test_whole_series_by_default(spark):
    n = 3 * 4096 + 1000
    x = np.zeros(n)
    x[8192:] = tone(1000, 8000, 1, 0.5)[: 100][np.arange(n - 8192) % 8]  # the reference's first 512 samples are silent
    p = repair.reference_profile(frames(spark, x), 8000).first()
    total = np.zeros(2049)
    for a in range(0, n, 4096):
        part = x[a: a + 4096]
        total += np.abs(np.fft.rfft(part, 4096)) ** 2 / len(part) ** 2 * len(part) / n
    hz = np.arange(1, 2048) * 8000 / 4096
    assert p.mid_db == pytest.approx(10 * np.log10(total[1:2048][(hz >= 500) & (hz < 2000)].mean()), abs=1e-6)
    assert repair.reference_profile(frames(spark, x), 8000, head=512, max_bins=256).first().mid_db == -70.0

    y = np.concatenate([np.sin(np.arange(40) / 8) * 0.5, np.ones(60), np.sin(np.arange(40) / 8) * 0.5])
    assert repair.declip(long(spark, y), 0.98, block=50).filter("repaired").count() == 60
    assert repair.declip(long(spark, y), 0.98, longest=31, block=50).filter("repaired").count() == 0
    late = np.concatenate([tone(100, 8000, 1, 0.5)[:1024], tone(3000, 8000, 1, 0.5)[:3072]])
    assert repair._centroid(late, 8000) > 2000 > repair._centroid(late, 8000, longest=1024)


def test_last_window_and_all_resonances(spark):
    from signalmill.operators import spectrum
    from signalmill.plans import issues

    for n in (64 + 5, 64 + 2, 64 + 1):
        got = spectrum.window_band_powers(long(spark, noise(n)).select("track_id", "frame_ix", "x"), 8000, 64, 4, 200.0, 1, block=128)
        assert {r.win for r in got.collect()} == {0, 1} and got.filter("power IS NULL OR isnan(power)").count() == 0
    names = re.findall(r'c\("(\w+)"\)', inspect.getsource(issues.build_findings))
    rows = spark.range(2).select(F.lit(7).alias("track_id"), *[F.lit(0.0).alias(k) for k in sorted(set(names) - {"resonances"})], F.expr(
        "CASE WHEN id = 0 THEN transform(sequence(1, 5), i -> struct(i * 1000.0D AS frequency_hz, 0.5D AS persistence, "
        "0.9D AS severity, 0.0D AS first_s, 1.0D AS last_s)) END").alias("resonances"))
    found = [r.id for r in issues.build_findings(rows).collect()]
    assert sorted(f for f in found if f.startswith("resonance")) == [f"resonance_{i}" for i in range(5)]
    assert sum(r.id.startswith("resonance") for r in issues.build_findings(rows, 3).collect()) == 3
    assert found.count("flattened_dynamics") == 2
