"""Plans that differ between series against one plan run for each series alone."""
import numpy as np
import pytest
from helpers import frames, values
from pyspark.sql import functions as F

from signalmill.operators import dynamics as dy
from signalmill.operators import planned
from signalmill.operators import scans as sc
from signalmill.plans import graph as g

RATE = 1000.0
K = ["track_id"]
BAND = dict(shape="peak", frequency_hz=90.0, gain_db=4.0, q=1.1)
SHELF = dict(shape="low_shelf", frequency_hz=40.0, gain_db=-3.0, q=0.7)
PLANS = {
    "a": [("gain", dict(gain_db=2.0)), ("eq", [BAND, SHELF]), ("dynamic_eq", dict(frequency_hz=80.0, threshold_db=-20.0)),
          ("compressor", dict(threshold_db=-14.0, ratio=3.0, attack_ms=5.0, release_ms=60.0, makeup_db=1.0, mix=0.7)), ("multiband", dict(
              low_crossover_hz=60.0, high_crossover_hz=200.0)), ("transient", dict(attack_db=2.0, sustain_db=-0.3, fast_ms=3.0, slow_ms=35.0, mix=0.7)),
          ("saturation", dict(drive_db=3.0, mix=0.2)), ("stereo", dict(width=1.2, bass_mono_hz=40.0)), ("clipper", dict(threshold_db=-2.0, softness=0.3)),
          ("limiter", dict(ceiling_db=-1.0, release_ms=50.0))],
    "b": [("limiter", dict(ceiling_db=-3.0, release_ms=20.0)), ("stereo", dict(width=0.5, bass_mono_hz=70.0)), ("eq", [SHELF]), ("gain", dict(gain_db=-1.0))],
    "c": [("compressor", dict(threshold_db=-20.0, ratio=2.0, attack_ms=2.0, release_ms=200.0)), ("compressor", dict(threshold_db=-10.0))],
    "d": [],
}


def noise(seed, n=700):
    return np.random.default_rng(seed).normal(0, 0.5, n)


def plan_rows(spark):
    rows = []
    for name, nodes in PLANS.items():
        made = [(f"{name}{i}", kind, False, None if kind == "eq" else {k: float(v) for k, v in p.items()},
                 [tuple(x[k] for k in ("shape", "frequency_hz", "gain_db", "q")) for x in p] if kind == "eq" else None) for i, (kind, p) in enumerate(nodes)]
        made.append((f"{name}_off", "gain", True, {"gain_db": 60.0}, None))
        rows.append((name, made))
    return spark.createDataFrame(rows, f"track_id string, nodes {g.NODES}")


@pytest.mark.parametrize(("block", "group"), [(64, 3), (1024, 256)])
def test_every_series_gets_its_own_plan(spark, monkeypatch, block, group):
    monkeypatch.setattr(sc, "GROUP", group)
    f = None
    for i, name in enumerate([*PLANS, "none"]):
        own = frames(spark, noise(i), noise(i + 50), name)
        f = own if f is None else f.unionByName(own)
    b = sc.to_blocks(f, K, "frame_ix", ["l", "r"], block)
    got = sc.from_blocks(planned.run_plans(b, plan_rows(spark), RATE, block), K, "frame_ix", ["l", "r"], block)
    for i, name in enumerate([*PLANS, "none"]):
        l, r = values(got.where(F.col("track_id") == name), "frame_ix", "l", "r")
        nodes = [{"id": str(j), "type": kind, "params": {"bands": p} if kind == "eq" else p} for j, (kind, p) in enumerate(PLANS.get(name, []))]
        if nodes:
            alone = sc.to_blocks(frames(spark, noise(i), noise(i + 50)), K, "frame_ix", ["l", "r"], 1024)
            alone = sc.from_blocks(dy.run_graph(alone, nodes, RATE, 1024), K, "frame_ix", ["l", "r"], 1024)
            want = values(alone, "frame_ix", "l", "r")
        else:
            want = noise(i), noise(i + 50)
        assert np.allclose(l, want[0], atol=1e-9) and np.allclose(r, want[1], atol=1e-9), name


def test_bad_plans_are_refused(spark):
    b = sc.to_blocks(frames(spark, noise(1, 50), None, "x"), K, "frame_ix", ["l", "r"], 64)
    for nodes in ([("n", "gain", False, {}, None), ("n", "gain", False, {}, None)], [("n", "reverb", False, {}, None)], [],
                  [("n", "compressor", False, {"ratio": 0.5}, None)]):
        with pytest.raises(Exception, match="plan|reverb|empty"):
            planned.run_plans(b, spark.createDataFrame([("x", nodes)], f"track_id string, nodes {g.NODES}"), RATE, 64).collect()
