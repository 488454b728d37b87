"""Plans as nested columns: made without walking arrays, edited at several places, written as lines of text."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalmill.plans import graph as g
from signalmill.plans import planner as pl

MEASURES = dict(integrated_lufs=-14.0, true_peak_dbtp=0.2, crest_db=7.0, plr_db=8.0, short_term_variation=6.0, sub=0.3, bass=0.3, upper_mid=0.3,
                high=0.15, centroid_hz=3500.0, max_abs_dc=0.01, clipped_samples=0, channels=2, correlation=0.8, low_width=0.3, mid_width=0.2)


def plans(spark, **changes):
    rows = [tuple([i, *(MEASURES | changes).values()]) for i in range(2)]
    types = [f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in MEASURES.items()]
    return pl.plan_ab(spark.createDataFrame(rows, ", ".join(["track_id int", *types])))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plans_are_made_without_lambdas(spark):
    assert "lambda" not in optimized(plans(spark))
    ids = {r.variant: [n["id"] for n in r.nodes] for r in plans(spark).collect()}
    assert ids == {"a": ["a_pre_gain", "a_tonal_eq", "a_low_dynamic_eq", "a_upper_mid_dynamic_eq", "a_glue", "a_multiband_control", "a_transient_restore",
                         "a_saturation", "a_stereo", "a_clipper", "a_limiter"],
                   "b": ["b_pre_gain", "b_tonal_eq", "b_glue", "b_low_end_stereo_safety", "b_limiter"]}
    none = plans(spark, **dict.fromkeys(
        ["sub", "upper_mid", "high", "max_abs_dc", "short_term_variation", "crest_db", "channels", "clipped_samples"])).where("track_id = 0 and variant = 'a'")
    assert [n["id"] for n in none.first().nodes] == ["a_pre_gain", "a_glue", "a_transient_restore", "a_clipper", "a_limiter"]


def test_controls_are_placed_in_one_step(spark):
    styles = dict(style_target_lufs=-11.0, style_bass_db=1.0, style_presence_db=0.0, style_width=1.1, style_punch=0.9, style_warmth=0.5)
    p = plans(spark).withColumns({k: F.lit(v) for k, v in styles.items()})
    made = pl.apply_controls(p)
    ids = {r.variant: [n["id"] for n in r.nodes] for r in made.collect()}
    extra = ["user_punch", "user_width", "user_warmth"]
    assert ids["a"][4:6] == ["a_user_tone", "a_glue"] and ids["a"][-5:] == [*[f"a_{x}" for x in extra], "a_clipper", "a_limiter"]
    assert ids["b"][2:4] == ["b_user_tone", "b_glue"] and ids["b"][-4:] == [*[f"b_{x}" for x in extra], "b_limiter"]


@pytest.mark.parametrize("ids, want", [
    ("g m c", "1 g m 2 3 c"), ("c m g", "2 3 c m 1 g"), ("m c", "m 2 3 c 1"), ("g m", "1 g m 2 3"), ("m", "m 1 2 3"), ("", "1 2 3"),
    ("g g c", "1 g 1 g 2 3 c"), ("g c m c", "1 g 2 3 c m 2 3 c"), ("g c", "1 g 2 3 c"), ("c", "2 3 c 1")])
def test_insertion_at_several_places(spark, ids, want):
    rows = [([(i, "gain", False, None, None) for i in ids.split()],)]
    df = spark.createDataFrame(rows, f"nodes {g.NODES}")
    one, two, three = (g.node(x, "gain").cast(g.NODE) for x in "123")
    out = df.select(g.insert_all(F.col("nodes"), ("g", one), (F.lit("c"), [(F.lit(True), two)], [(F.lit(False), one)], F.lit(None).cast(g.NODE), three)).alias("n"))
    assert " ".join(n["id"] for n in out.first().n) == want
    kept = df.select(g.insert_before(F.col("nodes"), F.lit(None).cast("string"), one).alias("n")).first().n
    assert [n["id"] for n in kept] == ids.split()


def test_lines_of_odd_nodes(spark):
    rows = [
        (1, [("a", "gain", False, {"z": 1.00005, "b": -0.00001, "a": 2.5, "n": None}, None),
             ("b", "eq", True, None, [("peak", 3500.05, -0.0005, 0.7075), ("low", None, 1.0, 2.0), (None, 1.0, 1.0, 1.0)]),
             ("c", "x", None, {}, []), (None, None, None, None, None), None]),
        (2, None), (3, []),
        (4, [("q", "gain", False, {"é": float("nan"), "e": float("inf"), "Z": 123456.78905, "zz": 1e-9, "y": -1234.56785}, None)])]
    df = spark.createDataFrame(rows, f"i int, nodes {g.NODES}").coalesce(1)
    lines = g.describe(F.col("nodes"))
    got = {r.i: r.t for r in df.select("i", lines.alias("t")).collect()}
    assert got == {1: ["a gain a=2.5000 b=0.0000 z=1.0001", "b eq off peak@3500.1:-0.001:0.708", "c x  ", "", ""], 2: None, 3: [],
                   4: ["q gain Z=123456.7891 y=-1234.5679 zz=0.0000"]}
    assert "transform" not in optimized(df.select(lines))
    large = spark.createDataFrame([([("a", "gain", False, {"a": 1e14}, None)],)], f"nodes {g.NODES}")
    with pytest.raises(Exception, match="decimal"):
        large.select(lines).collect()


def test_numbers_are_written_as_decimal_casts_write_them(spark):
    rng = random.Random(5)
    v = [0.0, -0.0, 0.00005, -0.00005, 0.00004999, 1e12, 1e-320, *[round(rng.uniform(-9, 9), 5) for _ in range(2000)],
         *[rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 13) for _ in range(2000)]]
    for digits in (4, 3, 1):
        df = spark.createDataFrame(pa.table({"v": pa.array(v), "t": g._fixed(pa.array(v), digits, True)}))
        assert not df.where(F.col("t") != F.col("v").cast(f"decimal(18,{digits})").cast("string")).count()
