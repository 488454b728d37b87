"""Series that a task takes through their whole plan, against the same series taken stage by stage."""

import numpy as np
import pytest
from helpers import frames, values
from pyspark.sql import functions as F
from test_planned import K, RATE, noise, plan_rows

from signalmill.operators import planned, whole
from signalmill.operators import scans as sc


def blocks(spark, series, block=64):
    f = None
    for name, (l, r) in series.items():
        own = frames(spark, l, r, name)
        f = own if f is None else f.unionByName(own)
    return sc.to_blocks(f, K, "frame_ix", ["l", "r"], block)


def result(b, plans, name, block=64, **how):
    out = sc.from_blocks(planned.run_plans(b, plans, RATE, block, **how), K, "frame_ix", ["l", "r"], block)
    return values(out.where(F.col("track_id") == name), "frame_ix", "l", "r")


def test_a_plan_is_run_in_one_task(spark, monkeypatch):
    written = []
    monkeypatch.setattr(planned, "cut_lineage", lambda df, cut=planned.cut_lineage: written.append(df) or cut(df))
    made = planned.run_plans(blocks(spark, {"a": (noise(1), noise(2)), "b": (noise(3, 90), noise(4, 90))}), plan_rows(spark), RATE, 64)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(written) <= 2 and "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1


def test_long_series_go_stage_by_stage(spark, monkeypatch):
    series = {"a": (noise(1, 400), noise(2, 400)), "c": (noise(3, 130), noise(4, 130))}
    p = plan_rows(spark).where("track_id in ('a', 'c')")
    want = {name: result(blocks(spark, {name: x}), p, name) for name, x in series.items()}
    monkeypatch.setattr(whole, "FRAMES", 200)
    seen = []
    monkeypatch.setattr(planned, "_staged", lambda b, *rest, run=planned._staged: seen.extend(r[0] for r in b.select("track_id").distinct().collect()) or run(b, *rest))
    made = sc.from_blocks(planned.run_plans(blocks(spark, series), p, RATE, 64), K, "frame_ix", ["l", "r"], 64)
    for name in series:
        for x, y in zip(values(made.where(F.col("track_id") == name), "frame_ix", "l", "r"), want[name]):
            assert len(x) == len(series[name][0]) and np.allclose(x, y, atol=1e-9)
    assert seen == ["a"]


def test_series_that_numbers_alone_do_not_tell_go_stage_by_stage(spark):
    l = noise(5, 200)
    b = blocks(spark, {n: (l, l) for n in "abcd"})
    b = b.withColumn("l", F.when(F.col("track_id") == "b", F.transform("l", lambda v, i: F.when((i != 3), v))).when(
        F.col("track_id") == "c", F.transform("l", lambda v, i: F.when(i == 5, float("nan")).otherwise(v))).otherwise(F.col("l")))
    b = b.where("track_id <> 'd' or block_ix <> 1")
    p = plan_rows(spark).select(F.explode(F.array(*[F.lit(n) for n in "abcdef"])).alias("track_id"), "nodes").where("size(nodes) = 1")
    active = p.select("track_id", F.transform("nodes", lambda n: planned._in_numbers(n, RATE)).alias("_plan"))
    active = active.unionByName(active.where("track_id = 'f'")).withColumn(
        "_plan", F.when(F.col("track_id") == "e", F.transform("_plan", lambda n: n.withField("values", F.array(F.lit(float("inf")))))).otherwise(F.col("_plan")))
    assert sorted(r[0] for r in planned._alone(b, active, 64).collect()) == list("bcdef")


def test_series_without_a_plan(spark):
    b = blocks(spark, {"a": (noise(1, 90), noise(2, 90)), "other": (noise(3, 90), noise(4, 90))})
    assert np.array_equal(result(b, plan_rows(spark), "other")[0], noise(3, 90))
    assert not len(result(b, plan_rows(spark), "other", left=False)[0]) and len(result(b, plan_rows(spark), "a", left=False)[0]) == 90


def test_series_are_cut_out_of_batches(spark, monkeypatch):
    """Series end inside batches, and groups of series end before a batch does."""
    series = {f"s{i:02}": (noise(i, 40 + 13 * i), noise(i + 90, 40 + 13 * i)) for i in range(12)}
    nodes = plan_rows(spark).where("track_id = 'a'").select("nodes")
    p = nodes.select(F.explode(F.array(*[F.lit(n) for n in series])).alias("track_id"), "nodes")
    b = blocks(spark, series, 32)
    want = {n: result(b, p, n, 32) for n in ("s00", "s05", "s11")}
    monkeypatch.setattr(whole, "FRAMES", 190)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for name in want:
            for x, y in zip(result(b, p, name, 32), want[name]):
                assert np.allclose(x, y, atol=1e-9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("rows, n", [(1, 1000), (3, 640), (9, 200), (2, 70)])
def test_long_rows_are_limited_side_by_side(rows, n):
    rng = np.random.default_rng(n)
    t, start = rng.uniform(0.2, 1.0, (rows, n)), rng.uniform(0.1, 1.0, rows)
    assert np.allclose(sc.limit(t, start, 0.97), sc.run_limiter(t, start, 0.97), atol=1e-12)
