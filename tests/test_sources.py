import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalmill.functions import filters as fl
from signalmill.operators.scans import run_linear
from signalmill.sources import identity, logs, wav
from signalmill.streaming import stateful, windows
from signalmill.streaming.runner import run_available


def wav_bytes(x, rate, kind="pcm16"):
    n, ch = x.shape
    if kind == "pcm16":
        code, bits, raw = 1, 16, (x * 32768).astype("<i2").tobytes()
    elif kind == "pcm24":
        v = (x * 8388608).astype(np.int32).reshape(-1)
        code, bits, raw = 1, 24, b"".join(int(i).to_bytes(3, "little", signed=True) for i in v)
    else:
        code, bits, raw = 3, 32, x.astype("<f4").tobytes()
    fmt = struct.pack("<HHIIHH", code, ch, rate, rate * ch * bits // 8, ch * bits // 8, bits)
    junk = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + junk + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture
def corpus(tmp_path):
    x = np.round(np.sin(np.arange(800) / 8000 * 2 * np.pi * 440) * 10000)[:, None] / 32768
    (tmp_path / "mono.wav").write_bytes(wav_bytes(x, 8000))
    y = np.stack([np.linspace(-1, .9, 300), np.linspace(.5, -.5, 300)], axis=1)
    (tmp_path / "stereo24.wav").write_bytes(wav_bytes(y, 44100, "pcm24"))
    (tmp_path / "float.wav").write_bytes(wav_bytes(y, 44100, "float"))
    (tmp_path / "broken.wav").write_bytes(b"RIFF0000WAVEnope")
    return tmp_path, x, y


def test_wav_corpus(spark, corpus):
    folder, x, y = corpus
    tracks, blocks = wav.read_wav_corpus(spark, str(folder), block=128)
    t = {r.track_id.rsplit("/", 1)[1]: r for r in tracks.collect()}
    assert (t["mono.wav"].sample_rate, t["mono.wav"].frames, t["mono.wav"].sample_format) == (8000, 800, "pcm16")
    assert t["broken.wav"].status == "error" and t["stereo24.wav"].channels == 2
    b = blocks.filter(F.col("track_id").endswith("mono.wav")).orderBy("block_ix").collect()
    assert [r.n for r in b] == [128] * 6 + [32] and [r.is_last for r in b] == [False] * 6 + [True]
    assert np.allclose(np.concatenate([r.ch[0] for r in b]), x[:, 0], atol=1e-7)
    for name, tol in (("stereo24.wav", 2e-7), ("float.wav", 1e-7)):
        f = wav.blocks_to_frames(blocks.filter(F.col("track_id").endswith(name))).orderBy("frame_ix").toPandas()
        assert np.allclose(f[["l", "r"]].to_numpy(), y, atol=tol)


def test_wav_data_source_reads_the_same_blocks(spark, corpus):
    folder, x, _ = corpus
    spark.dataSource.register(wav.WavDataSource)
    got = spark.read.format("wav_blocks").option("block", 128).option("blocksPerTask", 2).option("path", str(folder)).load()
    rows = got.filter(F.col("track_id").endswith("mono.wav")).orderBy("block_ix").collect()
    assert len(rows) == 7 and np.allclose(np.concatenate([r.ch[0] for r in rows]), x[:, 0], atol=1e-7)


def test_event_log(spark, tmp_path):
    log, out, other = (str(tmp_path / n) for n in ("log", "out", "other"))
    e = spark.createDataFrame([("1", 5, 1, 0.2, "a"), ("2", 6, 1, 0.4, "b")], "event_id string, timestamp_ms bigint, event_type int, delta_lufs double, profile_name string")
    logs.append_events(e, log)
    logs.append_events(e.filter("profile_name = 'a'").withColumn("event_id", F.lit("3")), log)
    a = logs.read_event_log(spark, log, "a")
    assert a.count() == 2 and a.first().delta_punch == 0.0
    assert logs.read_event_log(spark, log, "none").count() == 0
    logs.export_all(spark, log, out)
    logs.import_all(spark, out, other)
    assert logs.read_event_log(spark, other).groupBy("profile_name").count().count() == 2
    logs.import_all(spark, out, str(tmp_path / "third"), "default")
    assert logs.read_event_log(spark, str(tmp_path / "third"), "default").count() == 3
    logs.reset_profile(spark, log, "a")
    assert logs.read_live_events(spark, log, "a").count() == 0 and logs.read_live_events(spark, log, "b").count() == 1


STUDY_LINE = ('{"trackId":"x","category":"c","alreadyGood":true,"sourceGuidanceApplied":true,"blindPreference":"%s","artifactAudible":false,'
              '"transientDamage":false,"monoCompatibilityWorse":false,"stereoImageWorse":false,"sectionConsistencyWorse":false,"tonalSideEffect":%s}')


def test_study_lines(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text("\n".join(["# head", "", STUDY_LINE % ("tie", "false"), STUDY_LINE % ("none", "false"), STUDY_LINE % ("guided", '"no"'), "not json"]))
    rows = logs.read_study(spark, str(p)).collect()
    errors = sorted(tuple(r.errors) for r in rows)
    assert len(rows) == 4 and () in errors and ("unknown preference",) in errors and ("tonalSideEffect must be boolean",) in errors
    with pytest.raises(Exception, match="invalid study record"):
        logs.read_study(spark, str(p), fail_fast=True).collect()


def test_incremental_work(spark, tmp_path):
    store, calls = str(tmp_path / "store"), []
    w = spark.createDataFrame([(f"k{i}", i) for i in range(6)], "work_key string, v int")

    def process(todo):
        calls.append(todo.count())
        return todo.withColumn("status", F.when((F.col("v") == 3) & F.lit(len(calls) == 1), "failed").otherwise("complete"))

    assert identity.run_incremental(w, store, process).count() == 5
    assert identity.run_incremental(w, store, process).count() == 6
    assert calls == [6, 1]


def block_files(spark, folder, order, last=9):
    rng = np.random.default_rng(0)
    xs = [rng.normal(size=16).tolist() for _ in range(last + 1)]
    for batch, group in enumerate(order):
        rows = [(1, i, xs[i], [-2 * v for v in xs[i]], i == last) for i in group]
        spark.createDataFrame(rows, "track_id bigint, block_ix bigint, l array<double>, r array<double>, is_last boolean").coalesce(1).write.mode("append").parquet(folder)
    return np.concatenate(xs)


@pytest.mark.parametrize("order", [[range(10)], [[3, 1], [0, 2, 3], [9, 5], [4, 6, 8], [7, 0]]])
def test_stream_filter_ignores_batching_order_and_repeats(spark, tmp_path, order):
    folder = str(tmp_path / "blocks")
    x = block_files(spark, folder, order)
    schema = spark.read.parquet(folder).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sys = fl.design("low_pass", 1000, 8000)
    rows = run_available(stateful.stream_filter(s, sys), "append", rocksdb=True).orderBy("block_ix").collect()
    assert [r.block_ix for r in rows] == list(range(10)) and [r.is_last for r in rows] == [False] * 9 + [True]
    want = run_linear(sys, x[None, :], np.zeros((1, 2)))[0][0]
    assert np.allclose(np.concatenate([r.l for r in rows]), want) and np.allclose(np.concatenate([r.r for r in rows]), -2 * want)


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "ev")
    for ts in (["2024-01-01 10:00:00", "2024-01-01 10:05:00"], ["2024-01-01 20:00:00"], ["2024-01-01 20:05:00"],
               ["2024-01-01 10:01:00", "2024-01-01 20:10:00"]):
        spark.createDataFrame([(t, 1.0) for t in ts], "t string, x double").select(
            F.col("t").cast("timestamp").alias("ts"), "x", F.lit("s").alias("source")).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    s = windows.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "ts", "1 hour")
    out = run_available(windows.level_windows(s, "1 hour"), "append").collect()
    closed = {r.start.hour: r.n for r in out}
    assert closed.get(10) == 2  # the row that came ten hours late is not counted


def test_failures_stay_with_their_row(spark):
    df = spark.createDataFrame([(4.0,), (-1.0,)], "v double")

    def root(v):
        if v < 0:
            raise ValueError("negative")
        return v**0.5

    got = {r.v: r for r in stateful.isolate_failures(df, root, "v", "y").collect()}
    assert got[4.0].y == 2.0 and got[-1.0].status == "failed" and got[-1.0].error == "negative"


def wave(chunks, kind=b"RIFF"):
    return kind + (0xFFFFFFFF).to_bytes(4, "little") + b"WAVE" + b"".join(n + k.to_bytes(4, "little") + b for n, k, b in chunks)


def test_header_behind_long_chunks_and_rf64():
    import struct

    from signalmill.sources.wav import parse_header

    fmt = (b"fmt ", 16, struct.pack("<HHIIHH", 1, 2, 48000, 192000, 4, 16))
    late = wave([fmt, (b"LIST", 70_000, bytes(70_000)), (b"data", 40, bytes(40))])
    assert parse_header(late, len(late))["frames"] == 10
    sizes = struct.pack("<QQQI", 0, 40, 10, 0)
    long = wave([(b"ds64", 28, sizes), fmt, (b"data", 0xFFFFFFFF, bytes(40)), (b"LIST", 24, bytes(24))], b"RF64")
    assert parse_header(long, len(long))["frames"] == 10


def test_events_without_id_stay_and_markers_do_not(spark, tmp_path):
    from signalmill.sources import logs

    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([(None, "p"), ("a", "p"), ("b", "q")], "event_id string, profile_name string")
    rows.write.partitionBy("profile_name").json(folder)
    assert logs.read_live_events(spark, folder, "p").count() == 2
    logs.reset_profile(spark, folder, "p")
    assert logs.read_event_log(spark, folder).count() == 1


def test_pushed_ranges_of_a_sparse_file_above_2_gb(spark, tmp_path):
    """Only the wanted range is opened, by the data source and by the job; six channels come back."""
    import struct

    channels, frames, at = 6, 200_000_000, 190_000_000
    width = channels * 2
    head = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, frames * width, frames, 0)
    head += b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, 48000, 48000 * width, width, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF)
    values = (np.arange(600 * channels).reshape(600, channels) % 3000).astype("<i2")
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(head)
        f.seek(len(head) + at * width)
        f.write(values.tobytes())
        f.truncate(len(head) + frames * width)
    (tmp_path / "short.wav").write_bytes(wav_bytes(np.zeros((10, 1)), 8000))
    track = spark.createDataFrame([(str(tmp_path / "long.wav"), frames, "ok")], "track_id string, frames long, status string")
    first = at // 1000
    job = wav.read_blocks(track, 1000, first=first, last=first + 1).collect()
    assert len(job) == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(wav.WavDataSource)
    df = spark.read.format("wav_blocks").option("block", 1000).option("blocksPerTask", 2).option("pushdown", "true").option("path", str(tmp_path)).load()
    df = df.filter((F.col("block_ix") >= first) & (F.col("block_ix") < first + 3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() == 2 and ">=" not in plan and "<" not in plan
    rows = df.orderBy("block_ix").collect()
    assert [r.block_ix for r in rows] == [first, first + 1, first + 2] and all(len(r.ch) == 6 for r in rows)
    assert np.allclose(np.array(rows[0].ch)[:, :600].T, values / 32768.0) and job[0].ch == rows[0].ch
    assert df.filter("block_ix = 5").count() == 0
    own = df.filter(F.col("track_id") == str(tmp_path / "short.wav"))
    assert own.rdd.getNumPartitions() == 1 and own.count() == 0
    t = {r.track_id.rsplit("/", 1)[1]: r for r in wav.read_tracks(spark, str(tmp_path)).collect()}
    assert (t["long.wav"].frames, t["long.wav"].channels, t["short.wav"].frames) == (frames, 6, 10)
    s = wav.blocks_to_samples(df.filter(F.col("block_ix") == first)).filter("frame_ix = %d" % (at + 7)).orderBy("ch").collect()
    assert [r.x for r in s] == (values[7] / 32768.0).tolist()


def test_interval_amounts_are_a_sweep(spark):
    """Against every interval at every frame, and with very many that overlap."""
    from signalmill.operators import pairing as pa

    rng = np.random.default_rng(3)
    frames = [(t, i) for t in ("a", "b", "c") for i in range(0, 400, 1 if t == "a" else 3)]
    rows = [(t, float(s), float(e), float(a)) for t in ("a", "b") for s, e, a in zip(rng.random(40) * 5 - 0.5, rng.random(40) * 5, rng.normal(0, 1, 40))]
    rows += [("a", None, None, 0.25), ("a", None, None, 1.0), ("b", 0.31, 0.31, 9.0), ("b", 0.07, None, 9.0), ("z", 0.0, 1.0, 1.0), ("a", 0.29, 0.57, 2.0)]
    f = spark.createDataFrame(frames, "track_id string, frame_ix long")
    iv = spark.createDataFrame(rows, "track_id string, start_s double, end_s double, amount double")
    got = {(r.track_id, r.frame_ix): r.amount for r in pa.interval_amounts(f, iv, 100.0, 0.5).collect()}
    assert len(got) == len(frames)
    for t, i in frames:
        want = sum(a for u, s, e, a in rows if u == t and (s is None or (e is not None and s <= i / 100.0 < e)))
        assert abs(got[t, i] - want) < 1e-9
    many = spark.range(10_000).select(F.lit("a").alias("track_id"), (F.col("id") * 1e-5).alias("start_s"), F.lit(3.0).alias("end_s"), F.lit(1.0).alias("amount"))
    out = pa.interval_amounts(f, many, 100.0, 0.5)
    assert out.count() == len(frames) and out.filter("track_id = 'a' AND frame_ix = 200").first().amount == 10_000.0


def test_stored_blocks_are_read_by_range(spark, tmp_path):
    from signalmill.operators import frames as fr

    spark.range(1000).select(F.lit("t").alias("track_id"), F.col("id").alias("block_ix")).write.parquet(str(tmp_path / "b"))
    df = fr.scan_blocks(spark.read.parquet(str(tmp_path / "b")), 5, 7)
    assert "GreaterThanOrEqual(block_ix,5)" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 3


def test_a_fold_is_the_same_in_batch_and_stream(spark, tmp_path):
    from signalmill.operators import folding as fo

    class Spread(fo.Fold):
        schema = "n bigint, low double, high double"

        def start(self):
            return np.array([0.0, np.inf, -np.inf])

        def update(self, state, rows):
            v = rows["v"].dropna()
            return self.merge(state, np.array([len(v), v.min(), v.max()])) if len(v) else state

        def merge(self, a, b):
            return np.array([a[0] + b[0], min(a[1], b[1]), max(a[2], b[2])])

        def finish(self, state):
            return int(state[0]), *(None if np.isinf(x) else float(x) for x in state[1:])

    df = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), F.lit("x").alias("_part0"),
                                  F.when(F.col("id") % 11 != 0, F.sin("id")).alias("v")).repartition(9)
    want = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(F.count("v"), F.min("v"), F.max("v")).collect()}
    for fan in (1, 4):
        assert {r.k: tuple(r)[1:] for r in fo.fold_rows(df, ["k"], Spread(), fan).collect()} == want
    assert fo.fold_rows(df.limit(0), ["k"], Spread()).count() == 0
    empty = fo.fold_rows(df.filter("v IS NULL"), ["k"], Spread()).first()
    assert (empty.n, empty.low) == (0, None)
    df.coalesce(3).write.parquet(str(tmp_path / "v"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    rows = run_available(fo.fold_stream(s, ["k"], Spread()), "update", ["k"]).collect()
    assert {r.k: tuple(r)[1:] for r in rows} == want


def test_table_functions(spark):
    from signalmill.functions.tables import register_expansion

    register_expansion(spark)
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT * FROM expansion('levels', 1000, 256, 4)") == [(0, 256, 4), (1, 1024, 1)]
    assert rows("SELECT lag FROM expansion('lags', 100, 20, 25)") == [(4,), (5,)]
    assert rows("SELECT round(frequency_hz, 6) FROM expansion('bands', 3, 100.0D, 400.0D)") == [(100.0,), (200.0,), (400.0,)]
    assert rows("SELECT * FROM expansion('bands', CAST(NULL AS INT), 1, 2)") == [] and rows("SELECT * FROM expansion('levels', 0, 1, 2)") == []
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM expansion('octaves', 3, 1, 2)").collect()
