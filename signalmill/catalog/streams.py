"""Streaming queries: the given tables as streams, checked against the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters as fl
from ..operators.collections import preference_vector
from ..operators.scans import from_blocks, to_blocks
from ..sources.adapters import sig_embed, table
from ..streaming import stateful as stt
from ..streaming import windows as win
from ..streaming.runner import run_available, scratch_folder, table_stream, with_end
from . import query
from .common import SIG_EMBED, rd
from .measure import rounded

EVENTS = "ev AS (SELECT event_type AS source, user_id, ts, value / 500.0 AS x FROM events)"


def event_stream(spark, sf, lateness="1 hour", name=None):
    e = table_stream(spark, sf, "events").select(
        F.col("event_type").alias("source"), "user_id", "event_id", "ts", (F.col("value") / 500.0).alias("x"), "value", "props")
    return win.with_event_time(e, "ts", lateness, name)


def seconds(df):
    return rounded(df.withColumns({c: F.unix_timestamp(c) for c in ("start", "end")}))


@query("s2_tumbling_windows", f"""WITH {EVENTS} SELECT source, epoch(date_trunc('day', ts))::BIGINT AS start, epoch(date_trunc('day', ts))::BIGINT + 86400 AS "end",
  count(*) AS n, {rd('sqrt(avg(x * x))')} AS rms, {rd('max(abs(x))')} AS peak FROM ev GROUP BY ALL""")
def s2(spark, sf):
    return seconds(run_available(win.level_windows(event_stream(spark, sf), "1 day"), "update", ["source", "start"], "tumbling"))


@query("s3_sliding_windows", f"""WITH {EVENTS}, w AS (SELECT *, epoch(date_trunc('day', ts))::BIGINT - k * 86400 AS start FROM ev, (VALUES (0), (1), (2)) AS o(k))
SELECT source, start, start + 3 * 86400 AS "end", count(*) AS n, {rd('sqrt(avg(x * x))')} AS rms, {rd('max(abs(x))')} AS peak FROM w GROUP BY ALL""")
def s3(spark, sf):
    return seconds(run_available(win.level_windows(event_stream(spark, sf), "3 days", "1 day"), "update", ["source", "start"], "sliding"))


SESSIONS_SQL = f"""WITH {EVENTS},
c AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM ev),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM c)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT + 6 * 3600 AS "end", count(*) AS n, {rd('max(x)')} AS peak
FROM g GROUP BY user_id, s"""


@query("s4_session_windows", SESSIONS_SQL)
def s4(spark, sf):
    # sessions are emitted when the watermark passes them; on a table all are complete
    batch = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500).alias("x"))
    return seconds(win.sessions(batch, "6 hours"))


@query("s4_session_stream", SESSIONS_SQL)
def s4_stream(spark, sf):
    """Sessions that are open when the input ends are closed by its end."""
    rows, finish = with_end(table_stream(spark, sf, "events").select("user_id", "ts", (F.col("value") / 500.0).alias("x")), "ts")
    return seconds(run_available(win.sessions(win.with_event_time(rows), "6 hours"), "append", (), "session", finish))


@query("s8_watermark", f"SELECT event_type AS source, count(*) AS n, {rd('max(value)')} AS peak FROM events GROUP BY 1")
def s8(spark, sf):
    """The table is one batch, so nothing is late; the test suite feeds late rows."""
    e = event_stream(spark, sf, "1 hour", "arrivals").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return rounded(run_available(e, "update", ["source"], "watermark"))


BLOCK = 64


def block_stream(spark, sf, files: int = 1):
    """Stereo blocks of the vector series written as several files and read so many files per micro-batch."""
    b = to_blocks(sig_embed(spark, sf), ["track_id"], "frame_ix", ["l", "r"], BLOCK)
    last = b.groupBy("track_id").agg(F.max("block_ix").alias("_m"))
    b = b.join(last, "track_id").withColumn("is_last", F.col("block_ix") == F.col("_m")).drop("_m")
    folder = scratch_folder(spark, "blocks")
    # by hash of the block number: a series' blocks arrive out of order over the micro-batches
    b.repartition("block_ix").write.parquet(folder)
    return spark.readStream.schema(b.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("s1_stream_integrity", f"""WITH {SIG_EMBED} SELECT track_id, max(frame_ix) + 1 AS frames, count(*) FILTER (abs(l) >= 1) + count(*) FILTER (abs(r) >= 1)
  AS clipped_samples, {rd('greatest(abs(avg(l)), abs(avg(r)))')} AS max_abs_dc FROM sig_embed GROUP BY 1""")
def s1(spark, sf):
    out = run_available(stt.stream_integrity(block_stream(spark, sf), 1000.0, BLOCK), "update", ["track_id"], "integrity")
    return rounded(out.select("track_id", "frames", "clipped_samples", "max_abs_dc"))


@query("s1_stream_stereo", f"""WITH {SIG_EMBED}, s AS (SELECT track_id, sum(l*l) ll, sum(r*r) rr, sum(l*r) lr, sum((l+r)*(l+r)/4) mm FROM sig_embed GROUP BY 1)
SELECT track_id, {rd('lr / sqrt(ll * rr)')} AS correlation, {rd('10 * log10(mm / ((ll + rr) / 2))')} AS mono_fold_delta_db FROM s""")
def s1_stereo(spark, sf):
    return rounded(run_available(stt.stream_stereo(block_stream(spark, sf), BLOCK), "update", ["track_id"], "stereo"))


@query("s1_stream_waveform", f"""WITH {SIG_EMBED} SELECT track_id, frame_ix // 48 AS bin_ix, {rd('min(l)')} AS min, {rd('max(l)')} AS max,
  {rd('sqrt(avg(l * l))')} AS rms, count(*) AS frames FROM sig_embed GROUP BY ALL""")
def s1_waveform(spark, sf):
    return rounded(run_available(stt.stream_waveform(block_stream(spark, sf), BLOCK, 48), "update", ["track_id", "bin_ix"], "waveform"))


_A = fl.cutoff_alpha(10.0, 1000.0)


def _pole(c: str) -> str:
    return rd(f"{_A!r} * pow({1 - _A!r}, frame_ix) * sum({c} * pow({1 - _A!r}, -frame_ix)) OVER (PARTITION BY track_id ORDER BY frame_ix)") + f" AS {c}"


def filtered(spark, sf, files: int):
    return run_available(stt.stream_filter(block_stream(spark, sf, files), fl.one_pole(_A)), "append", (), "filter", rocksdb=True)


@query("s5_stream_filter", f"WITH {SIG_EMBED} SELECT track_id, frame_ix, {_pole('l')}, {_pole('r')} FROM sig_embed")
def s5(spark, sf):
    """Both channels, one file in each micro-batch."""
    return rounded(from_blocks(filtered(spark, sf, 1), ["track_id"], "frame_ix", ["l", "r"], BLOCK))


@query("s5_stream_filter_by_five", f"WITH {SIG_EMBED} SELECT track_id, frame_ix, {_pole('l')}, {_pole('r')} FROM sig_embed")
def s5_five(spark, sf):
    """The same rows with five files in each micro-batch."""
    return rounded(from_blocks(filtered(spark, sf, 5), ["track_id"], "frame_ix", ["l", "r"], BLOCK))


@query("s6_end_of_input", f"""WITH {SIG_EMBED} SELECT track_id, max(frame_ix) // 64 AS block_ix FROM sig_embed GROUP BY 1""")
def s6(spark, sf):
    """The block that ends each series is emitted exactly once, after all others."""
    return filtered(spark, sf, 2).filter("is_last").select("track_id", "block_ix")


@query("s7_stream_preferences", f"""WITH pe AS (SELECT event_type AS profile_name, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq, value, count(*) OVER (PARTITION BY event_type) AS n FROM events),
w AS (SELECT *, pow(1.02, seq - n + 1) AS w, (value - 50.0) / 25 AS d FROM pe),
s AS (SELECT profile_name, count(*) AS event_count, 0.25 / sum(w) AS sc, sum(d * w) AS a, sum(w) AS tw FROM w GROUP BY 1)
SELECT profile_name, event_count, {rd('least(greatest(a * sc, -2), 2)')} AS lufs_bias, {rd('least(greatest(1 + 0.2 * a * sc, 0.8), 1.25)')} AS width_scale FROM s""")
def s7(spark, sf):
    d = (F.col("value") - 50.0) / 25
    e = table_stream(spark, sf, "events").select(
        F.col("event_type").alias("profile_name"), F.col("event_id").alias("seq"), d.alias("delta_lufs"), F.lit(0.0).alias("delta_brightness"),
        F.lit(0.0).alias("delta_bass"), (d * 0.2).alias("delta_width"), F.lit(0.0).alias("delta_saturation"), F.lit(0.0).alias("delta_punch"))
    sums = run_available(stt.stream_preferences(e), "update", ["profile_name"], "preferences")
    return rounded(preference_vector(sums).select("profile_name", "event_count", "lufs_bias", "width_scale"))


def text_score(text: str) -> float:
    if "%" in text:
        raise ValueError("unreadable characters")
    return float(len(text.split()))


@query("s9_incremental_batches", """SELECT doc_id, CASE WHEN contains(text, '%') THEN 'failed' ELSE 'complete' END AS status,
  CASE WHEN contains(text, '%') THEN 'unreadable characters' END AS error FROM documents""")
def s9(spark, sf):
    store, ckpt = scratch_folder(spark, "store"), scratch_folder(spark, "store-checkpoint")
    docs = table_stream(spark, sf, "documents").select("doc_id", "text", F.concat(F.sha2("text", 256), F.col("doc_id").cast("string")).alias("work_key"))
    handle = stt.incremental_batches(store, lambda w: stt.isolate_failures(w, text_score, "text", "words"))
    q = docs.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(store).select("doc_id", "status", "error")
