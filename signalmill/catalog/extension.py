"""Queries of the hooks: the user's own aggregate, table functions, processors, evaluators and late rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import register_expansion
from ..operators import folding as fo
from ..session import cut_lineage
from ..sources.adapters import sig_line
from . import query
from .common import SIG_LINE, rd
from .measure import rounded

ENERGIES = SIG_LINE + """,
h AS (SELECT track_id, frame_ix // 10 AS hop_ix, sum(l * l + r * r) / count(*) / 100 AS e FROM sig_line GROUP BY ALL),
v AS (SELECT *, -0.691 + 10 * log10(e) AS level FROM h WHERE e > 0),
a AS (SELECT track_id, -0.691 + 10 * log10(avg(e)) AS floor FROM v WHERE level >= -21 GROUP BY 1)"""


def energies(spark, sf):
    """Mean energy of ten frames, at a hundredth so that the gates have something to do."""
    e = F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r")) / F.count(F.lit(1)) / 100
    return sig_line(spark, sf, reused=True).groupBy("track_id", F.floor(F.col("frame_ix") / 10).alias("hop_ix")).agg(e.alias("e"))


@query("x2_two_phase_gating", f"""WITH {ENERGIES}
SELECT track_id, {rd('-0.691 + 10 * log10(avg(e))')} AS lufs, count(*) AS points FROM v JOIN a USING (track_id)
WHERE level >= -21 AND level >= floor - 1 GROUP BY 1""")
def x2(spark, sf):
    """Gated loudness through the public aggregate: the level above the first gate, then the level above the second."""
    points = cut_lineage(energies(spark, sf))  # read for both gates
    first = fo.fold_rows(points, ["track_id"], fo.GatedLoudness(-21.0)).select("track_id", F.col("lufs").alias("floor"))
    return rounded(fo.fold_rows(points.join(first, "track_id"), ["track_id"], fo.GatedLoudness(-21.0, -1.0)).filter("points > 0"))


@query("x7_table_functions", f"""WITH RECURSIVE {SIG_LINE},
n AS (SELECT track_id, max(frame_ix) + 1 AS n FROM sig_line GROUP BY 1),
lv AS (SELECT track_id, n, 0 AS k, 16::BIGINT AS span FROM n UNION ALL SELECT track_id, n, k + 1, span * 4 FROM lv WHERE n > span)
SELECT track_id, 'levels' AS kind, k AS i, span::DOUBLE AS a, ((n + span - 1) // span)::DOUBLE AS b FROM lv
UNION ALL SELECT track_id, 'lags', lag, {rd('100.0 / lag')}, NULL FROM n, (SELECT CAST(unnest(range(5, 26)) AS INTEGER) AS lag)
UNION ALL SELECT track_id, 'bands', b, {rd('2.0 * pow(20.0, b / 11.0)')}, NULL FROM n, (SELECT CAST(unnest(range(12)) AS INTEGER) AS b)""")
def x7(spark, sf):
    """Levels, lags and bands of every series by lateral calls."""
    register_expansion(spark)
    n = sig_line(spark, sf).groupBy("track_id").agg((F.max("frame_ix") + 1).alias("n"))
    n.createOrReplaceTempView("_expansion_series")
    return rounded(spark.sql("""
        SELECT track_id, 'levels' AS kind, level AS i, CAST(span AS DOUBLE) AS a, CAST(bins AS DOUBLE) AS b FROM _expansion_series, LATERAL expansion('levels', n, 16, 4)
        UNION ALL SELECT track_id, 'lags', lag, frequency_hz, NULL FROM _expansion_series, LATERAL expansion('lags', 100, 4, 20)
        UNION ALL SELECT track_id, 'bands', band, frequency_hz, NULL FROM _expansion_series, LATERAL expansion('bands', 12, 2.0D, 40.0D)"""))


@query("x1_processor_hook", f"WITH {SIG_LINE} SELECT track_id, frame_ix, {rd('-0.5 * l')} AS l, {rd('-0.5 * r')} AS r FROM sig_line")
def x1(spark, sf):
    """A processor of the user's own between two built-in ones."""
    from ..operators import dynamics as dy
    from .signal import BLOCK, RATE, line_blocks, unblocked

    dy.register_processor("flip", lambda b, rate, p, block: dy._both(b, lambda c: F.transform(c, lambda v: v * -p["scale"])))
    plan = [{"id": "in", "type": "gain", "params": {"gain_db": 6.0}}, {"id": "mine", "type": "flip", "params": {"scale": 0.5}},
            {"id": "out", "type": "gain", "params": {"gain_db": -6.0}}]
    return unblocked(dy.run_graph(line_blocks(spark, sf), plan, RATE, BLOCK))


@query("s8_late_rows", f"""WITH e AS (SELECT greatest(event_id % 10 - 7, 0) AS part, date_trunc('day', ts) AS day, ts FROM events),
w AS (SELECT max(ts) FILTER (part = 0) - INTERVAL 1 HOUR AS mark FROM e),
k AS (SELECT e.*, part < 2 OR day + INTERVAL 1 DAY > mark AS kept FROM e, w)
SELECT epoch(day)::BIGINT AS start, count(*) AS n FROM k WHERE kept GROUP BY 1
UNION ALL SELECT -1, count(*) FILTER (NOT kept) FROM k""")
def s8_late(spark, sf):
    """Three ordered batches; rows of the third are late by the watermark that the first has set (Spark drops by the watermark
    of the batch before). Who is left in each day's window, and (at -1) how many rows were dropped, by what the stream observed."""
    from ..sources.adapters import table
    from ..streaming import windows as win
    from ..streaming.runner import run_available, scratch_folder

    folder = scratch_folder(spark, "late")
    e = table(spark, sf, "events").select("event_id", "ts", F.lit("all").alias("source"), F.lit(1.0).alias("x"))
    for part in range(3):
        # one file per batch: they are read in the order in which they were written
        e.filter(F.greatest(F.col("event_id") % 10 - 7, F.lit(0)) == part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    progress: list = []
    days = run_available(win.level_windows(win.with_event_time(stream, "ts", "1 hour", "arrivals"), "1 day"), "update", ["start"], "late", progress=progress)
    days = days.select(F.unix_timestamp("start").alias("start"), "n")
    return days.unionByName(win.dropped_rows(days, progress, "arrivals").select(F.lit(-1).cast("bigint").alias("start"), F.col("dropped").alias("n")))
