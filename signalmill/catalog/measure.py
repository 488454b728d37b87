"""Integrity, level, waveform, stereo, structure and character queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import r
from ..operators import frames as fr
from ..operators import integrity as it
from ..operators import stereo as st
from ..operators import structure as su
from ..operators.waveform import waveform_pyramid
from ..session import cut_lineage
from ..sources.adapters import sig_embed, sig_line
from . import query
from .common import LONG_LINE, SIG_EMBED, SIG_LINE, rd

RATE = 100.0  # frames per second given to the line series
BLOCK = 128  # small enough that the given series span several blocks


def rounded(df, *keep, digits: int = 6):
    """All double columns rounded, the rest as they are."""
    return df.select(*[r(F.col(c), digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


INTEGRITY_CTE = SIG_LINE + """,
integrity AS (
  SELECT track_id, max(frame_ix) + 1 AS frames,
    count(*) FILTER (isnan(l)) + count(*) FILTER (isnan(r)) AS nan_samples,
    count(*) FILTER (isinf(l)) + count(*) FILTER (isinf(r)) AS infinite_samples,
    count(*) FILTER (abs(l) >= 1) + count(*) FILTER (abs(r) >= 1) AS clipped_samples,
    greatest(abs(avg(l)), abs(avg(r))) AS max_abs_dc,
    sqrt(avg(l * l)) AS rl, sqrt(avg(r * r)) AS rr,
    min(frame_ix) FILTER (abs(l) > 0.00003162277660168379 OR abs(r) > 0.00003162277660168379) AS f0,
    max(frame_ix) FILTER (abs(l) > 0.00003162277660168379 OR abs(r) > 0.00003162277660168379) AS f1
  FROM sig_line GROUP BY track_id),
d1 AS (
  SELECT track_id, frames, nan_samples, infinite_samples, clipped_samples, max_abs_dc,
    CASE WHEN least(rl, rr) > 0 THEN 20 * log10(greatest(rl, rr) / least(rl, rr)) ELSE 0 END AS channel_imbalance_db,
    coalesce(f0, frames) / 100.0 AS head_silence_s, coalesce(frames - f1 - 1, frames) / 100.0 AS tail_silence_s
  FROM integrity)"""


def runs_cte(thr: str, name: str = "d2") -> str:
    return f"""
{name}_runs AS (
  SELECT track_id, ch, count(*) AS len FROM (
    SELECT track_id, ch, frame_ix - row_number() OVER (PARTITION BY track_id, ch ORDER BY frame_ix) AS isl
    FROM long_line WHERE abs(x) >= {thr}) GROUP BY track_id, ch, isl),
{name} AS (
  SELECT track_id, max(len) AS longest_run, count(*) FILTER (len >= 3) AS repeated_runs FROM {name}_runs GROUP BY track_id)"""


LONG_TAIL = """,
long_line AS (
  SELECT track_id, 0 AS ch, frame_ix, l AS x FROM sig_line
  UNION ALL SELECT track_id, 1 AS ch, frame_ix, r AS x FROM sig_line)"""

CREST_CTE = """
d4 AS (
  SELECT track_id, 20 * log10(greatest(max(abs(l)), max(abs(r)))) AS sample_peak_db,
    20 * log10(sqrt((sum(l * l) + sum(r * r)) / (count(l) + count(r)))) AS rms_db
  FROM sig_line GROUP BY track_id)"""


@query("flagship_integrity_runs_crest", f"""WITH {INTEGRITY_CTE}{LONG_TAIL},{runs_cte('0.999969482421875')},{CREST_CTE}
SELECT d1.track_id, frames, nan_samples, infinite_samples, clipped_samples, {rd('max_abs_dc')} AS max_abs_dc,
  {rd('channel_imbalance_db')} AS channel_imbalance_db, {rd('head_silence_s')} AS head_silence_s,
  {rd('tail_silence_s')} AS tail_silence_s, coalesce(longest_run, 0) AS longest_run,
  coalesce(repeated_runs, 0) AS repeated_runs, {rd('sample_peak_db')} AS sample_peak_db, {rd('rms_db')} AS rms_db,
  {rd('sample_peak_db - rms_db')} AS crest_db
FROM d1 LEFT JOIN d2 USING (track_id) JOIN d4 USING (track_id) ORDER BY 1""")
def flagship(spark, sf):
    s = sig_line(spark, sf, reused=True)
    out = (
        it.integrity_and_levels(s, RATE)
        .join(it.full_scale_runs(s, block=BLOCK), "track_id", "left")
        .fillna(0, ["longest_run", "repeated_runs"])
    )
    return rounded(out).orderBy("track_id")


@query("d1_integrity_metrics", f"""WITH {INTEGRITY_CTE}
SELECT track_id, frames, nan_samples, infinite_samples, clipped_samples, {rd('max_abs_dc')} AS max_abs_dc,
  {rd('channel_imbalance_db')} AS channel_imbalance_db, {rd('head_silence_s')} AS head_silence_s,
  {rd('tail_silence_s')} AS tail_silence_s FROM d1""")
def d1(spark, sf):
    return rounded(it.integrity_metrics(sig_line(spark, sf), RATE))


for _thr, _name in ((it.FULL_SCALE, "d2_full_scale_runs"), (0.9, "d2_runs_at_090")):
    @query(_name, f"WITH {LONG_LINE},{runs_cte(repr(_thr))} SELECT track_id, longest_run, repeated_runs FROM d2")
    def d2(spark, sf, thr=_thr):
        return it.full_scale_runs(sig_line(spark, sf), thr, block=BLOCK)


@query("d3_waveform_pyramid", f"""WITH {LONG_LINE},
b0 AS (SELECT track_id, ch, frame_ix // 16 AS b, min(x) mn, max(x) mx, sum(x * x) sq, count(*) n
       FROM long_line GROUP BY ALL),
nb AS (SELECT track_id, ch, max(b) + 1 AS bins FROM b0 GROUP BY ALL),
lv AS (SELECT unnest(range(12)) AS level)
SELECT b0.track_id, b0.ch, CAST(level AS INTEGER) AS level, CAST(floor(b / pow(4, level)) AS BIGINT) AS bin_ix,
  {rd('min(mn)')} AS min, {rd('max(mx)')} AS max, {rd('sqrt(sum(sq) / sum(n))')} AS rms, CAST(sum(n) AS BIGINT) AS frames
FROM b0 JOIN nb USING (track_id, ch) JOIN lv ON level = 0 OR pow(4, level - 1) < bins
GROUP BY 1, 2, 3, 4""")
def d3(spark, sf):
    return rounded(waveform_pyramid(fr.to_long(sig_line(spark, sf)), base=16, factor=4))


@query("d4_peak_rms_crest", f"""WITH {SIG_LINE},{CREST_CTE}
SELECT track_id, {rd('sample_peak_db')} AS sample_peak_db, {rd('rms_db')} AS rms_db,
  {rd('sample_peak_db - rms_db')} AS crest_db FROM d4""")
def d4(spark, sf):
    return rounded(it.peak_rms_crest(sig_line(spark, sf)))


SUMS = "sum(l*l) ll, sum(r*r) rr, sum(l*r) lr, sum((l+r)*(l+r)/4) mm"


@query("d5_stereo_correlation_raw", f"""WITH {SIG_LINE}, s AS (SELECT track_id, {SUMS} FROM sig_line GROUP BY 1)
SELECT track_id, {rd('CASE WHEN ll*rr > 0 THEN lr/sqrt(ll*rr) ELSE 1 END')} AS correlation FROM s""")
def d5(spark, sf):
    return rounded(st.stereo_sums(sig_line(spark, sf)).select("track_id", "correlation"))


@query("d6_stereo_correlation_centered", f"""WITH {SIG_LINE}
SELECT track_id, {rd('least(greatest(coalesce(corr(l, r), 1), -1), 1)')} AS centered_correlation
FROM sig_line GROUP BY 1""")
def d6(spark, sf):
    return rounded(st.centered_correlation(sig_line(spark, sf)))


@query("d7_negative_corr_fraction", f"""WITH {SIG_LINE},
w AS (SELECT track_id, frame_ix // 32 AS win, sum(l*l) ll, sum(r*r) rr, sum(l*r) lr FROM sig_line GROUP BY ALL)
SELECT track_id, count(*) FILTER (sqrt(ll*rr) > 0) AS correlation_windows,
  {rd('coalesce(count(*) FILTER (sqrt(ll*rr) > 0 AND lr < 0) / nullif(count(*) FILTER (sqrt(ll*rr) > 0), 0), 0)')}
  AS negative_fraction FROM w GROUP BY 1""")
def d7(spark, sf):
    return rounded(st.negative_correlation_fraction(sig_line(spark, sf), 32))


@query("d8_mono_fold_delta", f"""WITH {SIG_LINE}, s AS (SELECT track_id, {SUMS} FROM sig_line GROUP BY 1)
SELECT track_id, {rd('CASE WHEN ll+rr <= 0 THEN 0 WHEN mm > 0 THEN 10*log10(mm/((ll+rr)/2)) ELSE -200 END')}
  AS mono_fold_delta_db FROM s""")
def d8(spark, sf):
    return rounded(st.stereo_sums(sig_line(spark, sf)).select("track_id", "mono_fold_delta_db"))


def _d9_sql() -> str:
    from ..functions.filters import cutoff_alpha
    from .loops import Loop

    loop = Loop()
    for c in "lr":
        for n, hz in (("lo", 2.0), ("hi", 20.0)):
            a = cutoff_alpha(hz, RATE)
            loop.set(f"{c}{n}", f"{a!r}::DOUBLE * {c} + {1 - a!r}::DOUBLE * p_{c}{n}", 0.0)
    bands = {"low": ("llo", "rlo"), "mid": ("(lhi - llo)", "(rhi - rlo)"), "high": ("(l - lhi)", "(r - rhi)")}
    share = ", ".join(f"{rd(f'sum(pow({a} - {b}, 2)) / (sum(pow({a} + {b}, 2)) + sum(pow({a} - {b}, 2)))')} AS {n}_band_width" for n, (a, b) in bands.items())
    return f"""WITH RECURSIVE {SIG_LINE.replace('sig_line AS (', 'sig_line AS MATERIALIZED (')},
{loop.sql('sig_line', 'track_id, frame_ix, l, r', ['l', 'r'])}
SELECT track_id, {share} FROM st GROUP BY 1"""


@query("d9_band_width3", _d9_sql())
def d9(spark, sf):
    return rounded(st.band_widths(sig_line(spark, sf), RATE, 2.0, 20.0, BLOCK))


WINDOWS_CTE = """
wc AS (SELECT track_id, frame_ix // 32 AS win, sqrt(avg((l*l + r*r) / 2)) AS rms,
              max(greatest(abs(l), abs(r))) AS peak FROM sig_line GROUP BY ALL),
d14 AS (SELECT track_id, count(*) AS active_windows, count(*) FILTER (peak >= 0.9999) AS clipping_windows,
          quantile_cont(20 * log10(greatest(peak, 1e-12)) - 20 * log10(greatest(rms, 1e-12)), 0.5) AS median_crest_db
        FROM wc WHERE rms > 1e-5 GROUP BY 1)"""
PLATEAU_CTE = """
pl AS (SELECT track_id, abs(x) AS m, lag(abs(x)) OVER (PARTITION BY track_id, ch ORDER BY frame_ix) AS p FROM long_line),
e2 AS (SELECT track_id, count(*) FILTER (m >= 0.985) AS near_full_samples,
         count(*) FILTER (m >= 0.985 AND p >= 0.985 AND abs(m - p) <= 2e-5) AS plateau_samples,
         count(*) AS total_samples FROM pl GROUP BY 1)"""


@query("d14_window_character", f"""WITH {SIG_LINE},{WINDOWS_CTE}
SELECT track_id, active_windows, clipping_windows, {rd('median_crest_db')} AS median_crest_db FROM d14""")
def d14(spark, sf):
    return rounded(it.window_character(sig_line(spark, sf), 32))


@query("e2_plateau_samples", f"WITH {LONG_LINE},{PLATEAU_CTE} SELECT * FROM e2")
def e2(spark, sf):
    return it.plateau_samples(sig_line(spark, sf), BLOCK)


def character(spark, sf):
    s = sig_line(spark, sf, reused=True)
    m = (
        it.window_character(s, 32)
        .join(it.plateau_samples(s, BLOCK), "track_id")
        .join(it.integrity_metrics(s, RATE).select("track_id", "clipped_samples"), "track_id")
        .join(it.full_scale_runs(s, block=BLOCK), "track_id", "left")
        .fillna(0, ["longest_run", "repeated_runs"])
    )
    return it.character_likelihoods(m, RATE)


CHARACTER_CTE = f"""{INTEGRITY_CTE}{LONG_TAIL},{runs_cte('0.999969482421875')},{WINDOWS_CTE},{PLATEAU_CTE},
c0 AS (SELECT track_id, near_full_samples / total_samples AS hi, clipping_windows / active_windows AS cw,
         coalesce(plateau_samples / nullif(near_full_samples, 0), 0) AS flat, clipped_samples / total_samples AS ex,
         coalesce(longest_run, 0) AS lr, median_crest_db AS mc, total_samples / 2 / 100.0 AS secs
       FROM d14 JOIN e2 USING (track_id) JOIN d1 USING (track_id) LEFT JOIN d2 USING (track_id)),
c1 AS (SELECT *, least(greatest(ex * 180 + flat * 0.65 + cw * 0.3, 0), 1) AS hard FROM c0),
c2 AS (SELECT *, least(greatest(least(hi * 24, 1) * 0.5 + least(greatest((9 - mc) / 5, 0), 1) * 0.35 + cw * 0.15
         - hard * 0.2, 0), 1) AS sat FROM c1),
c3 AS (SELECT *, least(greatest(least(cw / 0.35, 1) * 0.45 + sat * 0.45 + (1 - flat) * 0.1, 0), 1) AS inten FROM c2),
d15 AS (SELECT *, least(greatest(hard * (0.55 + CASE WHEN cw > 0 THEN least(greatest((0.14 - cw) / 0.14, 0), 1)
         ELSE 0 END * 0.3) + least(lr / 32.0, 1) * 0.35 - inten * 0.2, 0), 1) AS risk,
         least(greatest(secs / 15, 0.2), 1) AS conf FROM c3)"""


@query("d15_character_likelihoods", f"""WITH {CHARACTER_CTE}
SELECT track_id, {rd('hi')} AS high_level_fraction, {rd('cw')} AS clipping_window_fraction, {rd('hard')} AS hard_clip,
  {rd('sat')} AS saturation, {rd('inten')} AS intentional, {rd('risk')} AS defect_risk,
  {rd('conf')} AS character_confidence FROM d15""")
def d15(spark, sf):
    return rounded(character(spark, sf).select(
        "track_id", "high_level_fraction", "clipping_window_fraction", "hard_clip", "saturation", "intentional",
        "defect_risk", "character_confidence"))


# --- structure on the dense vectors: 16-frame feature frames, 1000 frames per second ------------
S_RATE, S_SIZE = 1000.0, 16
FEATURE_CTE = SIG_EMBED + """,
mono AS (SELECT *, (l + r) / 2 AS m, lag((l + r) / 2, 1, 0) OVER (PARTITION BY track_id ORDER BY frame_ix) AS p
         FROM sig_embed),
feat AS (SELECT track_id, frame_ix // 16 AS win, count(*) AS n, sqrt(avg(m * m)) AS rms, max(abs(m)) AS peak,
    least(greatest(sum(abs(m - p)) / greatest(2 * sum(abs(m)), 1e-9), 0), 1) AS brightness,
    least(greatest(sqrt(sum((l-r)*(l-r)/4) / greatest(sum((l+r)*(l+r)/4) + sum((l-r)*(l-r)/4), 1e-12)), 0), 1) AS width
  FROM mono GROUP BY ALL),
f2 AS (SELECT *, CASE WHEN rms > 1e-12 THEN 20 * log10(rms) ELSE -120 END AS rms_db,
         lag(rms, 1, 0) OVER (PARTITION BY track_id ORDER BY win) AS pr FROM feat),
ons AS (SELECT *, least(greatest(greatest(0, rms_db - CASE WHEN pr > 1e-12 THEN 20 * log10(pr) ELSE -120 END) / 10
         + greatest(0, peak - pr) / greatest(pr, 1e-5) * 0.15, 0), 1.5) AS onset FROM f2),
lim AS (SELECT track_id, quantile_cont(onset, 0.75) + 0.03 AS lim FROM ons GROUP BY 1),
nb AS (SELECT *, lag(onset) OVER w AS po, lead(onset) OVER w AS fo FROM ons JOIN lim USING (track_id)
       WINDOW w AS (PARTITION BY track_id ORDER BY win)),
pk AS (SELECT track_id, count(*) FILTER (onset > lim AND onset >= po AND onset >= fo) AS onset_count,
         count(*) FILTER (onset > lim AND onset >= po AND onset >= fo) / (sum(n) / 1000.0) AS onset_density,
         coalesce(avg(onset) FILTER (onset > lim AND onset >= po AND onset >= fo), 0) AS mean_onset,
         count(*) FILTER (onset > lim) / count(*) AS transient_fraction FROM nb GROUP BY 1)"""


def onsets_of(spark, sf, reused=False):
    o = su.onset_strength(su.feature_frames(sig_embed(spark, sf), S_SIZE, 256))
    return cut_lineage(o) if reused else o


@query("d16_feature_frames", f"""WITH {FEATURE_CTE}
SELECT track_id, win, n, {rd('rms')} AS rms, {rd('peak')} AS peak, {rd('brightness')} AS brightness,
  {rd('width')} AS width, {rd('rms_db')} AS rms_db FROM f2""")
def d16(spark, sf):
    return rounded(su.feature_frames(sig_embed(spark, sf), S_SIZE, 256))


@query("e3_onset_strength", f"WITH {FEATURE_CTE} SELECT track_id, win, {rd('onset')} AS onset FROM ons")
def e3(spark, sf):
    return rounded(onsets_of(spark, sf).select("track_id", "win", "onset"))


@query("e4_pick_onsets", f"""WITH {FEATURE_CTE} SELECT track_id, onset_count, {rd('onset_density')} AS onset_density,
  {rd('mean_onset')} AS mean_onset, {rd('transient_fraction')} AS transient_fraction FROM pk""")
def e4(spark, sf):
    o = onsets_of(spark, sf, True)
    return rounded(su.pick_onsets(o, su.onset_threshold(o), S_RATE))


@query("d17_macro_dynamics", f"""WITH {FEATURE_CTE}, q AS (
  SELECT track_id, quantile_cont(rms_db, [0.1, 0.5, 0.9]) AS a,
    quantile_cont(CASE WHEN peak > 1e-12 THEN 20 * log10(peak) ELSE -120 END - rms_db, [0.1, 0.9]) AS c
  FROM f2 GROUP BY 1)
SELECT track_id, {rd('a[1]')} AS rms_p10, {rd('a[2]')} AS rms_p50, {rd('a[3]')} AS rms_p90,
  {rd('greatest(0, a[3] - a[1])')} AS macro_range_db, {rd('greatest(0, c[2] - c[1])')} AS crest_variability_db FROM q""")
def d17(spark, sf):
    return rounded(su.macro_dynamics(cut_lineage(su.feature_frames(sig_embed(spark, sf), S_SIZE, 256))))


@query("d18_tempo_autocorr", f"""WITH {FEATURE_CTE},
lags AS (SELECT unnest(range(21, 64)) AS lag),
xc AS (SELECT a.track_id, lag, sum(a.onset * b.onset) AS c, sum(a.onset * a.onset) AS e1, sum(b.onset * b.onset) AS e2
       FROM ons a JOIN lags ON true JOIN ons b ON a.track_id = b.track_id AND b.win = a.win - lag GROUP BY ALL),
sc AS (SELECT track_id, lag, c / sqrt(greatest(e1 * e2, 1e-12)) * (1 + 0.08 * (1 - (lag - 21) / 42.0)) AS score FROM xc),
best AS (SELECT track_id, lag, score FROM sc WHERE score > 0
         QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, lag) = 1)
SELECT pk.track_id, {rd('CASE WHEN lag IS NOT NULL AND onset_count >= 3 THEN 60 * 62.5 / lag ELSE 0 END')} AS bpm,
  {rd('CASE WHEN lag IS NOT NULL AND onset_count >= 3 THEN least(score, 1) * least(greatest(onset_count / 16.0, 0.25), 1) ELSE 0 END')}
  AS tempo_confidence FROM pk LEFT JOIN best USING (track_id)""")
def d18(spark, sf):
    o = onsets_of(spark, sf, True)
    return rounded(su.tempo(o, su.pick_onsets(o, su.onset_threshold(o), S_RATE), S_RATE / S_SIZE))


SECTION_CTE = FEATURE_CTE + """,
s0 AS (SELECT track_id, win // 5 AS sec, sqrt(avg(rms * rms)) AS srms, avg(brightness) AS brightness,
         count(*) FILTER (onset > lim) / count(*) AS transients, avg(width) AS width, sum(n) AS n
       FROM ons JOIN lim USING (track_id) GROUP BY ALL),
s1 AS (SELECT *, CASE WHEN srms > 1e-12 THEN 20 * log10(srms) ELSE -120 END AS energy_db FROM s0),
sec AS (SELECT *, coalesce(sqrt(pow((energy_db - lag(energy_db) OVER w) / 5, 2)
    + pow((brightness - lag(brightness) OVER w) / 0.1, 2) + pow((transients - lag(transients) OVER w) / 0.15, 2)
    + pow((width - lag(width) OVER w) / 0.15, 2)), 0) AS distance
  FROM s1 WINDOW w AS (PARTITION BY track_id ORDER BY sec))"""


def sections_of(spark, sf):
    o = onsets_of(spark, sf, True)
    lim = su.onset_threshold(o)
    return o, lim, su.section_windows(o, lim, 5)


@query("d19_section_windows", f"""WITH {SECTION_CTE}
SELECT track_id, sec, {rd('energy_db')} AS energy_db, {rd('brightness')} AS brightness, {rd('transients')} AS transients,
  {rd('width')} AS width, CAST(n AS BIGINT) AS n, {rd('distance', 5)} AS distance FROM sec""")
def d19(spark, sf):
    out = sections_of(spark, sf)[2]
    return rounded(out.withColumn("distance", F.round("distance", 5)), "distance")


@query("d20_section_boundaries")
def d20(spark, sf):
    return rounded(su.sections(sig_embed(spark, sf), S_RATE, S_SIZE, 0.08, 256))


@query("e1_differences", f"""WITH {LONG_LINE}
SELECT track_id, ch, frame_ix, {rd('x - lag(x) OVER w')} AS d1, {rd('x - 2 * lag(x) OVER w + lag(x, 2) OVER w')} AS d2
FROM long_line WINDOW w AS (PARTITION BY track_id, ch ORDER BY frame_ix)""")
def e1(spark, sf):
    out = fr.differences(fr.to_long(sig_line(spark, sf)), ["track_id", "ch"], BLOCK)
    return rounded(out.drop("x"))
