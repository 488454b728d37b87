"""Spectral, loudness, filter, processing, repair and playback queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import filters as fl
from ..operators import dynamics as dy
from ..operators import events as evn
from ..operators import frames as fr
from ..operators import loudness as lo
from ..operators import repair as rp
from ..operators import scans as sc
from ..operators import spectrum as sp
from ..operators import stereo as st
from ..session import cut_lineage
from ..sources.adapters import sig_embed, sig_embed_mono, sig_line
from . import loops as lp
from . import query
from .common import EMBED_MONO, LONG_LINE, SIG_EMBED, SIG_LINE, rd
from .measure import BLOCK, RATE, rounded

FFT, SRATE = 64, 8000.0


def mono_embed(spark, sf):
    return sig_embed_mono(spark, sf).select("track_id", "frame_ix", "x")


# --- spectra: 64-sample windows with half overlap ------------------------------------------------
SPECTRUM_CTE = EMBED_MONO + """,
n AS (SELECT track_id, max(frame_ix) + 1 AS n FROM embed_mono GROUP BY 1),
ws AS (SELECT track_id, frame_ix // 32 - k AS w, frame_ix - (frame_ix // 32 - k) * 32 AS i, x
       FROM embed_mono JOIN n USING (track_id) CROSS JOIN (VALUES (0), (1)) AS kk(k)
       WHERE frame_ix // 32 - k >= 0 AND (frame_ix // 32 - k) * 32 + 64 <= n),
taper AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS y FROM ws),
bins AS (SELECT unnest(range(33)) AS bin),
dft AS (SELECT track_id, w, bin, sum(y * cos(2 * pi() * bin * i / 64)) AS re, sum(y * sin(2 * pi() * bin * i / 64)) AS im
        FROM taper, bins GROUP BY ALL),
spec AS (SELECT track_id, bin, sum(re * re + im * im) AS power, count(*) AS windows FROM dft GROUP BY ALL)"""


def spectrum(spark, sf):
    # 33 rows per series, read more than once
    return cut_lineage(sp.power_spectrum(mono_embed(spark, sf), FFT, 256))


@query("d10_power_spectrum", f"""WITH {SPECTRUM_CTE}
SELECT track_id, CAST(bin AS INTEGER) AS bin, {rd('power')} AS power, windows FROM spec""")
def d10(spark, sf):
    return rounded(spectrum(spark, sf))


@query("d11_spectral_shape", f"""WITH {SPECTRUM_CTE},
c AS (SELECT *, bin * 125.0 AS hz, sum(power) OVER (PARTITION BY track_id ORDER BY bin) AS cum,
        sum(power) OVER (PARTITION BY track_id) AS tot FROM spec)
SELECT track_id, {rd('sum(hz * power) / sum(power)', 4)} AS centroid_hz,
  {rd('min(hz) FILTER (cum >= tot * 0.85)')} AS rolloff_hz FROM c GROUP BY 1""")
def d11(spark, sf):
    out = sp.spectral_shape(spectrum(spark, sf), SRATE, FFT)
    return rounded(out.withColumn("centroid_hz", F.round("centroid_hz", 4)), "centroid_hz")


@query("d11_band_ratios", f"""WITH {SPECTRUM_CTE},
bd(i, lo, hi) AS (VALUES (0, 20, 60), (1, 60, 250), (2, 250, 500), (3, 500, 2000), (4, 2000, 6000), (5, 6000, 4000)),
t AS (SELECT track_id, sum(power) AS tot FROM spec GROUP BY 1)
SELECT track_id, i AS band, {rd('coalesce(sum(power) FILTER (bin * 125.0 >= lo AND bin * 125.0 < hi), 0) / any_value(tot)')}
  AS energy_ratio FROM spec JOIN t USING (track_id), bd GROUP BY ALL""")
def d11_bands(spark, sf):
    out = sp.band_ratios(spectrum(spark, sf), SRATE, FFT)
    return rounded(out.select("track_id", F.posexplode("bands").alias("band", "b")).select("track_id", "band", "b.energy_ratio"))


@query("b11_band_overlap_energy", f"""WITH {SPECTRUM_CTE},
bd(i, lo, hi) AS (VALUES (0, 20, 60), (1, 60, 250), (2, 250, 500), (3, 500, 2000), (4, 2000, 6000)),
t AS (SELECT track_id, sum(power) AS tot FROM spec GROUP BY 1),
rt AS (SELECT track_id, lo, hi, coalesce(sum(power) FILTER (bin * 125.0 >= lo AND bin * 125.0 < hi), 0) / any_value(tot) AS er
       FROM spec JOIN t USING (track_id), bd GROUP BY ALL)
SELECT track_id, {rd('least(sum(er * greatest(0, least(hi, 1000) - greatest(lo, 200)) / (hi - lo)), 1)')} AS energy FROM rt
GROUP BY 1""")
def b11(spark, sf):
    from ..functions.levels import band_overlap

    out = sp.band_ratios(spectrum(spark, sf), SRATE, FFT)
    return rounded(out.select("track_id", band_overlap(F.col("bands"), 200.0, 1000.0).alias("energy")))


BANDS, LOW = 16, 200.0
STEP = (SRATE * 0.46 / LOW) ** (1 / (BANDS - 1))
BAND_CTE = EMBED_MONO + f""",
fq AS (SELECT i AS band, {LOW} * pow({STEP!r}, i) AS hz FROM (SELECT unnest(range({BANDS})) AS i)),
wb AS (SELECT track_id, frame_ix // 64 AS win, frame_ix % 64 AS i, x * (0.5 - 0.5 * cos(2 * pi() * (frame_ix % 64) / 63)) AS y FROM embed_mono),
bp0 AS (SELECT track_id, win, band, hz, pow(sum(y * cos(2 * pi() * hz * i / {SRATE})), 2)
          + pow(sum(y * sin(2 * pi() * hz * i / {SRATE})), 2) AS p FROM wb, fq GROUP BY ALL),
bp AS (SELECT *, p / 4096 AS power, 10 * log10(greatest(p / 4096, 1e-18)) AS db FROM bp0),
pm AS (SELECT *, coalesce(db - (lag(db) OVER w + lead(db) OVER w) / 2 >= 4, false) AS o FROM bp
       WINDOW w AS (PARTITION BY track_id, win ORDER BY band)),
prof AS (SELECT track_id, band, hz, avg(power) AS power, count(*) FILTER (o) / count(*) AS persistence,
    min((win + 1) * 64 / {SRATE}) FILTER (o) AS first_s, max((win + 1) * 64 / {SRATE}) FILTER (o) AS last_s FROM pm GROUP BY ALL)"""


def band_powers(spark, sf):
    return sp.window_band_powers(mono_embed(spark, sf), SRATE, FFT, BANDS, LOW, block=256)


def profile(spark, sf):
    return sp.band_profile(band_powers(spark, sf), SRATE, BANDS, LOW)


@query("d12_band_powers", f"WITH {BAND_CTE} SELECT track_id, win, CAST(band AS INTEGER) AS band, {rd('power', 9)} AS power FROM bp")
def d12(spark, sf):
    return rounded(band_powers(spark, sf).drop("end_s"), digits=9)


@query("e10_neighbor_prominence", f"""WITH {BAND_CTE}
SELECT track_id, CAST(band AS INTEGER) AS band, {rd('power', 9)} AS power, {rd('persistence')} AS persistence,
  {rd('first_s')} AS first_s, {rd('last_s')} AS last_s FROM prof""")
def e10(spark, sf):
    out = profile(spark, sf).drop("frequency_hz")
    return rounded(out.withColumn("power", F.round("power", 9)), "power")


TONAL = dict(total=(250.0, 3600.0), sub=(200.0, 400.0), mud=(400.0, 900.0), harsh=(1200.0, 2500.0), bright=(2500.0, 3600.0))
TONAL_CTE = BAND_CTE + """,
tn AS (SELECT track_id, sum(power) FILTER (hz >= 250 AND hz <= 3600) AS t, sum(power) FILTER (hz >= 200 AND hz < 400) AS s,
    sum(power) FILTER (hz >= 400 AND hz < 900) AS m, sum(power) FILTER (hz >= 1200 AND hz < 2500) AS h,
    sum(power) FILTER (hz >= 2500 AND hz <= 3600) AS b FROM prof GROUP BY 1),
ts AS (SELECT track_id, least(greatest((s / t - 0.18) / 0.35, 0), 1) AS sub_buildup, least(greatest((m / t - 0.24) / 0.32, 0), 1) AS mud,
    least(greatest((h / t - 0.22) / 0.30, 0), 1) AS harshness, least(greatest((b / t - 0.16) / 0.32, 0), 1) AS brightness_score FROM tn),
pk0 AS (SELECT *, 10 * log10(greatest(power, 1e-18)) AS mdb FROM prof),
pk1 AS (SELECT *, mdb - (lag(mdb) OVER (PARTITION BY track_id ORDER BY band) + lead(mdb) OVER (PARTITION BY track_id ORDER BY band)) / 2
          AS prominence FROM pk0),
res AS (SELECT *, least(greatest((prominence - 0.1) / 9 * (0.55 + persistence), 0), 1) AS severity FROM pk1
        WHERE hz >= 250 AND hz <= 3600 AND prominence >= 0.3 AND persistence >= 0.08),
top AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY severity DESC, band) AS place FROM res QUALIFY place <= 8)"""


@query("d13_tonal_scores", f"""WITH {TONAL_CTE} SELECT track_id, {rd('sub_buildup')} AS sub_buildup, {rd('mud')} AS mud,
  {rd('harshness')} AS harshness, {rd('brightness_score')} AS brightness_score FROM ts""")
def d13(spark, sf):
    return rounded(sp.tonal_scores(profile(spark, sf), **TONAL))


@query("t1_top_resonances", f"""WITH {TONAL_CTE} SELECT track_id, CAST(place AS INTEGER) AS place, CAST(band AS INTEGER) AS band,
  {rd('hz', 3)} AS frequency_hz, {rd('prominence')} AS prominence_db, {rd('persistence')} AS persistence,
  {rd('severity')} AS severity, {rd('coalesce(first_s, 0)')} AS first_s, {rd('coalesce(last_s, 0)')} AS last_s FROM top""")
def t1(spark, sf):
    out = sp.top_resonances(profile(spark, sf), 8, 250.0, 3600.0, 0.3, 0.1)
    return rounded(out.withColumn("frequency_hz", F.round("frequency_hz", 3)), "frequency_hz")


@query("d13_perceptual_summary", f"""WITH {TONAL_CTE},
bump AS (SELECT track_id, sum(severity * persistence * 0.25) AS b FROM top WHERE hz >= 1200 AND hz <= 2500 GROUP BY 1),
h AS (SELECT ts.* EXCLUDE (harshness), least(greatest(harshness + coalesce(b, 0), 0), 1) AS harshness FROM ts LEFT JOIN bump USING (track_id))
SELECT track_id, {rd('harshness')} AS harshness,
  {rd('greatest(sub_buildup, mud, harshness, abs(brightness_score - 0.35) * 0.65)')} AS tonal_imbalance FROM h""")
def d13_summary(spark, sf):
    p = profile(spark, sf)
    out = sp.perceptual_summary(sp.tonal_scores(p, **TONAL), sp.top_resonances(p, 8, 250.0, 3600.0, 0.3, 0.1), (1200.0, 2500.0))
    return rounded(out.select("track_id", "harshness", "tonal_imbalance"))


# --- linear scans: closed form of the one-pole as check -------------------------------------------
def pole(expr: str, alpha: float, name: str) -> str:
    """SQL of a one-pole over ``expr``: alpha * sum((1-alpha)^(n-k) x_k)."""
    k = repr(1 - alpha)
    return (f"{alpha!r} * pow({k}, frame_ix % 100000) * sum(({expr}) * pow({k}, -frame_ix)) "
            f"OVER (PARTITION BY track_id ORDER BY frame_ix) AS {name}")


ALPHA = fl.cutoff_alpha(1.0, RATE)


@query("e5_one_pole", f"WITH {SIG_LINE}, p AS (SELECT track_id, frame_ix, {pole('l', ALPHA, 'y')} FROM sig_line) "
                      f"SELECT track_id, frame_ix, {rd('y')} AS y FROM p")
def e5(spark, sf):
    b = line_blocks(spark, sf).select("track_id", "block_ix", "l")
    f = sc.linear_scan(b, ["track_id"], {"y": ("l", fl.one_pole(ALPHA))}, BLOCK)
    return rounded(sc.from_blocks(f, ["track_id"], "frame_ix", ["y"], BLOCK))


def line_blocks(spark, sf):
    """The block table of the line series, written once as it would lie at rest."""
    return cut_lineage(sc.to_blocks(sig_line(spark, sf), ["track_id"], "frame_ix", ["l", "r"], BLOCK))


def unblocked(b):
    return rounded(sc.from_blocks(b, ["track_id"], "frame_ix", ["l", "r"], BLOCK))


MATERIALIZED_LINE = SIG_LINE.replace("sig_line AS (", "sig_line AS MATERIALIZED (")


def stepwise(loop: lp.Loop, l: str, r: str) -> str:
    """SQL that takes ``sig_line`` through a loop and returns two of its steps as channels."""
    return (f"WITH RECURSIVE {MATERIALIZED_LINE},\n{loop.sql('sig_line', 'track_id, frame_ix, l, r', [l, r])}\n"
            f"SELECT track_id, frame_ix, {rd(l)} AS l, {rd(r)} AS r FROM st")


def keep(ms: float) -> str:
    return repr(fl.time_keep(ms, RATE)) + "::DOUBLE"


EQ_BANDS = [dict(shape="high_pass", frequency_hz=2.0), dict(shape="peak", frequency_hz=12.0, gain_db=3.0, q=0.9),
            dict(shape="high_shelf", frequency_hz=30.0, gain_db=-2.0)]


def _e6_sql() -> str:
    loop, ends = lp.Loop(), []
    for c in "lr":
        x = c
        for i, b in enumerate(EQ_BANDS):
            x = loop.section(f"{c}{i}", x, lp.coefficients(fl.design(b["shape"], b["frequency_hz"], RATE, b.get("gain_db", 0.0), b.get("q", 0.707))))
        ends.append(x)
    return stepwise(loop, *ends)


@query("e6_biquad", _e6_sql())
def e6(spark, sf):
    return unblocked(dy.apply_eq(line_blocks(spark, sf), EQ_BANDS, RATE, BLOCK))


def follower_sql(target: str, falling: float, rising: float, name: str, last: str = "0.0::DOUBLE") -> str:
    """One step of a two-speed follower of ``target``, from the state before."""
    keep = f"CASE WHEN {target} < {last} THEN {falling!r}::DOUBLE ELSE {rising!r}::DOUBLE END"
    return f"({keep}) * {last} + (1 - ({keep})) * ({target}) AS {name}"


def stepped(steps: dict[str, tuple[str, float, float]]) -> str:
    """Table ``st``: followers ``name -> (target, falling, rising)`` of ``sig_line``, frame by frame for all series at once."""
    first = ", ".join(follower_sql(t, f, r, n) for n, (t, f, r) in steps.items())
    after = ", ".join(follower_sql(t, f, r, n, f"st.{n}") for n, (t, f, r) in steps.items())
    return f"""st AS (SELECT s.track_id, s.frame_ix, s.l, s.r, {first} FROM sig_line s WHERE frame_ix = 0
  UNION ALL SELECT s.track_id, s.frame_ix, s.l, s.r, {after} FROM st JOIN sig_line s ON s.track_id = st.track_id AND s.frame_ix = st.frame_ix + 1)"""


@query("e7_envelope_follow", f"""WITH RECURSIVE {MATERIALIZED_LINE},
{stepped({'y': ('greatest(abs(s.l), abs(s.r))', 0.98, 0.7)})}
SELECT track_id, frame_ix, {rd('y')} AS y FROM st""")
def e7(spark, sf):
    b = line_blocks(spark, sf).withColumn("p", F.zip_with("l", "r", lambda x, y: F.greatest(F.abs(x), F.abs(y))))
    f = sc.follower_scan(b, ["track_id"], {"y": ("p", 0.98, 0.7)}, 0.0, BLOCK)
    return rounded(sc.from_blocks(f, ["track_id"], "frame_ix", ["y"], BLOCK))


def _k1_sql() -> str:
    loop = lp.Loop()
    g = loop.follow("g", lp.knee(lp.level_db("l", "r"), "-12", "3.0", 6.0), keep(30.0), keep(200.0))
    k = loop.set("k", f"{lp.linear(g)} * {lp.linear('1')}")
    return stepwise(loop, *[loop.set(f"{c}1", f"{c} + ({c} * {k} - {c}) * 0.8") for c in "lr"])


@query("k1_compress", _k1_sql())
def k1(spark, sf):
    return unblocked(dy.compress(line_blocks(spark, sf), RATE, -12.0, 3.0, 30.0, 200.0, 6.0, 1.0, 0.8, BLOCK))


def _k2_sql() -> str:
    loop, det = lp.Loop(), lp.coefficients(fl.design("band_pass", 10.0, RATE, q=1.0))
    a, b = (loop.section(f"d{c}", c, det) for c in "lr")
    g = loop.follow("g", f"greatest({lp.knee(lp.level_db(a, b), '-22', '2.0', 3.0)}, -3)", keep(15.0), keep(140.0))
    return stepwise(loop, *[loop.set(f"{c}1", f"{c} + {d} * ({lp.linear(g)} - 1)") for c, d in (("l", a), ("r", b))])


@query("k2_dynamic_eq", _k2_sql())
def k2(spark, sf):
    return unblocked(dy.dynamic_eq(line_blocks(spark, sf), RATE, 10.0, 1.0, -22.0, 2.0, 15.0, 140.0, 3.0, BLOCK))


def _k3_sql() -> str:
    loop = lp.Loop()
    lo, hi = (lp.coefficients(fl.design(shape, hz, RATE, q=0.70710678)) for shape, hz in (("low_pass", 5.0), ("high_pass", 20.0)))
    band = {}
    for c in "lr":
        band["lo", c], band["hi", c] = (loop.section(f"{n}{c}2", loop.section(f"{n}{c}1", c, k), k) for n, k in (("lo", lo), ("hi", hi)))
        band["mi", c] = loop.set(f"mi{c}", f"{c} - {band['lo', c]} - {band['hi', c]}")
    gains = {n: loop.follow(f"g{n}", lp.knee(lp.level_db(band[n, "l"], band[n, "r"]), t, r, 4.0), keep(25.0), keep(160.0))
             for n, t, r in (("lo", "-18", "1.4"), ("mi", "-16", "1.3"), ("hi", "-18", "1.4"))}
    return stepwise(loop, *[loop.set(f"{c}9", " + ".join(f"{band[n, c]} * {lp.linear(g)}" for n, g in gains.items())) for c in "lr"])


@query("k3_multiband", _k3_sql())
def k3(spark, sf):
    return unblocked(dy.multiband(line_blocks(spark, sf), RATE, 5.0, 20.0, block=BLOCK))


_FAST, _SLOW = 1 - fl.time_keep(30.0, RATE), 1 - fl.time_keep(350.0, RATE)


@query("k4_transient_shape", f"""WITH {SIG_LINE},
e AS (SELECT *, {pole('greatest(abs(l), abs(r))', _FAST, 'f')}, {pole('greatest(abs(l), abs(r))', _SLOW, 's')} FROM sig_line),
h AS (SELECT *, least(greatest((f - s) / greatest(s, 1e-6), -1), 1) AS sh FROM e),
g AS (SELECT *, 1 + (pow(10, CASE WHEN sh >= 0 THEN 2 * sh ELSE -0.3 * -sh END / 20) - 1) * 0.75 AS g FROM h)
SELECT track_id, frame_ix, {rd('l * g')} AS l, {rd('r * g')} AS r FROM g""")
def k4(spark, sf):
    return unblocked(dy.transient_shape(line_blocks(spark, sf), RATE, 2.0, -0.3, 30.0, 350.0, 0.75, BLOCK))


_BM = fl.cutoff_alpha(10.0, RATE)


@query("k5_stereo_bass_mono", f"""WITH {SIG_LINE},
e AS (SELECT *, (l + r) / 2 AS m, (l - r) / 2 AS d, {pole('(l - r) / 2', _BM, 'lo')} FROM sig_line),
o AS (SELECT *, (d - lo) * 1.2 + lo * 0.08 AS o FROM e)
SELECT track_id, frame_ix, {rd('m + o')} AS l, {rd('m - o')} AS r FROM o""")
def k5(spark, sf):
    return unblocked(dy.stereo_bass_mono(line_blocks(spark, sf), RATE, 1.2, 10.0, BLOCK))


def _k6_sql() -> str:
    loop = lp.Loop()
    return stepwise(loop, *lp.limited(loop, "l", "r", lp.linear("-4"), keep(150.0)))


@query("k6_limit", _k6_sql())
def k6(spark, sf):
    return unblocked(dy.limit(line_blocks(spark, sf), RATE, -4.0, 150.0, BLOCK))


_FLOOR, _RISE, _FALL = 2 * 10 ** (-10 / 20), 1 - 1 / RATE / (0.005 + 1 / RATE), 1 - 1 / RATE / (0.080 + 1 / RATE)
_LEAST = max(10 ** (-6 / 20), 0.1)


def _gate_sql(c: str) -> str:
    return rd(f"CASE WHEN e{c} < {_FLOOR!r} THEN {c} * least(greatest(e{c} / {_FLOOR!r}, {_LEAST!r}), 1) ELSE {c} END") + f" AS {c}"


@query("k7_denoise_gate", f"""WITH RECURSIVE {MATERIALIZED_LINE},
{stepped({f'e{c}': (f'abs(s.{c})', _FALL, _RISE) for c in 'lr'})}
SELECT track_id, frame_ix, {_gate_sql('l')}, {_gate_sql('r')} FROM st""")
def k7(spark, sf):
    return unblocked(dy.denoise_gate(line_blocks(spark, sf), RATE, -10.0, 6.0, 0.1, BLOCK))


_RF, _RS = 1 / RATE / (0.002 + 1 / RATE), 1 / RATE / (0.050 + 1 / RATE)
_TOP = 10 ** (3 / 20)


@query("k8_transient_repair", f"""WITH {SIG_LINE},
e AS (SELECT *, {pole('abs(l)', _RS, 'sl')}, {pole('abs(r)', _RS, 'sr')},
  {_RF!r} * list_reduce([abs(l), abs(lag(l, 1, 0) OVER w), abs(lag(l, 2, 0) OVER w), abs(lag(l, 3, 0) OVER w), abs(lag(l, 4, 0) OVER w),
    abs(lag(l, 5, 0) OVER w), abs(lag(l, 6, 0) OVER w), abs(lag(l, 7, 0) OVER w), abs(lag(l, 8, 0) OVER w), abs(lag(l, 9, 0) OVER w),
    abs(lag(l, 10, 0) OVER w), abs(lag(l, 11, 0) OVER w)], lambda a, b, i: a + b * pow({1 - _RF!r}, i - 1)) AS fl,
  {_RF!r} * list_reduce([abs(r), abs(lag(r, 1, 0) OVER w), abs(lag(r, 2, 0) OVER w), abs(lag(r, 3, 0) OVER w), abs(lag(r, 4, 0) OVER w),
    abs(lag(r, 5, 0) OVER w), abs(lag(r, 6, 0) OVER w), abs(lag(r, 7, 0) OVER w), abs(lag(r, 8, 0) OVER w), abs(lag(r, 9, 0) OVER w),
    abs(lag(r, 10, 0) OVER w), abs(lag(r, 11, 0) OVER w)], lambda a, b, i: a + b * pow({1 - _RF!r}, i - 1)) AS fr
  FROM sig_line WINDOW w AS (PARTITION BY track_id ORDER BY frame_ix)),
g AS (SELECT *, CASE WHEN fl > sl * 1.3 AND sl > 1e-4 THEN 1 + ({_TOP!r} - 1) * (fl - sl) / fl END AS gl,
        CASE WHEN fr > sr * 1.3 AND sr > 1e-4 THEN 1 + ({_TOP!r} - 1) * (fr - sr) / fr END AS gr FROM e)
SELECT track_id, frame_ix, {rd('coalesce(least(greatest(l * gl, -1), 1), l)', 5)} AS l,
  {rd('coalesce(least(greatest(r * gr, -1), 1), r)', 5)} AS r FROM g""".replace(
      "coalesce(least(greatest(l * gl, -1), 1), l)", "CASE WHEN gl IS NULL THEN l ELSE least(greatest(l * gl, -1), 1) END").replace(
      "coalesce(least(greatest(r * gr, -1), 1), r)", "CASE WHEN gr IS NULL THEN r ELSE least(greatest(r * gr, -1), 1) END"))
def k8(spark, sf):
    b = dy.transient_repair(line_blocks(spark, sf), RATE, 3.0, 4.0, 0.3, BLOCK)
    return rounded(sc.from_blocks(b, ["track_id"], "frame_ix", ["l", "r"], BLOCK), digits=5)


def _k9_sql() -> str:
    from .pairing import ENVELOPE_CTE

    loop = lp.Loop()
    det = lp.coefficients(fl.design("band_pass", 10.0, RATE, q=2.0**0.5))
    ridden = [loop.set(f"{c}1", f"{c} * {lp.linear('greatest(-2 * a, -1.5)')}") for c in "lr"]
    cut = [loop.set(f"{c}2", f"{x} + {loop.section(f'd{c}', x, det)} * ({lp.linear('greatest(-4 * a, -2.5)')} - 1)") for c, x in zip("lr", ridden)]
    peak = loop.set("p", f"greatest(abs({cut[0]}), abs({cut[1]}))")
    fast, slow = loop.follow("f", peak, keep(15.0), keep(0.5)), loop.follow("s", peak, keep(120.0), keep(12.0))
    g = loop.set("g", f"1 - least(0.5 * a, 0.35) * least(greatest(({fast} - {slow}) / greatest({fast}, 1e-12), 0), 1)")
    mid, side = (loop.set(n, f"({cut[0]} {sign} {cut[1]}) * {g} / 2") for n, sign in (("m", "+"), ("d", "-")))
    narrow = f"(1 - least(greatest(0.5 * a, 0), 0.3)) * {side}"
    l, r = loop.set("l9", f"{mid} + {narrow}"), loop.set("r9", f"{mid} - {narrow}")
    line = ENVELOPE_CTE.replace("sig_line AS (", "sig_line AS MATERIALIZED (")
    return f"""WITH RECURSIVE {line},
nx AS (SELECT *, coalesce(lead(activity) OVER (PARTITION BY track_id ORDER BY hop_ix), activity) AS nxt FROM env),
src AS MATERIALIZED (SELECT s.track_id, s.frame_ix, s.l, s.r, activity + (nxt - activity) * (s.frame_ix % 16) / 16.0 AS a
  FROM sig_line s JOIN nx ON nx.track_id = s.track_id AND nx.hop_ix = s.frame_ix // 16),
{loop.sql('src', 'track_id, frame_ix, l, r, a', [l, r])}
SELECT track_id, frame_ix, {rd(l)} AS l, {rd(r)} AS r FROM st"""


@query("k9_guided_apply", _k9_sql())
def k9(spark, sf):
    """Amounts from the activity envelope of each series, as a control track would give them."""
    from ..operators import pairing as pa

    f = sig_line(spark, sf, reused=True)
    env = pa.interpolate_activity(f, pa.activity_envelope(fr.to_long(f), 16), 16, 64)
    a = F.col("activity")
    amounts = env.withColumns({"gain_db": a * -2.0, "cut_db": a * -4.0, "tame": a * 0.5, "narrow": a * 0.5})
    b = sc.to_blocks(cut_lineage(amounts), ["track_id"], "frame_ix", ["l", "r", "gain_db", "cut_db", "tame", "narrow"], BLOCK)
    return unblocked(dy.guided_apply(b, RATE, 10.0, 1.0, block=BLOCK))


PLAN = [
    {"id": "pre", "type": "gain", "params": {"gain_db": 2.0}},
    {"id": "trim", "type": "gain", "params": {"gain_db": -0.5}},
    {"id": "tone", "type": "eq", "params": {"bands": [dict(shape="low_shelf", frequency_hz=5.0, gain_db=1.5)]}},
    {"id": "glue", "type": "compressor", "params": dict(threshold_db=-12.0, ratio=2.0, attack_ms=30.0, release_ms=200.0)},
    {"id": "warm", "type": "saturation", "bypass": True, "params": dict(drive_db=3.0, mix=0.2)},
    {"id": "clip", "type": "clipper", "params": dict(threshold_db=-1.0, softness=0.25)},
    {"id": "top", "type": "limiter", "params": dict(ceiling_db=-1.0, release_ms=150.0)},
]


def _k10_sql() -> str:
    loop = lp.Loop()
    shelf = lp.coefficients(fl.design("low_shelf", 5.0, RATE, 1.5, 0.707))
    x, y = (loop.section(f"e{c}", loop.set(f"{c}1", f"{c} * {lp.linear('1.5')}"), shelf) for c in "lr")
    g = loop.follow("g", lp.knee(lp.level_db(x, y), "-12", "2.0", 6.0), keep(30.0), keep(200.0))
    clipped = [lp.soft_clip(loop.set(f"c{n}", f"{v} * {lp.linear(g)}"), loop.set(f"top{n}", lp.linear("-1")), "0.25") for n, v in enumerate((x, y))]
    x, y = (loop.set(f"k{n}", v) for n, v in enumerate(clipped))
    return stepwise(loop, *lp.limited(loop, x, y, lp.linear("-1"), keep(150.0)))


@query("k10_run_graph", _k10_sql())
def k10(spark, sf):
    return unblocked(dy.run_graph(line_blocks(spark, sf), PLAN, RATE, BLOCK))


#: each series' own plan: the planner's, from the measurements of the order with the number of the series; even series take
#: the preserving variant
PLANNED_RATE = 8000.0


def _plan_keep(ms: str) -> str:
    return f"exp(-1.0 / (0.001 * ({ms}) * {PLANNED_RATE}))"


def _k10_planned_sql() -> str:
    """All nodes of both variants in a row; those that a series' plan does not have pass its frames on."""
    from .rules import REPORT

    loop = lp.Loop()
    x, y = "l", "r"

    def both(name: str, on: str, fn):
        nonlocal x, y
        made = fn(x, y)
        x, y = (loop.set(f"{name}_{c}", f"CASE WHEN {on} THEN {v} ELSE {old} END") for c, v, old in zip("lr", made, (x, y)))

    def bands(name: str, choices: list[tuple[str, tuple]]):
        """One band of the equaliser, by the first condition that holds."""
        nonlocal x, y
        designs = [(on, lp.coefficients(fl.design(shape, hz, PLANNED_RATE, gain, q))) for on, (shape, hz, gain, q) in choices]
        rest = ("1.0", "0.0", "0.0", "0.0", "0.0")
        chosen = tuple("CASE " + " ".join(f"WHEN {on} THEN {c[i]}" for on, c in designs) + f" ELSE {rest[i]} END" for i in range(5))
        x, y = (loop.section(f"{name}_{c}", v, chosen) for c, v in (("l", x), ("r", y)))

    def dynamic(name: str, on: str, hz, q, threshold, ratio, attack, release, most: str):
        det = lp.coefficients(fl.design("band_pass", hz, PLANNED_RATE, q=q))
        a, b = (loop.section(f"{name}d{c}", v, det) for c, v in (("l", x), ("r", y)))
        g = loop.follow(f"{name}g", f"greatest({lp.knee(lp.level_db(a, b), str(threshold), str(ratio), 3.0)}, -({most}))", _plan_keep(str(attack)), _plan_keep(str(release)))
        both(name, on, lambda p, q_: [f"{v} + {d} * ({lp.linear(g)} - 1)" for v, d in ((p, a), (q_, b))])

    def stereo(name: str, on: str, width: str, hz: str):
        side = loop.set(f"{name}_s", f"({x} - {y}) / 2")
        alpha = loop.set(f"{name}_a", f"1 - exp(-2 * pi() * ({hz}) / {PLANNED_RATE})")
        low = loop.set(f"{name}_p", f"{alpha} * {side} + (1 - {alpha}) * p_{name}_p", 0.0)
        wide = loop.set(f"{name}_w", f"({side} - {low}) * ({width}) + {low} * 0.08")
        both(name, on, lambda p, q: [f"({p} + {q}) / 2 + {wide}", f"({p} + {q}) / 2 - {wide}"])

    def warm(name: str, on: str, drive: float, mix: float):
        k = repr(10 ** (drive / 20))
        both(name, on, lambda p, q: [f"{v} * {1 - mix!r} + tanh({v} * {k}) / tanh({k}) * {mix!r}" for v in (p, q)])

    both("pre", "true", lambda p, q: [f"{v} * {lp.linear('CASE WHEN va THEN ga ELSE gb END')}" for v in (p, q)])
    bands("b1", [("va AND max_abs_dc > 0.003", ("high_pass", 18, 0.0, 0.707))])
    bands("b2", [("va AND lw > 0.48", ("low_shelf", 105, -1.2, 0.707)), ("va AND lw < 0.2", ("low_shelf", 95, 0.6, 0.707)),
                 ("NOT va AND lw > 0.52", ("low_shelf", 100, -0.55, 0.707))])
    bands("b3", [("va AND upper_mid > 0.23", ("peak", 3500, -0.8, 0.9)), ("NOT va AND upper_mid > 0.26", ("peak", 3600, -0.4, 0.8))])
    bands("b4", [("va AND high > 0.13 AND centroid_hz > 3200", ("high_shelf", 8500, -0.6, 0.707)),
                 ("va AND high < 0.045 AND centroid_hz < 2200", ("high_shelf", 9000, 0.45, 0.707))])
    dynamic("dl", "va AND lw > 0.42", 70, 1.0, -20, 2.0, 18, 150, "CASE WHEN lw > 0.55 THEN 3.0 ELSE 2.0 END")
    dynamic("du", "va AND upper_mid > 0.2", 3800, 1.2, -24, 1.8, 8, 90, "1.8")
    curve = lp.level_db(x, y)
    first, second = (lp.knee(curve, t, r, k) for t, r, k in (("-17", "CASE WHEN cr < 8 THEN 1.25 ELSE 1.55 END", 6.0), ("-14", "1.22", 8.0)))
    glue = loop.follow("glue", f"CASE WHEN va THEN {first} ELSE {second} END", _plan_keep("CASE WHEN NOT va THEN 40.0 WHEN cr < 8 THEN 35.0 ELSE 24.0 END"),
                       _plan_keep("CASE WHEN va THEN 120.0 ELSE 180.0 END"))
    mix = "CASE WHEN NOT va THEN 0.42 WHEN cr < 8 THEN 0.45 ELSE 0.7 END"
    both("comp", "true", lambda p, q: [f"{v} + ({v} * {lp.linear(glue)} - {v}) * ({mix})" for v in (p, q)])
    lo, hi = (lp.coefficients(fl.design(shape, hz, PLANNED_RATE, q=0.70710678)) for shape, hz in (("low_pass", 125), ("high_pass", 5200)))
    part = {}
    for c, v in (("l", x), ("r", y)):
        part["lo", c], part["hi", c] = (loop.section(f"m{n}{c}2", loop.section(f"m{n}{c}1", v, k), k) for n, k in (("lo", lo), ("hi", hi)))
        part["mi", c] = loop.set(f"mmi{c}", f"{v} - {part['lo', c]} - {part['hi', c]}")
    gains = {n: loop.follow(f"mg{n}", lp.knee(lp.level_db(part[n, "l"], part[n, "r"]), t, r, 4.0), _plan_keep("28"), _plan_keep("170"))
             for n, t, r in (("lo", "-19", "1.45"), ("mi", "-16", "1.2"), ("hi", "-18", "1.3"))}
    both("multi", "va AND (short_term_variation > 5 OR lw > 0.52)",
         lambda p, q: [" + ".join(f"{part[n, c]} * {lp.linear(g)}" for n, g in gains.items()) for c in "lr"])
    peak = loop.set("tpk", f"greatest(abs({x}), abs({y}))")
    ends = [loop.set(n, f"(1 - {_plan_keep(ms)}) * {peak} + {_plan_keep(ms)} * p_{n}", 0.0) for n, ms in (("tf", "3"), ("ts", "32"))]
    shape = loop.set("tsh", f"least(greatest(({ends[0]} - {ends[1]}) / greatest({ends[1]}, 1e-6), -1), 1)")
    tg = loop.set("tg", f"1 + ({lp.linear(f'CASE WHEN {shape} >= 0 THEN 1.25 * {shape} ELSE 0.15 * {shape} END')} - 1) * 0.75")
    both("tr", "va AND cr < 9", lambda p, q: [f"{v} * {tg}" for v in (p, q)])
    warm("sata", "va AND clipped_samples = 0 AND true_peak_dbtp < 0.5", 2.0, 0.10)
    stereo("sta", "va AND channels = 2", "CASE WHEN correlation < 0.2 THEN 0.95 WHEN correlation > 0.75 AND mid_width < 0.35 THEN 1.08 ELSE 1.0 END",
           "CASE WHEN low_width > 0.15 THEN 115.0 ELSE 85.0 END")
    stereo("stb", "NOT va AND channels = 2 AND low_width > 0.22", "1.0", "100.0")
    warm("satb", "NOT va AND clipped_samples = 0 AND cr > 8", 1.0, 0.04)
    top, soft = loop.set("ctop", f"CASE WHEN ta > -10.2 THEN {lp.linear('-1.7')} ELSE {lp.linear('-1.25')} END"), "CASE WHEN ta > -10.2 THEN 0.32 ELSE 0.2 END"
    both("clip", "va", lambda p, q: [lp.soft_clip(v, top, soft) for v in (p, q)])
    l, r = lp.limited(loop, x, y, lp.linear("-1"), _plan_keep("CASE WHEN va THEN 85.0 ELSE 120.0 END"))
    used = ("va, ga, gb, ta, lw, cr, max_abs_dc, upper_mid, high, centroid_hz, short_term_variation, clipped_samples, true_peak_dbtp, channels, "
            "correlation, mid_width, low_width")
    from .rules import PLANNED

    return f"""WITH RECURSIVE {MATERIALIZED_LINE},{REPORT},
{PLANNED},
src AS MATERIALIZED (SELECT s.frame_ix, s.l, s.r, p.*, s.track_id % 2 = 1 AS va FROM sig_line s JOIN p3 p ON p.track_id = s.track_id),
{loop.sql('src', f'track_id, frame_ix, l, r, {used}', [l, r])}
SELECT track_id, frame_ix, {rd(l)} AS l, {rd(r)} AS r FROM st"""


@query("k10_planned_graph", _k10_planned_sql())
def k10_planned(spark, sf):
    """Every series through the nodes that the planner chose for it."""
    from ..operators.planned import run_plans
    from ..plans.planner import plan_ab
    from .rules import report

    b = line_blocks(spark, sf)
    # a plan is made only where there is a series for it
    m = report(spark, sf).join(b.select("track_id").distinct(), "track_id", "left_semi")
    p = plan_ab(m).where(F.col("variant") == F.when(F.col("track_id") % 2 == 1, "a").otherwise("b")).select("track_id", "nodes")
    return unblocked(run_plans(b, p, PLANNED_RATE, BLOCK, left=False))


_LP = fl.rc_alpha(3.0, RATE)


def _e12_sql() -> str:
    loop = lp.Loop()
    loop.set("y", f"{_LP!r}::DOUBLE * (l + r) / 2 + {1 - _LP!r}::DOUBLE * p_y", 0.0)
    return f"""WITH RECURSIVE {MATERIALIZED_LINE},
{loop.sql('sig_line', 'track_id, frame_ix, l, r', ['y'])},
p AS (SELECT track_id, frame_ix // 4 AS h, sum(y * y) AS e, count(*) AS n FROM st GROUP BY ALL),
w AS (SELECT *, lead(e) OVER o AS e2, lead(n) OVER o AS n2, lead(n, 2) OVER o AS n3 FROM p WINDOW o AS (PARTITION BY track_id ORDER BY h)),
v AS MATERIALIZED (SELECT track_id, h - 2 AS pos, sqrt((e + e2) / 8) > 0.25 AS hit FROM w WHERE h >= 2 AND n + n2 = 8 AND n3 IS NOT NULL),
g AS (SELECT track_id, pos, hit AS picked, CASE WHEN hit THEN 6 ELSE 0 END AS blocked FROM v WHERE pos = 0
  UNION ALL SELECT v.track_id, v.pos, v.hit AND blocked = 0, CASE WHEN v.hit AND blocked = 0 THEN 6 ELSE greatest(blocked - 1, 0) END
  FROM g JOIN v ON v.track_id = g.track_id AND v.pos = g.pos + 1)
SELECT track_id, pos FROM g WHERE picked"""


@query("e12_refractory_pick", _e12_sql())
def e12(spark, sf):
    b = sc.to_blocks(sig_line(spark, sf).select("track_id", "frame_ix", ((F.col("l") + F.col("r")) / 2).alias("x")),
                     ["track_id"], "frame_ix", ["x"], BLOCK)
    f = sc.linear_scan(b, ["track_id"], {"y": ("x", fl.one_pole(_LP))}, BLOCK)
    w = evn.overlapping_rms(sc.from_blocks(f, ["track_id"], "frame_ix", ["y"], BLOCK), 8)
    return evn.refractory_pick(w.withColumn("hit", F.col("rms") > 0.25), ["track_id"], 6, 32)


# --- loudness ---------------------------------------------------------------------------------
def loud_hops(spark, sf):
    return cut_lineage(lo.weighted_hops(sig_embed(spark, sf), 200.0, block=512))


def _sections(system) -> list[tuple]:
    """Two second-order systems in series, taken apart again."""
    first = fl.System(system.a[:2, :2], system.b[:2], np.array([1.0, 0.0]), system.d)
    second = fl.System(system.a[2:, 2:], np.array([0.0, 0.0]), np.array([1.0, 0.0]), 1.0)
    # the second section of the weighting has unit gain, so its inputs follow from the coupling
    second = fl.System(second.a, system.a[2:, 0], second.c, 1.0)
    return [lp.coefficients(first), lp.coefficients(second)]


def _d21_sql() -> str:
    loop = lp.Loop()
    first, second = _sections(fl.k_weighting(200.0))
    ends = [loop.section(f"{c}2", loop.section(f"{c}1", c, first), second) for c in "lr"]
    level = "CASE WHEN {0} > 0 THEN -0.691 + 10 * log10({0}) ELSE -200 END".format
    return f"""WITH RECURSIVE {SIG_EMBED},
src AS MATERIALIZED (SELECT * FROM sig_embed),
{loop.sql('src', 'track_id, frame_ix, l, r', ends)},
h AS (SELECT track_id, frame_ix // 20 AS hop, sum({ends[0]} * {ends[0]} + {ends[1]} * {ends[1]}) AS e FROM st GROUP BY ALL HAVING count(*) = 20),
t AS (SELECT track_id, hop, CASE WHEN hop >= 3 THEN sum(e) OVER m / 80 END AS m, CASE WHEN hop >= 29 THEN sum(e) OVER s / 600 END AS s FROM h
  WINDOW m AS (PARTITION BY track_id ORDER BY hop ROWS 3 PRECEDING), s AS (PARTITION BY track_id ORDER BY hop ROWS 29 PRECEDING)),
b AS (SELECT track_id, {level('max(m)')} AS max_momentary, {level('max(s)')} AS max_short_term FROM t GROUP BY 1),
i1 AS (SELECT track_id, {level('avg(m)')} - 10 AS g FROM t WHERE m IS NOT NULL AND {level('m')} >= -70 GROUP BY 1),
i2 AS (SELECT track_id, {level('avg(m)')} AS integrated FROM t JOIN i1 USING (track_id) WHERE m IS NOT NULL AND {level('m')} >= greatest(g, -70) GROUP BY 1),
p AS (SELECT track_id, s, {level('s')} AS st FROM t WHERE s IS NOT NULL AND (hop - 29) % 10 = 0 AND {level('s')} >= -70),
p1 AS (SELECT track_id, {level('avg(s)')} - 20 AS g FROM p GROUP BY 1),
p2 AS (SELECT track_id, st, row_number() OVER (PARTITION BY track_id ORDER BY st) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM p JOIN p1 USING (track_id) WHERE st >= g),
lra AS (SELECT track_id, max(st) FILTER (i = floor((n - 1) * 0.95 + 0.5)) - max(st) FILTER (i = floor((n - 1) * 0.10 + 0.5)) AS lra FROM p2 GROUP BY 1),
v AS (SELECT track_id, quantile_cont({level('s')}, 0.95) - quantile_cont({level('s')}, 0.1) AS v FROM t WHERE s > 0 GROUP BY 1)
SELECT track_id, {rd('coalesce(integrated, -200)')} AS integrated_lufs, {rd('coalesce(max_momentary, -200)')} AS max_momentary,
  {rd('coalesce(max_short_term, -200)')} AS max_short_term, {rd('coalesce(lra, 0)')} AS loudness_range, {rd('coalesce(v, 0)')} AS short_term_variation
FROM b LEFT JOIN i2 USING (track_id) LEFT JOIN lra USING (track_id) LEFT JOIN v USING (track_id)"""


@query("d21_loudness_bs1770", _d21_sql())
def d21(spark, sf):
    return rounded(lo.loudness(loud_hops(spark, sf)))


def _d22_sql() -> str:
    bank = lo.oversampling(4, 12)
    taps = ", ".join(f"({k}, {d - 11}, {float(bank[d, k])!r}::DOUBLE)" for k in range(3) for d in range(24))
    return f"""WITH {LONG_LINE.replace("long_line AS (", "long_line AS MATERIALIZED (")},
taps(k, d, w) AS (VALUES {taps}),
y AS (SELECT track_id, ch, frame_ix - d AS place, k, sum(x * w) AS y FROM long_line, taps GROUP BY ALL),
n AS (SELECT track_id, max(frame_ix) AS last FROM long_line GROUP BY 1),
p AS (SELECT track_id, max(abs(y)) AS p FROM y JOIN n USING (track_id) WHERE place BETWEEN 0 AND last GROUP BY 1),
s AS (SELECT track_id, max(abs(x)) AS s FROM long_line GROUP BY 1)
SELECT track_id, {rd('greatest(p, s)')} AS true_peak, {rd('20 * log10(greatest(p, s))')} AS true_peak_dbtp, {rd('20 * log10(s)')} AS sample_peak_db,
  {rd('greatest(0, 20 * log10(greatest(p, s)) - 20 * log10(s))')} AS peak_delta_db FROM p JOIN s USING (track_id)"""


@query("d22_true_peak", _d22_sql())
def d22(spark, sf):
    from ..operators.integrity import peak_rms_crest

    f = sig_line(spark, sf, reused=True)
    t = lo.true_peak(f, block=BLOCK)
    j = t.join(peak_rms_crest(f).select("track_id", "sample_peak_db"), "track_id")
    return rounded(j.withColumn("peak_delta_db", F.greatest(F.lit(0.0), F.col("true_peak_dbtp") - F.col("sample_peak_db"))))


@query("d23_short_term_variation", f"""WITH {SIG_LINE},
h AS (SELECT track_id, frame_ix // 10 AS hop_ix, sum(l * l + r * r) AS e, count(*) AS n FROM sig_line GROUP BY ALL),
s AS (SELECT track_id, hop_ix, sum(e) OVER w / sum(n) OVER w AS s FROM h
      WINDOW w AS (PARTITION BY track_id ORDER BY hop_ix ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
d AS (SELECT track_id, -0.691 + 10 * log10(s) AS st FROM s WHERE hop_ix >= 29 AND s > 0)
SELECT track_id, {rd('quantile_cont(st, 0.95) - quantile_cont(st, 0.1)')} AS short_term_variation FROM d GROUP BY 1""")
def d23(spark, sf):
    f = sig_line(spark, sf).withColumn("_e", F.col("l") * F.col("l") + F.col("r") * F.col("r"))
    h = f.groupBy("track_id", F.floor(F.col("frame_ix") / 10).cast("bigint").alias("hop_ix")).agg(
        F.sum("_e").alias("e"), F.count(F.lit(1)).alias("n"))
    s = lo.rolling_energy(h, 29, "s", 64).filter("hop_ix >= 29").select("track_id", lo.lufs(F.col("s")).alias("st"))
    return rounded(lo.short_term_variation(s))


@query("k11_normalize_to_target")
def k11(spark, sf):
    from ..plans.normalize import normalize_to_target

    b = sc.to_blocks(sig_embed(spark, sf), ["track_id"], "frame_ix", ["l", "r"], 512)
    return rounded(normalize_to_target(b, 200.0, -14.0, -1.0, 512)[1])


# --- repair, resampling, playback -----------------------------------------------------------------
@query("e17_declip", f"""WITH {LONG_LINE.replace("long_line AS (", "long_line AS MATERIALIZED (")},
c AS (SELECT *, abs(x) >= 0.9 AS hit, frame_ix - row_number() OVER (PARTITION BY track_id, ch, abs(x) >= 0.9 ORDER BY frame_ix) AS isl FROM long_line),
rn AS (SELECT track_id, ch, min(frame_ix) AS s, max(frame_ix) AS e FROM c WHERE hit GROUP BY track_id, ch, isl),
an AS (SELECT rn.*, a.x AS y0, b.x AS y1, p.x AS y2, q.x AS y3 FROM rn
  JOIN long_line a ON a.track_id = rn.track_id AND a.ch = rn.ch AND a.frame_ix = s - 2
  JOIN long_line b ON b.track_id = rn.track_id AND b.ch = rn.ch AND b.frame_ix = s - 1
  JOIN long_line p ON p.track_id = rn.track_id AND p.ch = rn.ch AND p.frame_ix = e + 1
  JOIN long_line q ON q.track_id = rn.track_id AND q.ch = rn.ch AND q.frame_ix = e + 2),
fx AS (SELECT track_id, ch, f AS frame_ix, y0, y1, y2, y3, (f - s + 1) / (e - s + 2) AS t FROM (SELECT *, unnest(range(s, e + 1)) AS f FROM an)),
nw AS (SELECT track_id, ch, frame_ix, greatest(0.9, abs((2*t*t*t - 3*t*t + 1) * y1 + (t*t*t - 2*t*t + t) * (y2 - y0) / 2
    + (3*t*t - 2*t*t*t) * y2 + (t*t*t - t*t) * (y3 - y1) / 2)) AS v FROM fx)
SELECT track_id, ch, frame_ix, {rd('CASE WHEN v IS NULL THEN x WHEN x >= 0 THEN v ELSE -v END', 7)} AS x, v IS NOT NULL AS repaired
FROM long_line LEFT JOIN nw USING (track_id, ch, frame_ix)""")
def e17(spark, sf):
    return rounded(rp.declip(fr.to_long(sig_line(spark, sf, reused=True)), 0.9, block=BLOCK), digits=7)


@query("j16_resample", f"""WITH {LONG_LINE.replace("long_line AS (", "long_line AS MATERIALIZED (")},
d AS (SELECT k, tap, tap - ((k * 160) % 147) / 147.0::DOUBLE AS d, 0.94::DOUBLE * 441 / 480 AS c FROM (SELECT unnest(range(147)) AS k), (SELECT unnest(range(-15, 17)) AS tap)),
w AS (SELECT k, tap, CASE WHEN abs(d) > 16 THEN 0 ELSE (CASE WHEN d = 0 THEN 1 ELSE sin(pi() * c * d) / (pi() * c * d) END)
  * (0.42 + 0.5 * cos(pi() * d / 16) + 0.08 * cos(2 * pi() * d / 16)) END AS w FROM d),
h AS (SELECT k, tap, w / sum(w) OVER (PARTITION BY k) AS h FROM w),
n AS (SELECT track_id, ch, max(frame_ix) + 1 AS n FROM long_line GROUP BY ALL),
o AS (SELECT track_id, ch, n, unnest(range(CAST(floor(n * 441 / 480.0::DOUBLE + 0.5) AS BIGINT))) AS i FROM n),
t AS (SELECT track_id, ch, i, h, least(i * 480 // 441, n - 1) + tap AS frame_ix FROM o JOIN h ON h.k = i % 147)
SELECT track_id, ch, i AS frame_ix, {rd('coalesce(sum(h * x), 0)')} AS x FROM t LEFT JOIN long_line USING (track_id, ch, frame_ix) GROUP BY ALL""")
def j16(spark, sf):
    return rounded(rp.resample(fr.to_long(sig_line(spark, sf, reused=True)), 480, 441, 16, block=BLOCK))


@query("j9_profile_fanout")
def j9(spark, sf):
    return rounded(rp.profile_fanout(sig_line(spark, sf), RATE, hz_scale=0.002, block=BLOCK))


@query("d24_profile_scores")
def d24(spark, sf):
    f = sig_line(spark, sf, reused=True)
    p = rp.profile_scores(rp.profile_fanout(f, RATE, hz_scale=0.002, block=BLOCK))
    rms = f.groupBy("track_id").agg(F.sqrt(F.avg((F.col("l") * F.col("l") + F.col("r") * F.col("r")) / 2)).alias("rms"))
    return rounded(rp.translation_summary(p, rms).withColumn("warnings", F.array_join("warnings", ",")))


@query("d28_reference_profile")
def d28(spark, sf):
    return rounded(rp.reference_profile(sig_embed(spark, sf), 44100.0))


@query("d30_segment_characteristics")
def d30(spark, sf):
    return rounded(rp.segment_characteristics(sig_line(spark, sf), 4000.0, 300))


@query("d39_source_presence", f"""WITH {SIG_LINE},
m AS (SELECT track_id, sqrt(avg(l * l)) AS a, sqrt(avg(r * r)) AS b, sqrt(avg(pow((l + r) / 2, 2))) AS program_rms FROM sig_line GROUP BY 1),
s AS (SELECT track_id, 0 AS source, a AS source_rms, program_rms FROM m UNION ALL SELECT track_id, 1, b, program_rms FROM m)
SELECT track_id, source, {rd('source_rms')} AS source_rms, {rd('program_rms')} AS program_rms, {rd('source_rms / program_rms')} AS ratio,
  {rd('least(greatest(source_rms / program_rms, 0.5), 0.95)')} AS confidence FROM s WHERE source_rms / program_rms > 0.01""")
def d39(spark, sf):
    """Each channel of a series as one source of its mix."""
    f = sig_line(spark, sf, reused=True)
    long = fr.to_long(f)
    src = long.groupBy("track_id", F.col("ch").alias("source")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("source_rms"))
    mix = f.groupBy("track_id").agg(F.sqrt(F.avg(F.pow((F.col("l") + F.col("r")) / 2, 2.0))).alias("program_rms"))
    return rounded(evn.source_presence(src, mix))


@query("d29_estimate_f0")
def d29(spark, sf):
    return rounded(rp.segment_characteristics(sig_line(spark, sf), 4000.0, 300).select("track_id", "segment", "f0_hz"))


@query("x4_chunk_function", f"""WITH {LONG_LINE} SELECT track_id, ch, frame_ix, {rd('x * 0.5 + 0.1')} AS x FROM long_line""")
def x4(spark, sf):
    """A user function per chunk; one that maps each sample alone must come back unchanged by the stitching."""
    return rounded(fr.map_chunks(fr.to_long(sig_line(spark, sf)), 64, 16, lambda v: v * 0.5 + 0.1))


@query("e9_cumulative_share", f"""WITH {SPECTRUM_CTE} SELECT track_id, CAST(bin AS INTEGER) AS bin,
  {rd('sum(power) OVER (PARTITION BY track_id ORDER BY bin) / sum(power) OVER (PARTITION BY track_id)')} AS share FROM spec""")
def e9(spark, sf):
    return rounded(sp.cumulative_share(spectrum(spark, sf)))
