"""Each series through its own plan: filter coefficients and parameters lie next to the blocks, so one scan runs
different processors in different rows.

A plan is ``array<struct<id,type,bypass,params,bands>>`` (``plans.graph``). A series that a task can hold goes through its whole
plan there (``whole``). The others go in stages. Stage k takes every series through the k-th active
node of its plan: one linear scan for the filters of all rows (a row's program says which signal goes through which
second-order sections), one follower scan for the gains of all rows, and one expression for the rest. A stage leaves out
the scans that no plan needs there.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters as fl
from ..functions.levels import amplitude_db_clamped, clamp, clip_soft, knee_gain_db, lit, saturate, to_linear
from ..plans import graph as g
from ..session import cut_lineage
from . import whole as whole_plans
from .ordering import _same_join
from .scans import DEFAULT_BLOCK, DOUBLES, Pieces, _scan, _stacked, follow, follower_maps, limiter_map, run_limiter, run_linear

KEYS = ["track_id"]
TABLE = T.ArrayType(DOUBLES)
LINEAR = {"eq", "dynamic_eq", "multiband", "transient", "stereo"}
FOLLOWING = {"compressor", "dynamic_eq", "multiband", "limiter"}
#: signals a filter can take: both channels, their peak, their half difference
SIGNALS = [lambda l, r: l, lambda l, r: r, lambda l, r: np.maximum(np.abs(l), np.abs(r)), lambda l, r: (l - r) * 0.5]
SHAPES = ["one_pole", "peak", "low_pass", "high_pass", "low_shelf", "high_shelf", "band_pass"]
#: fixed values: what a node does where its parameters say nothing
DEFAULTS = {
    "gain": dict(gain_db=0.0),
    "compressor": dict(threshold_db=-18.0, ratio=1.5, attack_ms=20.0, release_ms=120.0, knee_db=6.0, makeup_db=0.0, mix=1.0),
    "dynamic_eq": dict(frequency_hz=80.0, q=1.0, threshold_db=-22.0, ratio=2.0, attack_ms=15.0, release_ms=140.0, max_reduction_db=3.0),
    "multiband": dict(low_crossover_hz=120.0, high_crossover_hz=5000.0, low_threshold_db=-18.0, mid_threshold_db=-16.0,
                      high_threshold_db=-18.0, low_ratio=1.4, mid_ratio=1.3, high_ratio=1.4, attack_ms=25.0, release_ms=160.0),
    "transient": dict(attack_db=0.0, sustain_db=0.0, fast_ms=3.0, slow_ms=35.0, mix=1.0),
    "saturation": dict(drive_db=0.0, mix=0.0),
    "stereo": dict(width=1.0, bass_mono_hz=90.0),
    "clipper": dict(threshold_db=-1.0, softness=0.25),
    "limiter": dict(ceiling_db=-1.0, release_ms=80.0),
}


# --- kernels: rows of one batch that share a program run together -------------------------------------


def _systems(program) -> list[tuple[int, fl.System]]:
    """Filters of a program: each is a signal's number, then ``shape, rate, frequency, gain, q`` of every section; a one-pole
    (shape 0) has its step in place of the frequency."""
    out = []
    for flat in program:
        flat = np.asarray(flat, float)
        sections = [fl.design(SHAPES[int(shape)], hz, rate, gain, q) if shape else fl.one_pole(hz)
                    for shape, rate, hz, gain, q in flat[1:].reshape(-1, 5)]
        out.append((int(flat[0]), fl.series(*sections)))
    return out


def _packed(program) -> np.ndarray:
    return np.concatenate([np.concatenate([[len(p)], p]) for p in program])


def _unpacked(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(flat):
        n = int(flat[at])
        out.append(flat[at + 1 : at + 1 + n])
        at += 1 + n
    return out


def _alike(column: pd.Series):
    """Rows by equal programs; rows without one are left out."""
    rows: dict[bytes, list[int]] = {}
    for i, program in enumerate(column):
        if program is not None and len(program):
            rows.setdefault(np.asarray(_packed([np.asarray(p, float) for p in program])).tobytes(), []).append(i)
    return [(np.frombuffer(k), np.array(v)) for k, v in rows.items()]


def planned_filters(blocks: DataFrame, program: str, out: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out``: the outputs of each row's filters (null without any). A series keeps its program."""
    known: dict[bytes, list] = {}
    over: dict[tuple[bytes, int], list] = {}

    def systems(flat: np.ndarray):
        key = flat.tobytes()
        if key not in known:
            known[key] = _systems(_unpacked(flat))
        return known[key]

    def powers(flat: np.ndarray, count: int):
        key = flat.tobytes(), count
        if key not in over:
            over[key] = [np.linalg.matrix_power(s.a, block * count) for _, s in systems(flat)]
        return over[key]

    def through(cols, start):
        """``(row, filter) -> output, end state``, many rows at once."""
        left, right, programs = cols
        for flat, rows in _alike(programs):
            plan = systems(flat)
            for some, lengths, l, r in _stacked(left.iloc[rows], right.iloc[rows]):
                some = rows[some]
                begin = [np.stack([np.zeros(s.order) if start[i] is None else start[i][k] for i in some]) for k, (_, s) in enumerate(plan)]
                done = [run_linear(s, SIGNALS[signal](l, r), begin[k]) for k, (signal, s) in enumerate(plan)]
                for n, i in enumerate(some):
                    yield i, flat, [y[n, : lengths[n]] for y, _ in done], [end[n] for _, end in done]

    def parts(flat, state):
        """A flat state cut by the orders of the systems."""
        return np.split(state, np.cumsum([s.order for _, s in systems(flat)])[:-1])

    def summarize(cols):
        res: list = [np.zeros(0)] * len(cols[0])
        for i, flat, _, ends in through(cols, [None] * len(cols[0])):
            res[i] = np.concatenate([[1.0, len(flat)], flat, *ends])  # blocks, program, end states
        return res

    def read(item):
        item = np.asarray(item, float)
        n = int(item[1])
        return int(item[0]), item[2 : 2 + n], item[2 + n :]

    def further(flat, count, state, end):
        return np.concatenate([m @ s for m, s in zip(powers(flat, count), parts(flat, state))]) + end

    def step(state, item):
        """A state is a program and its values."""
        if not len(item):
            return np.zeros(0)
        count, flat, end = read(item)
        values = end if state is None else further(flat, count, np.asarray(state, float)[1 + len(flat) :], end)
        return np.concatenate([[len(flat)], flat, values])

    def compose(first, second):
        if not len(first):
            return first
        (n1, flat, a), (n2, _, b) = read(first), read(second)
        return np.concatenate([[n1 + n2, len(flat)], flat, further(flat, n2, a, b)])

    def apply(states, cols):
        start = []
        for s in states:
            flat = np.zeros(0) if s is None or not len(s) else s[1 : 1 + int(s[0])]
            start.append(parts(flat, s[1 + len(flat) :]) if len(flat) else None)
        res: list = [None] * len(cols[0])
        for i, _, ys, _ in through(cols, start):
            res[i] = ys
        return pd.DataFrame({out: pd.Series(res, dtype=object)})

    return _scan(blocks, KEYS, block, ["l", "r", program], [out], summarize, compose, step, apply, out_type=TABLE)


def planned_followers(blocks: DataFrame, targets: str, speeds: str, out: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out``: each row's targets followed with its speeds ``[kind, falling, rising]``; kind 0 is a two-speed follower from 0,
    kind 1 a limiter from 1 that is released with ``rising``. Rows without speeds get null."""
    def alike(cols):
        for flat, rows in _alike(cols[2].map(lambda s: None if s is None else [s])):
            yield flat[1:], rows

    def columns(cols, rows):
        """``target number, rows, lengths, values`` for targets of like lengths."""
        for k in range(len(cols[1].iat[rows[0]])):
            for some, lengths, t in _stacked(cols[1].iloc[rows].map(lambda x: x[k])):
                yield k, rows[some], lengths, t

    def summarize(cols):
        res: list = [np.zeros(0)] * len(cols[0])
        for (kind, falling, rising), rows in alike(cols):
            maps: dict[int, list] = {i: [[kind]] for i in rows}
            for _, some, _, t in columns(cols, rows):
                if kind:
                    found = list(np.stack(limiter_map(t, rising), axis=1))
                else:
                    low, high = (cols[c].iloc[some].to_numpy(float) for c in (3, 4))
                    found = [m.flat() for m in follower_maps(t, falling, rising, np.minimum(low, 0.0), np.maximum(high, 0.0))]
                for i, own in zip(some, found):
                    maps[i].append(own)
            for i, own in maps.items():
                res[i] = np.concatenate(own)
        return res

    def each(flat):
        """Maps as functions, with what composes them."""
        flat = np.asarray(flat, float)
        kind, flat, own = flat[0], flat[1:], []
        while len(flat):
            if kind:
                own, flat = [*own, flat[:3]], flat[3:]
            else:
                piece, flat = Pieces.read(flat)
                own.append(piece)
        return kind, own

    def compose(first, second):
        if not len(first):
            return first
        (kind, before), (_, after) = each(first), each(second)
        if kind:
            joined = [[min(c2, s2 * c1 + i2), s2 * s1, s2 * i1 + i2] for (c1, s1, i1), (c2, s2, i2) in zip(before, after)]
        else:
            joined = [b.after(a).within(a.x[0], a.x[-1]).flat() for a, b in zip(before, after)]
        return np.concatenate([[kind], *joined])

    def step(state, item):
        if not len(item):
            return np.zeros(0)
        kind, own = each(item)
        now = [kind] * len(own) if state is None else state
        return np.array([min(m[0], m[1] * s + m[2]) if kind else float(m(s)) for m, s in zip(own, now)])

    def apply(states, cols):
        res: list = [None] * len(cols[0])
        for (kind, falling, rising), rows in alike(cols):
            for i in rows:
                res[i] = [None] * len(cols[1].iat[i])
            for k, some, lengths, t in columns(cols, rows):
                begin = np.array([kind if states.iat[i] is None else states.iat[i][k] for i in some], float)
                y = run_limiter(t, begin, rising) if kind else follow(t, begin, falling, rising)
                for n, i in enumerate(some):
                    res[i][k] = y[n, : lengths[n]]
        return pd.DataFrame({out: pd.Series(res, dtype=object)})

    hull = [F.flatten(targets)]
    return _scan(blocks, KEYS, block, ["l", targets, speeds], [out], summarize, compose, step, apply, hull, TABLE)


# --- plans as columns -------------------------------------------------------------------------------


def _section(shape: Column, hz: Column, gain_db: Column, q: Column, rate: float) -> Column:
    number = F.array_position(F.array(*[F.lit(x) for x in SHAPES[1:]]), shape)
    return F.array(number.cast("double"), F.lit(float(rate)), hz, gain_db, q)


def _plain(shape: str, hz: Column, rate: float, q: Column) -> Column:
    return _section(F.lit(shape), hz, F.lit(0.0), q, rate)


def _pole(alpha: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(zero, zero, alpha, zero, zero)


def _keep(ms: Column, rate: float) -> Column:
    return F.when(ms > 0, F.exp(-1.0 / (0.001 * F.nullif(ms, lit(0.0)) * rate))).otherwise(0.0)


def _take(signal: int, *sections: Column) -> Column:
    return F.concat(F.array(F.lit(float(signal))), *sections)


def programs(node: Column, rate: float) -> tuple[Column, Column]:
    """Filters and follower speeds of a node; null where its type has none."""
    def p(kind: str, name: str) -> Column:
        return F.coalesce(node["params"][name], F.lit(DEFAULTS[kind][name]))

    def both(*sections):
        return [_take(c, *sections) for c in (0, 1)]

    def usable(hz: Column) -> Column:
        return clamp(hz, 10.0, rate * 0.49)

    bands = F.flatten(F.transform(node["bands"], lambda b: _section(b["shape"], b["frequency_hz"], b["gain_db"], b["q"], rate)))
    det = _plain("band_pass", p("dynamic_eq", "frequency_hz"), rate, p("dynamic_eq", "q"))
    low = _plain("low_pass", p("multiband", "low_crossover_hz"), rate, F.lit(0.70710678))
    high = _plain("high_pass", p("multiband", "high_crossover_hz"), rate, F.lit(0.70710678))
    tables = {
        "eq": both(bands), "dynamic_eq": both(det), "multiband": both(low, low) + both(high, high),
        "transient": [_take(2, _pole(1.0 - _keep(p("transient", ms), rate))) for ms in ("fast_ms", "slow_ms")],
        "stereo": [_take(3, _pole(1.0 - F.exp(-2.0 * np.pi * usable(p("stereo", "bass_mono_hz")) / rate)))],
    }
    kind = node["type"]
    filters = reduce(lambda out, item: out.when(kind == item[0], F.array(*item[1])), tables.items(), F.when(F.lit(False), F.lit(None).cast(TABLE)))
    # an equaliser without bands changes nothing
    filters = F.when((kind == "eq") & (F.coalesce(F.size(node["bands"]), F.lit(0)) == 0), F.lit(None).cast(TABLE)).otherwise(filters)
    speeds = F.when(kind == "limiter", F.array(F.lit(1.0), F.lit(0.0), _keep(p("limiter", "release_ms"), rate)))
    for name in sorted(FOLLOWING - {"limiter"}):
        speeds = speeds.when(kind == name, F.array(F.lit(0.0), _keep(p(name, "attack_ms"), rate), _keep(p(name, "release_ms"), rate)))
    return filters, speeds


def _map(*arrays, fn):
    """``fn`` of the elements of equally long arrays."""
    rows = F.arrays_zip(*[a.alias(f"_{i}") for i, a in enumerate(arrays)])
    return F.transform(rows, lambda s: fn(*[s[f"_{i}"] for i in range(len(arrays))]))


def _parameters(kind: str, *names: str) -> list[Column]:
    return [F.coalesce(F.col("_params")[n], F.lit(DEFAULTS[kind][n])) for n in names]


def target_columns(kinds: set[str]) -> Column:
    """What each row's followers go after."""
    def curve(a: Column, b: Column, threshold, ratio, knee, least=None) -> Column:
        def gain(x, y):
            v = knee_gain_db(amplitude_db_clamped(F.greatest(F.abs(x), F.abs(y))), threshold, ratio, knee)
            return v if least is None else F.greatest(v, least)
        return _map(a, b, fn=gain)

    l, r, f = F.col("l"), F.col("r"), F.col("_f")
    out = F.when(F.lit(False), F.lit(None).cast(TABLE))
    if "compressor" in kinds:
        threshold, ratio, knee = _parameters("compressor", "threshold_db", "ratio", "knee_db")
        out = out.when(F.col("_kind") == "compressor", F.array(curve(l, r, threshold, ratio, knee)))
    if "limiter" in kinds:
        top = to_linear(_parameters("limiter", "ceiling_db")[0])
        out = out.when(F.col("_kind") == "limiter", F.array(_map(l, r, fn=lambda x, y: F.when(
            F.greatest(F.abs(x), F.abs(y)) > top, top / F.nullif(F.greatest(F.abs(x), F.abs(y)), lit(0.0))).otherwise(1.0))))
    if "dynamic_eq" in kinds:
        threshold, ratio, most = _parameters("dynamic_eq", "threshold_db", "ratio", "max_reduction_db")
        out = out.when(F.col("_kind") == "dynamic_eq", F.array(curve(f[0], f[1], threshold, ratio, 3.0, -F.abs(most))))
    if "multiband" in kinds:
        bands = [(f[0], f[1]), tuple(_map(x, f[i], f[i + 2], fn=lambda x, lo, hi: x - lo - hi) for i, x in enumerate((l, r))), (f[2], f[3])]
        setup = [_parameters("multiband", f"{n}_threshold_db", f"{n}_ratio") for n in ("low", "mid", "high")]
        out = out.when(F.col("_kind") == "multiband", F.array(*[curve(a, b, t, q, 4.0) for (a, b), (t, q) in zip(bands, setup)]))
    return out


def finished(kinds: set[str], i: int) -> Column:
    """Channel ``i`` after the node, from the channels, filter outputs ``_f`` and gains ``_g``."""
    l, r, f, gains = F.col("l"), F.col("r"), F.col("_f"), F.col("_g")
    x = (l, r)[i]
    out: dict[str, Column] = {}
    if "gain" in kinds:
        k = to_linear(_parameters("gain", "gain_db")[0])
        out["gain"] = F.transform(x, lambda v: v * k)
    if "eq" in kinds:
        out["eq"] = F.coalesce(f[i], x)
    if "compressor" in kinds:
        makeup, mix = _parameters("compressor", "makeup_db", "mix")
        wet, up = clamp(mix, 0, 1), to_linear(makeup)
        out["compressor"] = _map(x, gains[0], fn=lambda v, k: v + (v * to_linear(k) * up - v) * wet)
    if "dynamic_eq" in kinds:
        out["dynamic_eq"] = _map(x, f[i], gains[0], fn=lambda v, b, k: v + b * (to_linear(k) - 1.0))
    if "multiband" in kinds:
        out["multiband"] = _map(x, f[i], f[i + 2], gains[0], gains[1], gains[2], fn=lambda v, lo, hi, a, b, c: (
            lo * to_linear(a) + (v - lo - hi) * to_linear(b) + hi * to_linear(c)))
    if "transient" in kinds:
        attack, sustain, mix = _parameters("transient", "attack_db", "sustain_db", "mix")
        wet = clamp(mix, 0, 1)

        def shaped(v, fast, slow):
            s = clamp((fast - slow) / F.greatest(slow, lit(1e-6)), -1, 1)
            return v * (1.0 + (to_linear(F.when(s >= 0, s * attack).otherwise(-s * sustain)) - 1.0) * wet)
        out["transient"] = _map(x, f[0], f[1], fn=shaped)
    if "saturation" in kinds:
        drive, mix = _parameters("saturation", "drive_db", "mix")
        out["saturation"] = F.transform(x, lambda v: saturate(v, drive, clamp(mix, 0, 1)))
    if "stereo" in kinds:
        w = clamp(_parameters("stereo", "width")[0], 0, 2)
        sign = (1.0, -1.0)[i]

        def widened(a, b, low):
            side = (a - b) * 0.5
            return (a + b) * 0.5 + ((side - low) * w + low * F.least(w, lit(0.08))) * sign
        out["stereo"] = _map(l, r, f[0], fn=widened)
    if "clipper" in kinds:
        threshold, softness = _parameters("clipper", "threshold_db", "softness")
        out["clipper"] = F.transform(x, lambda v: clip_soft(v, threshold, softness))
    if "limiter" in kinds:
        top = to_linear(_parameters("limiter", "ceiling_db")[0])
        out["limiter"] = _map(x, gains[0], fn=lambda v, k: F.least(F.greatest(v * k, -top), top))
    return reduce(lambda whole, item: whole.when(F.col("_kind") == item[0], item[1]), out.items(), F.when(F.lit(False), x)).otherwise(x)


def _in_numbers(node: Column, rate: float) -> Column:
    """A node as a task takes it: type, filters, follower speeds, and its parameters in the order of ``DEFAULTS``."""
    filters, speeds = programs(node, rate)
    values = F.when(F.lit(False), F.lit(None).cast(DOUBLES))
    for kind, names in DEFAULTS.items():
        values = values.when(node["type"] == kind, F.array(*[F.coalesce(node["params"][n], F.lit(v)) for n, v in names.items()]))
    return F.struct(node["type"].alias("kind"), filters.alias("filters"), speeds.alias("speeds"), values.alias("values"))


def _usable(numbers: Column) -> Column:
    """No null, infinite or missing number among them; holds for a null array."""
    return F.coalesce(F.forall(numbers, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))), F.lit(True))


def _alone(blocks: DataFrame, plans: DataFrame, block: int) -> DataFrame:
    """Series that go through their plan stage by stage: longer than one task takes, with blocks missing or short, with values that are
    no finite numbers, or with several plans."""
    ix, size = F.col("block_ix"), F.size("l")
    special = [F.lit(float(v)) for v in ("nan", "inf", "-inf")]
    # null where the array holds a null
    clean = reduce(lambda a, b: a & b, [~F.array_contains(c, v) for c in "lr" for v in special])
    whole = (F.sum(size) <= whole_plans.FRAMES) & (F.sum(size) == F.max(ix) * block + F.max_by(size, ix)) & (F.max(size) <= block) & (
        F.min(ix) == 0) & (F.count(F.lit(1)) == F.max(ix) + 1) & F.bool_and(F.coalesce(clean, F.lit(False)))
    numbers = F.forall("_plan", lambda n: _usable(n["values"]) & _usable(n["speeds"]) & _usable(F.flatten(n["filters"])))
    odd = blocks.groupBy(*KEYS).agg(F.coalesce(whole, F.lit(False)).alias("_ok")).where("not _ok").select(*KEYS)
    return odd.unionByName(plans.groupBy(*KEYS).agg(
        ((F.count(F.lit(1)) == 1) & F.bool_and(F.coalesce(numbers, F.lit(False)))).alias("_ok")).where("not _ok").select(*KEYS)).distinct()


def run_plans(blocks: DataFrame, plans: DataFrame, rate: float, block: int = DEFAULT_BLOCK, left: bool = True) -> DataFrame:
    """Every series of ``blocks`` (``track_id, block_ix, l, r``) through the nodes of its plan (``track_id, nodes``).

    Bypassed nodes do nothing; a series with only bypassed nodes stays as it is, as does one without a plan, unless ``left`` is
    false: then it is left out. Invalid plans and unknown types are errors. ``blocks`` is read twice.

    A task takes each series that it can hold through its whole plan at once; a longer one goes stage by stage, its blocks in many
    tasks. Only the types met come to the driver, and for the stages those at each place: ten for each node of the longest plan.
    """
    broken = g.validate(F.col("nodes"))
    checked = F.when(F.size(broken) == 0, F.filter("nodes", lambda n: ~n["bypass"])).otherwise(
        F.raise_error(F.concat(F.lit("plan: "), F.array_join(broken, ", "))))
    active = plans.select(*KEYS, checked.alias("_nodes"))
    numbers = F.transform("_nodes", lambda n: _in_numbers(n, rate))
    active = cut_lineage(active.withColumn("_plan", F.coalesce(numbers, F.array())))
    for (kind,) in active.select(F.explode("_plan.kind")).distinct().collect():
        if kind not in DEFAULTS and kind != "eq":
            raise ValueError(f"unknown node type {kind}")
    odd = cut_lineage(_alone(blocks, active, block))
    if odd.isEmpty():
        return _whole(blocks, active, block, left)
    how = "left_semi", "left_anti"
    (staged, short), (some, most) = ([_same_join(t, odd, KEYS, h) for h in how] for t in (blocks, active))
    return _whole(short, most, block, left).unionByName(_staged(staged, some.drop("_plan"), rate, block, left))


def _whole(blocks: DataFrame, active: DataFrame, block: int, left: bool) -> DataFrame:
    """Each series through its whole plan in one task."""
    columns = [*KEYS, "block_ix", "l", "r"]
    rows = blocks.select(*columns, F.lit(None).cast(active.schema["_plan"].dataType).alias("_plan")).unionByName(
        active.select(*KEYS, F.lit(-1).cast("bigint").alias("block_ix"), *[F.lit(None).cast(DOUBLES).alias(c) for c in "lr"], "_plan"))
    run = whole_plans.runner(KEYS[0], _systems, SIGNALS, left)
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in columns])
    done = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "block_ix").mapInArrow(run, schema)
    return done.select(*[F.col(c).cast(blocks.schema[c].dataType) for c in columns])


def _staged(blocks: DataFrame, active: DataFrame, rate: float, block: int, left: bool) -> DataFrame:
    """Stage k takes all series through the k-th node of their plans."""
    met = active.select(F.posexplode(F.transform("_nodes", lambda n: n["type"]))).distinct().collect()
    stages: dict[int, set[str]] = {}
    for pos, kind in met:
        stages.setdefault(pos, set()).add(kind)
    b = _same_join(blocks.select(*KEYS, "block_ix", "l", "r"), active, KEYS, "left" if left else "inner")
    for k in range(len(stages)):
        kinds = stages[k]
        node = F.get("_nodes", F.lit(k))
        b = b.withColumns({"_kind": F.coalesce(node["type"], F.lit("")), "_params": node["params"]})
        filters, speeds = programs(node, rate)
        empty = F.lit(None).cast(TABLE)
        b = b.withColumn("_program", filters if kinds & LINEAR else empty)
        b = planned_filters(b, "_program", "_f", block) if kinds & LINEAR else b.withColumn("_f", empty)
        if kinds & FOLLOWING:
            b = b.withColumns({"_t": target_columns(kinds), "_s": speeds})
            # the gains are followed from targets that a scan has made: its result is read more than once
            b = planned_followers(cut_lineage(b) if kinds & LINEAR else b, "_t", "_s", "_g", block)
        else:
            b = b.withColumn("_g", empty)
        b = b.select(*KEYS, "block_ix", finished(kinds, 0).alias("l"), finished(kinds, 1).alias("r"), "_nodes")
        if kinds & (LINEAR | FOLLOWING) and any(stages[j] & (LINEAR | FOLLOWING) for j in range(k + 1, len(stages))):
            b = cut_lineage(b)
    return b.drop("_nodes")
