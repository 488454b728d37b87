"""A series through its whole plan inside one task, for series that a task can hold; longer ones are taken stage by stage
(``planned.run_plans``). Series of like lengths lie in one 2-d array, a row each, and at every place of their plans the rows
with the same node run together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .scans import _stacked, follow, limit, run_linear

#: frames that a task takes through their plans together, and the most of one series
FRAMES = 1 << 19

# numbers as Spark's functions take them: a value that is not a number is above all others
_greatest, _least = np.maximum, np.fmin


def _clamp(x, low: float, high: float):
    return _least(_greatest(x, low), high)


def _linear(db):
    return np.power(10.0, db / 20.0)


def _curve(a, b, threshold, ratio, knee):
    """Gain in dB for the louder of two channels (``levels.knee_gain_db``)."""
    over = 20.0 * np.log10(_greatest(_greatest(np.abs(a), np.abs(b)), 1e-12)) - threshold
    straight = (1.0 / _greatest(ratio, 1.0) - 1.0) * over
    bent = (1.0 / _greatest(ratio, 1.0) - 1.0) * (over + knee / 2) ** 2 / (2.0 * knee)
    soft = np.where(over <= -knee / 2, 0.0, np.where(over >= knee / 2, straight, bent))
    return np.where(knee <= 0, np.where(over <= 0, 0.0, straight), soft)


def _filtered(nodes: list[dict], l, r, systems, signals) -> list[np.ndarray]:
    """Outputs of each row's filters; rows with the same filters run together."""
    alike: dict[tuple, list[int]] = {}
    for i, node in enumerate(nodes):
        if node["filters"]:
            alike.setdefault(tuple(map(tuple, node["filters"])), []).append(i)
    out: list[np.ndarray] = []
    for program, rows in alike.items():
        rows = np.array(rows)
        x, y = (l, r) if len(rows) == len(l) else (l[rows], r[rows])
        plan = systems(program)
        out = out or [np.zeros_like(l) for _ in plan]
        for k, (signal, system) in enumerate(plan):
            out[k][rows] = run_linear(system, signals[signal](x, y), np.zeros((len(x), system.order)))[0]
    return out


def _followed(nodes: list[dict], targets: list[np.ndarray]) -> list[np.ndarray]:
    """Each row's targets followed with its speeds; targets of one speed run side by side."""
    alike: dict[tuple, list[int]] = {}
    for i, node in enumerate(nodes):
        alike.setdefault(tuple(node["speeds"]), []).append(i)
    out = [np.empty_like(t) for t in targets]
    for (kind, falling, rising), rows in alike.items():
        t = np.concatenate([t[rows] for t in targets])
        start = np.full(len(t), kind)
        done = limit(t, start, rising) if kind else follow(t, start, falling, rising)
        for k, part in enumerate(np.split(done, len(targets))):
            out[k][rows] = part
    return out


def _node(kind: str, nodes: list[dict], l, r, systems, signals):
    """Both channels after one node of each row; all nodes are of one type."""
    p = [v.reshape(-1, 1) for v in np.array([n["values"] for n in nodes], float).T] if nodes[0]["values"] else []
    f = _filtered(nodes, l, r, systems, signals)
    if kind == "gain":
        return l * _linear(p[0]), r * _linear(p[0])
    if kind == "eq":
        some = np.array([bool(n["filters"]) for n in nodes]).reshape(-1, 1)
        return tuple(np.where(some, y, x) for x, y in zip((l, r), f)) if f else (l, r)
    if kind == "compressor":
        threshold, ratio, _, _, knee, makeup, mix = p
        g = _linear(_followed(nodes, [_curve(l, r, threshold, ratio, knee)])[0])
        wet, up = _clamp(mix, 0.0, 1.0), _linear(makeup)
        return tuple(x + (x * g * up - x) * wet for x in (l, r))
    if kind == "dynamic_eq":
        _, _, threshold, ratio, _, _, most = p
        g = _linear(_followed(nodes, [_greatest(_curve(*f, threshold, ratio, np.full_like(ratio, 3.0)), -np.abs(most))])[0])
        return tuple(x + b * (g - 1.0) for x, b in zip((l, r), f))
    if kind == "multiband":
        knee = np.full_like(p[0], 4.0)
        parts = [(lo, x - lo - hi, hi) for x, lo, hi in zip((l, r), f[:2], f[2:])]
        gains = [_linear(g) for g in _followed(nodes, [_curve(parts[0][n], parts[1][n], p[2 + n], p[5 + n], knee) for n in range(3)])]
        return tuple(lo * gains[0] + mid * gains[1] + hi * gains[2] for lo, mid, hi in parts)
    if kind == "transient":
        attack, sustain, _, _, mix = p
        s = _clamp((f[0] - f[1]) / _greatest(f[1], 1e-6), -1.0, 1.0)
        shape = 1.0 + (_linear(np.where(s >= 0, s * attack, -s * sustain)) - 1.0) * _clamp(mix, 0.0, 1.0)
        return l * shape, r * shape
    if kind == "saturation":
        drive, wet = _greatest(_linear(p[0]), 1.0), _clamp(p[1], 0.0, 1.0)
        return tuple(x * (1 - wet) + np.tanh(x * drive) / np.tanh(drive) * wet for x in (l, r))
    if kind == "stereo":
        width = _clamp(p[0], 0.0, 2.0)
        middle, side = (l + r) * 0.5, (l - r) * 0.5
        wide = (side - f[0]) * width + f[0] * _least(width, 0.08)
        return middle + wide, middle - wide
    if kind == "clipper":
        top, soft = _linear(p[0]), _clamp(p[1], 0.0, 0.95)
        knee = top * (1 - soft)

        def clipped(x):
            size = np.abs(x)
            t = (size - knee) / _greatest(top - knee, 1e-9)
            bent = knee + (top - knee) * (1 - (1 - t) * (1 - t))
            return np.where(size >= top, np.sign(x) * top, np.where((soft > 0) & (size > knee), np.sign(x) * bent, x))
        return clipped(l), clipped(r)
    if kind == "limiter":
        top = _linear(p[0])
        peak = _greatest(np.abs(l), np.abs(r))
        g = _followed(nodes, [np.where(peak <= top, 1.0, top / peak)])[0]
        return tuple(_least(_greatest(x * g, -top), top) for x in (l, r))
    raise ValueError(f"unknown node type {kind}")


def through(plans: list[list[dict]], l: np.ndarray, r: np.ndarray, systems, signals) -> None:
    """Take rows of both channels, in place, through the nodes of each row's plan."""
    for k in range(max(map(len, plans), default=0)):
        kinds: dict[str, list[int]] = {}
        for i, plan in enumerate(plans):
            if k < len(plan):
                kinds.setdefault(plan[k]["kind"], []).append(i)
        for kind, rows in kinds.items():
            with np.errstate(all="ignore"):
                l[rows], r[rows] = _node(kind, [plans[i][k] for i in rows], l[rows], r[rows], systems, signals)


def _by_series(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows that lie in order of ``key``, some series at a time and each of them whole."""
    held: list[pa.RecordBatch] = []
    frames = 0
    for batch in batches:
        held.append(batch)
        frames += len(batch.column("l").flatten())
        if frames < FRAMES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ends = pc.run_end_encode(table.column(key).chunk(0)).run_ends.to_numpy()
        last = int(ends[-2]) if len(ends) > 1 else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
        frames = sum(len(b.column("l").flatten()) for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runner(key: str, systems, signals, left: bool):
    """For ``mapInArrow``: rows of ``key, block_ix, l, r, _plan`` in order, a series' plan before its blocks as block -1. Series
    without a plan stay as they are, or are left out unless ``left``."""
    def some(table: pa.Table, systems) -> pa.RecordBatch | None:
        """Whole series of at most ``FRAMES`` frames, or one series."""
        ix, keys, packed = (table.column(c).combine_chunks() for c in ("block_ix", key, "_plan"))
        column = [table.column(c).combine_chunks() for c in "lr"]
        lengths = pc.fill_null(pc.list_value_length(column[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column]
        frames = np.concatenate([[0], np.cumsum(lengths)])
        ends = pc.run_end_encode(keys).run_ends.to_numpy().astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        planned = ix.to_numpy(zero_copy_only=False) < 0
        plans = [packed[int(a)].as_py() if planned[a] else None for a in starts]
        spans = [slice(frames[a], frames[b]) for a, b in zip(starts, ends)]
        out = [x.copy() for x in flat]
        todo = [i for i, plan in enumerate(plans) if plan and spans[i].stop > spans[i].start]
        if todo:
            rows = [pd.Series([x[spans[i]] for i in todo]) for x in flat]
            for own, sizes, l, r in _stacked(*rows):
                through([plans[todo[i]] for i in own], l, r, systems, signals)
                for i, size, x, y in zip(own, sizes, l, r):
                    out[0][spans[todo[i]]], out[1][spans[todo[i]]] = x[:size], y[:size]
        keep = ~planned
        if not left:
            keep &= np.repeat([plan is not None for plan in plans], ends - starts)
            kept = np.repeat(keep, lengths)
            out = [x[kept] for x in out]
        if not keep.any():
            return None
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths[keep])]).astype(np.int32))
        mask = pa.array(keep)
        return pa.RecordBatch.from_arrays(
            [keys.filter(mask), ix.filter(mask), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in out]], [key, "block_ix", "l", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1024)(systems)
        for table in _by_series(batches, key):
            ends = pc.run_end_encode(table.column(key).combine_chunks()).run_ends.to_numpy().astype(np.int64)
            lengths = pc.fill_null(pc.list_value_length(table.column("l").combine_chunks()), 0).to_numpy(zero_copy_only=False)
            frames = np.cumsum(lengths)[ends - 1]
            a = at = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(frames, (frames[a - 1] if a else 0) + FRAMES, "right")))
                done = some(table.slice(at, int(ends[b - 1]) - at), known)
                if done is not None:
                    yield done
                a, at = b, int(ends[b - 1])
    return run
