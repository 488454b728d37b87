"""Recursive filters and followers over block tables, exact and parallel along one long series.

A block table has one row per (keys, block_ix) with equally long double arrays. Every scan reduces each full block to a
short summary of what it does to the incoming state and computes every block on its own from the state that enters it.
Those states are carried in two levels: inside groups of ``GROUP`` blocks the summaries from the group's start to each block
are composed, the few that span a group stream in order along a series, and a block's state follows from its group's
state and the composed summary before it. Summaries are closed under composition:

* linear systems: number of blocks and end state for a zero start (the transition over a block is fixed);
* limiter gain ``g -> min(t, r g + c)``: cap, slope and intercept;
* two-speed followers: the increasing piecewise-linear map of incoming to outgoing state (``Pieces``).

Only full blocks can have a successor, so series of one block skip all but the last step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import System
from .ordering import _same_join

DOUBLES = T.ArrayType(T.DoubleType())
DEFAULT_BLOCK = 65536
#: blocks whose summaries are composed into one
GROUP = 256
#: frames of a follower that are taken through together
STRIDE = 64
#: stands for places that no state reaches
FAR = 1e300
#: values that a task takes through a scan together; longer batches are cut
MOST = 1 << 21


def to_blocks(
    frames: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], block: int = DEFAULT_BLOCK
) -> DataFrame:
    """Frame rows to block rows; one array never holds more than ``block`` frames."""
    ix = F.floor(F.col(pos) / F.lit(block)).cast("bigint").alias("block_ix")
    packed = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("_p"), *values)))
    rows = frames.groupBy(*keys, ix).agg(packed.alias("_rows"))
    return rows.select(*keys, "block_ix", *[F.col("_rows")[v].cast("array<double>").alias(v) for v in values])


def from_blocks(
    blocks: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], block: int = DEFAULT_BLOCK
) -> DataFrame:
    zipped = F.arrays_zip(*[F.col(v) for v in values])
    return blocks.select(*keys, "block_ix", F.posexplode(zipped).alias("_i", "_z")).select(
        *keys, (F.col("block_ix") * block + F.col("_i")).alias(pos), *[F.col(f"_z.{v}").alias(v) for v in values]
    )


# --- per-block kernels (used inside tasks) -------------------------------------------------


def _stacked(*columns: pd.Series):
    """Rows of like lengths, filled up with zeros: yields (row numbers, lengths, one 2-d array of each column).

    The arrays of a row are equally long. A stack holds at most ``MOST`` values of a column, or one row.
    """
    lengths = columns[0].map(len).to_numpy(int)
    order = np.argsort(-lengths, kind="stable")
    a = 0
    while a < len(order):
        top = int(lengths[order[a]])
        b = min(len(order), a + max(1, MOST // max(top, 1)))
        b = a + int(np.searchsorted(-lengths[order[a:b]], -(top // 2), "right"))
        rows, out = order[a:b], []
        for column in columns:
            out.append(np.zeros((len(rows), top)))
            for i, row in enumerate(rows):
                out[-1][i, : lengths[row]] = column.iat[row]
        yield rows, lengths[rows], *out
        a = b


def _slices(arrays: pd.Series, width: int):
    """Ranges of rows with at most ``MOST`` values in ``width`` arrays like the given ones, or one row."""
    total = np.cumsum(arrays.map(len).to_numpy(int)) * width
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + MOST, "right")))
        yield a, b
        a = b


def _chunk_matrices(sys: System, n: int):
    powers = [np.eye(sys.order)]
    for _ in range(n):
        powers.append(powers[-1] @ sys.a)
    seen = np.stack([sys.c @ powers[k] for k in range(n)])  # state to outputs
    into = np.stack([powers[n - 1 - j] @ sys.b for j in range(n)], axis=1)  # inputs to end state
    h = np.array([sys.d] + [sys.c @ powers[k] @ sys.b for k in range(n - 1)])
    lag = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(lag >= 0, h[np.clip(lag, 0, None)], 0.0), seen, into, powers[n]


def run_linear(sys: System, x: np.ndarray, start: np.ndarray, chunk: int = 64):
    """Outputs and end states for rows of ``x`` from the given start states."""
    y, state, cache = np.empty_like(x), start, {}
    for at in range(0, x.shape[1], chunk):
        part = x[:, at : at + chunk]
        n = part.shape[1]
        if n not in cache:
            cache[n] = _chunk_matrices(sys, n)
        toeplitz, seen, into, step = cache[n]
        y[:, at : at + n] = part @ toeplitz.T + state @ seen.T
        state = state @ step.T + part @ into.T
    return y, state


def run_follower(t: np.ndarray, start: np.ndarray, falling: float, rising: float) -> np.ndarray:
    """Two-speed follower: retention ``falling`` while the target is below the state, else ``rising``."""
    steps, g = np.ascontiguousarray(t.T), start.copy()
    out = np.empty_like(steps)
    for k, target in enumerate(steps):
        keep = np.where(target < g, falling, rising)
        g = keep * g + (1.0 - keep) * target
        out[k] = g
    return np.ascontiguousarray(out.T)


class Pieces:
    """A continuous increasing piecewise-linear map: images ``y`` of the break points ``x``, and the slopes of its two
    affine ends. Closed under composition (``after``)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, left: float, right: float):
        self.x, self.y, self.left, self.right = x, y, left, right

    @staticmethod
    def _extend(v, x, y, left, right):
        inner = np.interp(v, x, y)
        inner = np.where(v < x[0], y[0] + (v - x[0]) * left, inner)
        return np.where(v > x[-1], y[-1] + (v - x[-1]) * right, inner)

    def __call__(self, state):
        return self._extend(np.asarray(state, float), self.x, self.y, self.left, self.right)

    def inverse(self, image):
        """A state with this image; beyond a flat end, one that no state reaches."""
        with np.errstate(divide="ignore", over="ignore"):
            left, right = (min(1.0 / np.float64(s), FAR) for s in (self.left, self.right))
            return np.clip(self._extend(np.asarray(image, float), self.y, self.x, left, right), -FAR, FAR)

    def after(self, first: Pieces) -> Pieces:
        x = np.concatenate([first.x, first.inverse(self.x)])
        y = np.concatenate([self(first.y), self.y])
        order = np.lexsort((y, x))
        return Pieces(x[order], np.maximum.accumulate(y[order]), first.left * self.left, first.right * self.right)

    def within(self, low: float, high: float) -> Pieces:
        """The same map for states from ``low`` to ``high``, with no break points that make no difference there."""
        if np.isinf(low) or np.isinf(high):
            return self
        inner = (self.x > low) & (self.x < high)
        edge = self([low, high])
        x, y = np.concatenate([[low], self.x[inner], [high]]), np.concatenate([edge[:1], self.y[inner], edge[1:]])
        needed = np.ones(len(x), bool)
        needed[1:-1] = (y[1:-1] != y[:-2]) | (y[1:-1] != y[2:])
        return Pieces(x[needed], y[needed], self.left, self.right)

    def flat(self) -> np.ndarray:
        return np.concatenate([[len(self.x), self.left, self.right], self.x, self.y])

    @staticmethod
    def read(flat: np.ndarray) -> tuple[Pieces, np.ndarray]:
        """A map and what follows it."""
        flat = np.asarray(flat, float)
        n = int(flat[0])
        return Pieces(flat[3: 3 + n], flat[3 + n: 3 + 2 * n], float(flat[1]), float(flat[2])), flat[3 + 2 * n:]


def break_points(t: np.ndarray, falling: float, rising: float) -> tuple[np.ndarray, np.ndarray]:
    """Break points and their images of the maps of rows of targets.

    Step k bends where its state equals its target: that state is taken back to the start and on to the end, for
    all steps and rows together.
    """
    n = t.shape[1]
    t = np.ascontiguousarray(t.T)  # a step of all rows lies together
    x, y = np.empty_like(t), np.empty_like(t)
    for k in range(n):
        target, past = t[k], y[:k]
        keep = np.where(target < past, falling, rising)
        y[:k] = keep * past + (1.0 - keep) * target
        y[k] = target
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for k in range(n - 1, -1, -1):
            target = t[k]
            gap = x[k + 1 :] - target
            back = np.where(gap == 0, 0.0, gap / np.where(gap > 0, falling, rising))
            x[k + 1 :] = np.clip(target + back, -FAR, FAR)
            x[k] = target
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    order = np.argsort(x, axis=1, kind="stable")
    return np.take_along_axis(x, order, 1), np.maximum.accumulate(np.take_along_axis(y, order, 1), axis=1)


def follower_maps(t: np.ndarray, falling: float, rising: float, low: np.ndarray, high: np.ndarray) -> list[Pieces]:
    """The state maps of rows of targets, for states from ``low`` to ``high`` of each row; their stretches are bent together."""
    rows, n = t.shape
    many = n // STRIDE
    maps: list[list[Pieces]] = [[] for _ in range(rows)]
    for parts, each in ((t[:, : many * STRIDE].reshape(-1, STRIDE), many), (t[:, many * STRIDE :], 1)):
        size = parts.shape[1]
        for a in range(0, len(parts) if size else 0, 4096):
            for i, (x, y) in enumerate(zip(*break_points(parts[a : a + 4096], falling, rising)), a):
                row = i // each
                maps[row].append(Pieces(x, y, rising**size, falling**size).within(low[row], high[row]))
    for row, own in enumerate(maps):
        while len(own) > 1:
            pairs = [b.after(a).within(low[row], high[row]) for a, b in zip(own[::2], own[1::2])]
            own = pairs + own[len(pairs) * 2 :]
        maps[row] = own
    return [own[0] for own in maps]


def follower_map(t: np.ndarray, falling: float, rising: float, low: float = -np.inf, high: float = np.inf) -> Pieces:
    """The state map of a stretch of targets, for states from ``low`` to ``high``."""
    return follower_maps(t.reshape(1, -1), falling, rising, np.array([low]), np.array([high]))[0]


def follow(t: np.ndarray, start: np.ndarray, falling: float, rising: float) -> np.ndarray:
    """``run_follower`` over a few long rows: the states at every ``STRIDE`` frames first, then all stretches side by side."""
    rows, n = t.shape
    many = n // STRIDE
    if many < 2 or rows >= 8:  # many rows already lie side by side
        return run_follower(t, start, falling, rising)
    parts = t[:, : many * STRIDE].reshape(rows, many, STRIDE)
    begin = np.empty((rows, many))
    begin[:, 0] = start
    ends = rising**STRIDE, falling**STRIDE
    x, y = (v.reshape(rows, many - 1, STRIDE) for v in break_points(parts[:, :-1].reshape(-1, STRIDE), falling, rising))
    for row in range(rows):
        for k in range(many - 1):
            begin[row, k + 1] = Pieces(x[row, k], y[row, k], *ends)(begin[row, k])
    out = np.empty_like(t)
    out[:, : many * STRIDE] = run_follower(parts.reshape(-1, STRIDE), begin.ravel(), falling, rising).reshape(rows, -1)
    if n > many * STRIDE:
        out[:, many * STRIDE :] = run_follower(t[:, many * STRIDE :], out[:, many * STRIDE - 1], falling, rising)
    return out


def run_limiter(t: np.ndarray, start: np.ndarray, release: float):
    """``g = min(t, release*g + (1-release)*t)`` over rows of targets."""
    steps, g = np.ascontiguousarray(t.T), start.copy()
    out = np.empty_like(steps)
    for k, target in enumerate(steps):
        g = np.minimum(target, release * g + (1.0 - release) * target)
        out[k] = g
    return np.ascontiguousarray(out.T)


def limiter_map(t: np.ndarray, release: float):
    """(cap, slope, intercept) of each row's block map ``g -> min(cap, slope*g + intercept)``."""
    cap, icpt = np.full(len(t), np.inf), np.zeros(len(t))
    for target in np.ascontiguousarray(t.T):
        push = (1.0 - release) * target
        cap = np.minimum(target, release * cap + push)
        icpt = release * icpt + push
    return cap, np.full(len(t), release ** t.shape[1]), icpt


def limit(t: np.ndarray, start: np.ndarray, release: float) -> np.ndarray:
    """``run_limiter`` over a few long rows: the states at every ``STRIDE`` frames first, then all stretches side by side."""
    rows, n = t.shape
    many = n // STRIDE
    if many < 2 or rows >= 8:
        return run_limiter(t, start, release)
    parts = t[:, : many * STRIDE].reshape(-1, STRIDE)
    begin = np.empty((rows, many + 1))
    begin[:, 0] = start
    for row, maps in enumerate(np.stack(limiter_map(parts, release), axis=1).reshape(rows, many, 3).tolist()):
        state = begin[row, 0]
        for k, (cap, slope, icpt) in enumerate(maps, 1):
            begin[row, k] = state = np.minimum(cap, slope * state + icpt)
    out = np.empty_like(t)
    out[:, : many * STRIDE] = run_limiter(parts, begin[:, :-1].ravel(), release).reshape(rows, -1)
    if n > many * STRIDE:
        out[:, many * STRIDE :] = run_limiter(t[:, many * STRIDE :], begin[:, -1], release)
    return out


# --- the scan on Spark -----------------------------------------------------------------------


def _scan(blocks: DataFrame, keys: Sequence[str], block: int, inputs: list[str], outputs: list[str],
          summarize, compose, step, apply, hull: Sequence[Column] = (), out_type: T.DataType = DOUBLES) -> DataFrame:
    """``summarize(inputs) -> arrays`` of full blocks, ``compose(first, second) -> summary``, ``step(state or None, summary) ->
    state``, ``apply(states, inputs) -> outputs``; states travel as flat double arrays. ``summarize`` also gets the least and
    greatest value over the whole series of each array in ``hull``. The first input tells the length of a block.

    A task gives its outputs back in slices, so what it holds does not grow with the rows of a batch or the number of outputs."""
    keys = list(keys)

    @F.pandas_udf(DOUBLES)
    def summary(*cols: pd.Series) -> pd.Series:
        return pd.Series(summarize(list(cols)))

    full = blocks.filter(F.size(inputs[0]) == block)
    edges = [f"_{side}{i}" for i in range(len(hull)) for side in ("least", "most")]
    if hull:
        of = [f(g(c)) for c in hull for f, g in ((F.min, F.array_min), (F.max, F.array_max))]
        full = _same_join(full, blocks.groupBy(*keys).agg(*[e.alias(n) for n, e in zip(edges, of)]), keys, "inner")
    full = full.select(*keys, "block_ix", F.floor(F.col("block_ix") / GROUP).cast("bigint").alias("_group"),
                       summary(*[F.col(c) for c in [*inputs, *edges]]).alias("_summary"))
    key_fields = [blocks.schema[k] for k in keys]

    def schema(*rest):
        return T.StructType([*key_fields, *rest])

    group_field, state_field = T.StructField("_group", T.LongType()), T.StructField("_state", DOUBLES)
    block_field, summary_field = T.StructField("block_ix", T.LongType()), T.StructField("_summary", DOUBLES)

    def along(name: str, first, following, by: list[str], columns: list[str]):
        """Rows in order: their summaries are turned into running values, which start anew with every value of ``by``."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, value = None, None
            for pdf in batches:
                values = []
                for key, item in zip(zip(*[pdf[k].astype(object).where(pdf[k].notna(), None) for k in by]), pdf["_summary"]):
                    value = following(value, item) if key == current else first(item)
                    current = key
                    values.append(value)
                yield pdf[columns].assign(**{name: pd.Series(values, index=pdf.index, dtype=object)})
        return run

    prefixes = full.repartition(*keys, "_group").sortWithinPartitions(*keys, "_group", "block_ix").mapInPandas(
        along("_summary", lambda item: item, compose, [*keys, "_group"], [*keys, "_group", "block_ix"]),
        schema(group_field, block_field, summary_field))
    groups = prefixes.filter(F.pmod("block_ix", F.lit(GROUP)) == GROUP - 1).select(*keys, "_group", "_summary").repartition(*keys)
    groups = groups.sortWithinPartitions(*keys, "_group").mapInPandas(
        along("_state", lambda item: step(None, item), step, keys, [*keys, "_group"]), schema(group_field, state_field))
    states = _same_join(prefixes, groups.withColumn("_group", F.col("_group") + 1), [*keys, "_group"], "left").select(
        *keys, (F.col("block_ix") + 1).alias("block_ix"), "_summary", "_state")

    width = len(outputs) if out_type == DOUBLES else 4  # arrays of a row of results; a table has about so many

    @F.pandas_udf(T.StructType([T.StructField(o, out_type) for o in outputs]))
    def compute(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _slices(batch[2], width):
                state, before, *cols = (c.iloc[a:b].reset_index(drop=True) for c in batch)
                given = [None if item is None else step(None if s is None else np.asarray(s, float), item) for s, item in zip(state, before)]
                yield apply(pd.Series(given, dtype=object), cols)

    return (
        _same_join(blocks, states, [*keys, "block_ix"], "left")
        .withColumn("_y", compute(F.col("_state"), F.col("_summary"), *[F.col(c) for c in inputs]))
        .select(*blocks.columns, *[F.col(f"_y.{o}").alias(o) for o in outputs])
    )


def linear_scan(blocks: DataFrame, keys: Sequence[str], filters: dict[str, tuple[str, System]],
                block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add one filtered column per entry ``output -> (input column, system)``, all in one scan."""
    names = list(filters)
    inputs = sorted({c for c, _ in filters.values()})
    plan = [(inputs.index(filters[n][0]), filters[n][1]) for n in names]
    by_input = [(ci, [k for k, p in enumerate(plan) if p[0] == ci]) for ci in range(len(inputs))]
    edges = np.cumsum([0] + [s.order for _, s in plan])
    over: dict[int, list[np.ndarray]] = {}

    def summarize(cols):
        ends = np.zeros((len(cols[0]), 1 + edges[-1]))
        ends[:, 0] = 1.0  # blocks
        for ci, own in by_input:
            for rows, _, x in _stacked(cols[ci]):
                for k in own:
                    sys = plan[k][1]
                    ends[rows, 1 + edges[k] : 1 + edges[k + 1]] = run_linear(sys, x, np.zeros((len(x), sys.order)))[1]
        return list(ends)

    def step(state, item):
        if state is None:
            return np.asarray(item[1:], float)
        count = int(item[0])
        if count not in over:
            over[count] = [np.linalg.matrix_power(s.a, block * count) for _, s in plan]
        return np.concatenate([m @ state[edges[k] : edges[k + 1]] for k, m in enumerate(over[count])]) + item[1:]

    def compose(first, second):
        return np.concatenate([[first[0] + second[0]], step(np.asarray(first[1:], float), second)])

    def apply(state, cols):
        start = np.stack([np.zeros(edges[-1]) if s is None else np.asarray(s, float) for s in state])
        res: list[list] = [[None] * len(state) for _ in plan]
        for ci, own in by_input:
            for rows, lengths, x in _stacked(cols[ci]):
                for k in own:
                    y = run_linear(plan[k][1], x, start[rows, edges[k] : edges[k + 1]])[0]
                    for i, (row, n) in enumerate(zip(rows, lengths)):
                        res[k][row] = y[i, :n]
        return pd.DataFrame({name: pd.Series(col, dtype=object) for name, col in zip(names, res)})

    return _scan(blocks, keys, block, inputs, names, summarize, compose, step, apply)


def follower_scan(blocks: DataFrame, keys: Sequence[str], followers: dict[str, tuple[str, float, float]],
                  start: float = 0.0, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add one followed column per ``output -> (target column, falling, rising)``, from the state ``start``.

    A state lies between the least and the greatest target of its series and the start, so maps are kept for that range only.
    """
    names = list(followers)
    inputs = sorted({v[0] for v in followers.values()})
    plan = [(inputs.index(followers[n][0]), followers[n][1], followers[n][2]) for n in names]

    def summarize(cols):
        out: list[list] = [[] for _ in range(len(cols[0]))]
        for ci, falling, rising in plan:
            low, high = (cols[len(inputs) + 2 * ci + side].to_numpy(float) for side in (0, 1))
            for rows, _, t in _stacked(cols[ci]):
                for row, own in zip(rows, follower_maps(t, falling, rising, np.minimum(low[rows], start), np.maximum(high[rows], start))):
                    out[row].append(own.flat())
        return [np.concatenate(maps) for maps in out]

    def each(flat):
        maps = []
        while len(flat):
            own, flat = Pieces.read(flat)
            maps.append(own)
        return maps

    def compose(first, second):
        return np.concatenate([b.after(a).within(a.x[0], a.x[-1]).flat() for a, b in zip(each(first), each(second))])

    def step(state, flat):
        return np.array([float(m(start if state is None else state[k])) for k, m in enumerate(each(flat))])

    def apply(state, cols):
        begin = np.stack([np.full(len(plan), start) if s is None else np.asarray(s, float) for s in state])
        res = {}
        for k, (ci, falling, rising) in enumerate(plan):
            col = [None] * len(state)
            for rows, lengths, t in _stacked(cols[ci]):
                y = follow(t, begin[rows, k], falling, rising)
                for i, (row, n) in enumerate(zip(rows, lengths)):
                    col[row] = y[i, :n]
            res[names[k]] = pd.Series(col, dtype=object)
        return pd.DataFrame(res)

    return _scan(blocks, keys, block, inputs, names, summarize, compose, step, apply, [F.col(c) for c in inputs])


def limiter_scan(blocks: DataFrame, keys: Sequence[str], target: str, out: str, release: float,
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add the limiter gain for a column of target gains (start gain 1)."""

    def summarize(cols):
        res = np.zeros((len(cols[0]), 3))
        for rows, _, t in _stacked(cols[0]):
            res[rows] = np.stack(limiter_map(t, release), axis=1)
        return list(res)

    def compose(first, second):
        (c1, s1, i1), (c2, s2, i2) = first, second
        return np.array([min(c2, s2 * c1 + i2), s2 * s1, s2 * i1 + i2])

    def step(state, item):
        cap, slope, icpt = item
        return np.array([min(cap, slope * (1.0 if state is None else state[0]) + icpt)])

    def apply(state, cols):
        begin = np.array([1.0 if s is None else float(s[0]) for s in state])
        col = [None] * len(state)
        for rows, lengths, t in _stacked(cols[0]):
            y = run_limiter(t, begin[rows], release)
            for i, (row, n) in enumerate(zip(rows, lengths)):
                col[row] = y[i, :n]
        return pd.DataFrame({out: pd.Series(col, dtype=object)})

    return _scan(blocks, keys, block, [target], [out], summarize, compose, step, apply)


def refractory_scan(blocks: DataFrame, keys: Sequence[str], flag: str, out: str, skip: int,
                    block: int = DEFAULT_BLOCK) -> DataFrame:
    """Mark flags that are not within ``skip`` positions of the last marked one.

    The state is the number of positions still blocked, so a block's summary is a table of ``skip + 1`` results.
    """

    def walk(hits: np.ndarray, blocked: int, n: int):
        marks, at = [], blocked
        for h in hits:
            if h >= at:
                marks.append(h)
                at = h + skip + 1
        return marks, max(0, at - n)

    def summarize(cols):
        out_rows = []
        for flags in cols[0]:
            hits = np.flatnonzero(np.asarray(flags) > 0)
            # all starts before the first hit act alike
            ends, first = {}, (hits[0] if len(hits) else len(flags))
            table = []
            for d in range(skip + 1):
                key = 0 if d <= first else d
                if key not in ends:
                    ends[key] = walk(hits, key, len(flags))[1]
                table.append(float(ends[key] if len(hits) else max(0, d - len(flags))))
            out_rows.append(np.array(table))
        return out_rows

    def compose(first, second):
        return np.asarray(second)[np.asarray(first).astype(int)]

    def step(state, table):
        return np.array([table[0 if state is None else int(state[0])]])

    def apply(state, cols):
        col = []
        for s, flags in zip(state, cols[0]):
            marks, _ = walk(np.flatnonzero(np.asarray(flags) > 0), 0 if s is None else int(s[0]), len(flags))
            y = np.zeros(len(flags))
            y[marks] = 1.0
            col.append(y)
        return pd.DataFrame({out: pd.Series(col, dtype=object)})

    return _scan(blocks, keys, block, [flag], [out], summarize, compose, step, apply)
