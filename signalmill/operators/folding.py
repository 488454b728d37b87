"""A user's own aggregate in two phases: rows are folded into small states where they lie, states are merged in a tree.

The state is a flat array of doubles, so it travels as a column. The same fold runs over a table and over a stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = T.StructField("_state", T.ArrayType(T.DoubleType()))


class Fold:
    """What to do with rows and states. ``update`` gets a pandas frame of some rows of one key, in no order."""

    #: columns of the result, in SQL: ``"mean double, n bigint"``
    schema: str

    def start(self) -> np.ndarray:
        raise NotImplementedError

    def update(self, state: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        raise NotImplementedError

    def update_many(self, states: list[np.ndarray], group: np.ndarray, rows: pd.DataFrame) -> list[np.ndarray]:
        """``update`` for rows of several keys: row i belongs to ``states[group[i]]``. A fold may take them all at once."""
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(states)))
        rows = rows.take(order)
        return [self.update(s, rows.iloc[a:b]) for s, a, b in zip(states, [0, *ends[:-1]], ends)]

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def finish(self, state: np.ndarray) -> tuple:
        raise NotImplementedError


def _keyed(df: DataFrame, keys: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *more])


def _frame(keys: Sequence[str], found: list, columns: Sequence[str]) -> pd.DataFrame:
    """Rows of ``(key, values)``; a key may have more parts than there are key columns."""
    out = {k: pd.Series([key[i] for key, _ in found], dtype=object) for i, k in enumerate(keys)}
    return pd.DataFrame(out | {c: pd.Series([v[i] for _, v in found], dtype=object) for i, c in enumerate(columns)})


def _keys(pdf: pd.DataFrame, by: Sequence[str]):
    """The key of each row as a tuple, with None for what is missing."""
    return zip(*[pdf[k].astype(object).where(pdf[k].notna(), None) for k in by])


def partial_states(df: DataFrame, keys: Sequence[str], fold: Fold, most: int = 10_000) -> DataFrame:
    """``keys, _state``: one row per key and task (or per ``most`` keys met in a task)."""
    keys = list(keys)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            group = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            met = list(_keys(pdf.iloc[np.unique(group, return_index=True)[1]], keys))
            found = fold.update_many([states[k] if k in states else fold.start() for k in met], group, pdf)
            states.update(zip(met, found))
            if len(states) >= most:
                yield _frame(keys, [(k, (s,)) for k, s in states.items()], ["_state"])
                states = {}
        if states:
            yield _frame(keys, [(k, (s,)) for k, s in states.items()], ["_state"])

    return df.mapInPandas(gather, _keyed(df, keys, STATE))


def fold_rows(df: DataFrame, keys: Sequence[str], fold: Fold, fan: int = 32) -> DataFrame:
    """``keys`` and the fold's columns, one row per key; rows without a key are a key of their own.

    A key's partial states are merged ``fan`` ways side by side before the last merge, so a key that all tasks hold
    does not meet in one task at once.
    """
    keys = list(keys)
    partial = partial_states(df, keys, fold).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(fan)))

    result = T.StructType.fromDDL(fold.schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(fold.schema)

    def merged(states: DataFrame, by: list[str], fields: list[T.StructField], values) -> DataFrame:
        """One row of ``values(state)`` for each value of ``by``: its states lie together, and many keys share a batch."""
        columns = [f.name for f in fields]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state, done = None, None, []
            for pdf in batches:
                for key, item in zip(_keys(pdf, by), pdf["_state"]):
                    item = np.asarray(item, float)
                    if state is not None and key == now:
                        state = fold.merge(state, item)
                        continue
                    if state is not None:
                        done.append((now, values(state)))
                    now, state = key, item
                if done:
                    yield _frame(keys, done, columns)
                    done = []
            if state is not None:
                yield _frame(keys, [(now, values(state))], columns)

        return states.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, _keyed(df, keys, *fields))

    some = merged(partial, [*keys, "_part"], [STATE], lambda state: (state,))
    return merged(some, keys, result.fields, fold.finish)


def fold_stream(stream: DataFrame, keys: Sequence[str], fold: Fold) -> DataFrame:
    """The same over a stream, in update mode: a micro-batch's partial states are merged into each key's state."""
    keys = list(keys)
    result = T.StructType.fromDDL(fold.schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(fold.schema)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.asarray(state.get[0], float) if state.exists else None
        for pdf in batches:
            for item in pdf["_state"]:
                item = np.asarray(item, float)
                held = item if held is None else fold.merge(held, item)
        state.update((held.tolist(),))
        yield pd.DataFrame([(*key, *fold.finish(held))], columns=[*keys, *[f.name for f in result.fields]])

    return partial_states(stream, keys, fold).groupBy(*keys).applyInPandasWithState(
        step, _keyed(stream, keys, *result.fields), "s array<double>", "update", GroupStateTimeout.NoTimeout)


class GatedLoudness(Fold):
    """Mean level of the energies ``e`` above a gate, in LUFS; with ``relative`` the gate lies that far below ``floor``."""

    schema = "lufs double, points bigint"

    def __init__(self, gate: float = -70.0, relative: float | None = None):
        self.gate, self.relative = gate, relative

    def start(self) -> np.ndarray:
        return np.zeros(2)

    def _kept(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        e = rows["e"].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            level = -0.691 + 10.0 * np.log10(e)
        kept = level >= self.gate
        if self.relative is not None:
            kept &= level >= rows["floor"].to_numpy(float) + self.relative
        return e, kept

    def update(self, state: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        e, kept = self._kept(rows)
        return state + np.array([e[kept].sum(), kept.sum()])

    def update_many(self, states: list[np.ndarray], group: np.ndarray, rows: pd.DataFrame) -> list[np.ndarray]:
        e, kept = self._kept(rows)
        more = [np.bincount(group[kept], weights=w, minlength=len(states)) for w in (e[kept], None)]
        return list(np.stack(states) + np.stack(more, axis=1))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, state: np.ndarray) -> tuple:
        total, n = state
        return (float(-0.691 + 10.0 * np.log10(total / n)) if n else None), int(n)
