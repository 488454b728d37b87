"""Carried state across blocks of a series: counters, bins, filters, running preferences, incremental work."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.filters import System
from ..operators.collections import PREFERENCE_FIELDS
from ..operators.integrity import integrity_metrics
from ..operators.scans import from_blocks, run_linear
from ..operators.stereo import stereo_sums
from ..sources.identity import run_incremental


def distinct_blocks(stream: DataFrame) -> DataFrame:
    """Replayed blocks count once."""
    return stream.dropDuplicates(["track_id", "block_ix"])


def stream_integrity(blocks: DataFrame, rate: float, block: int) -> DataFrame:
    """Damage counters that need no order: the batch aggregation on a stream, kept as partial sums in state."""
    return integrity_metrics(from_blocks(distinct_blocks(blocks), ["track_id"], "frame_ix", ["l", "r"], block), rate)


def stream_stereo(blocks: DataFrame, block: int) -> DataFrame:
    return stereo_sums(from_blocks(distinct_blocks(blocks), ["track_id"], "frame_ix", ["l", "r"], block))


def stream_waveform(blocks: DataFrame, block: int, base: int) -> DataFrame:
    """Finest waveform bins; coarser levels are rolled up from the stored bins."""
    f = from_blocks(distinct_blocks(blocks), ["track_id"], "frame_ix", ["l", "r"], block)
    x = F.col("l")
    return f.groupBy("track_id", F.floor(F.col("frame_ix") / F.lit(base)).cast("bigint").alias("bin_ix")).agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.sqrt(F.avg(x * x)).alias("rms"), F.count(x).alias("frames"))


class OrderedFilter(StatefulProcessor):
    """Filters the blocks of a series in order. State: the block expected next with the filters' memories, and one map entry
    per block that came before its turn; a finished series keeps a mark against late repeats for ``keep_ms``."""

    def __init__(self, system: System, columns: Sequence[str], keep_ms: int | None):
        self.system, self.columns, self.keep_ms = system, list(columns), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        arrays = ", ".join(f"{c} array<double>" for c in self.columns)
        self.ended = handle.getValueState("ended", "at bigint", self.keep_ms)
        self.next = handle.getValueState("next", f"expect bigint, {arrays}")
        self.early = handle.getMapState("early", "block_ix bigint", f"{arrays}, is_last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            for _ in rows:
                pass
            return
        if self.next.exists():
            expect, *memory = self.next.get()
        else:
            expect, memory = 0, [[0.0] * self.system.order for _ in self.columns]
        for pdf in rows:
            out, last = [], False
            for ix, is_last, *arrays in pdf[["block_ix", "is_last", *self.columns]].itertuples(index=False, name=None):
                if int(ix) > expect:
                    self.early.updateValue((int(ix),), (*[[float(v) for v in x] for x in arrays], bool(is_last)))
                    continue
                while int(ix) == expect:
                    y, memory = self._through(arrays, memory)
                    out.append((key[0], expect, *y, bool(is_last)))
                    last, expect = bool(is_last), expect + 1
                    if last or not self.early.containsKey((expect,)):
                        break
                    *arrays, is_last = self.early.getValue((expect,))
                    self.early.removeKey((expect,))
                    ix = expect
                if last:
                    break
            if out:
                yield pd.DataFrame(out, columns=["track_id", "block_ix", *self.columns, "is_last"])
            if last:
                self.next.clear()
                self.early.clear()
                self.ended.update((expect,))
                for _ in rows:
                    pass
                return
        self.next.update((expect, *memory))

    def _through(self, arrays, memory):
        x = np.stack([np.asarray(a, float) for a in arrays])
        y, end = run_linear(self.system, x, np.asarray(memory, float))
        return y.tolist(), end.tolist()

    def close(self) -> None:
        pass


def stream_filter(blocks: DataFrame, system: System, columns: Sequence[str] = ("l", "r"), keep_ms: int | None = None) -> DataFrame:
    """A linear filter over blocks that arrive in any order, some more than once, in any micro-batches, on every channel.

    Output is appended in block order and does not depend on how the input was cut into micro-batches. A block with
    ``is_last`` ends the series and frees its state; a mark that it has ended stays for good, or for ``keep_ms`` in a stream
    that never ends (Spark runs batches without data for such times), and late repeats are dropped until then. Blocks that wait for an earlier one lie in a map state, one entry each, so a batch reads and
    writes only those it needs. The state store must be RocksDB (``run_available(..., rocksdb=True)``).
    """
    arrays = ", ".join(f"{c} array<double>" for c in columns)
    kind = blocks.schema["track_id"].dataType.simpleString()
    return blocks.select("track_id", "block_ix", *columns, "is_last").groupBy("track_id").transformWithStateInPandas(
        OrderedFilter(system, columns, keep_ms), f"track_id {kind}, block_ix bigint, {arrays}, is_last boolean", "Append",
        "None" if keep_ms is None else "ProcessingTime")


def stream_preferences(events: DataFrame, growth: float = 1.02) -> DataFrame:
    """Running recency-weighted sums per profile in arrival order (by ``seq`` inside a micro-batch).

    Sums are kept relative to the newest event (everything older shrinks by ``1/growth`` per event), so a long-lived
    profile never overflows; only ratios of the sums are used.
    """
    names = [f"delta_{f}" for f in PREFERENCE_FIELDS]
    columns = ["profile_name", "event_count", "total_weight", *[f"sum_{f}" for f in PREFERENCE_FIELDS]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, weight, sums = (0, 0.0, np.zeros(len(names))) if not state.exists else (
            state.get[0], state.get[1], np.asarray(state.get[2], float))
        rows = pd.concat(list(batches)).sort_values("seq")
        n = len(rows)
        w = growth ** -np.arange(n - 1, -1, -1, dtype=float)
        shrink = growth ** -float(n)
        sums = sums * shrink + w @ rows[names].to_numpy(float)
        weight, count = weight * shrink + w.sum(), count + n
        state.update((count, weight, sums.tolist()))
        yield pd.DataFrame([(key[0], count, weight, *sums)], columns=columns)

    schema = ", ".join(f"{c} {'string' if c == 'profile_name' else 'bigint' if c == 'event_count' else 'double'}" for c in columns)
    return events.groupBy("profile_name").applyInPandasWithState(
        step, schema, "n bigint, weight double, sums array<double>", "update", GroupStateTimeout.NoTimeout)


def isolate_failures(df: DataFrame, fn: Callable[[pd.Series], object], column: str, out: str, out_type: str = "double") -> DataFrame:
    """Apply ``fn`` to each value; a failing row gets ``status`` failed and the message and does not stop the rest."""
    schema = f"{out} {out_type}, status string, error string"

    @F.pandas_udf(f"struct<{schema.replace(' ', ':', 1).replace(', status ', ',status:').replace(', error ', ',error:')}>")
    def guarded(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((fn(v), "complete", None))
            except Exception as e:  # noqa: BLE001 - the error is the row's result
                rows.append((None, "failed", str(e)))
        return pd.DataFrame(rows, columns=[out, "status", "error"])

    return df.withColumn("_r", guarded(F.col(column))).select(*df.columns, "_r.*")


def incremental_batches(store: str, process: Callable[[DataFrame], DataFrame]):
    """For ``foreachBatch``: process the batch's work that the store lacks and append it with its status.

    A replayed batch finds its keys complete and does nothing, so effects happen once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        run_incremental(batch, store, process)

    return handle
