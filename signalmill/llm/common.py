"""Shared by the operators: reading rows, text buffers in tasks, rolling hashes, packed shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import position
from ..session import cut_lineage

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of text that a task hashes at once
SLICE = 1 << 20
#: bytes of a slice whose words are hashed at once: eight numbers are held for each byte
PIECE = 1 << 17
#: bytes of rows that go to Python at once, and as many as a session gets that names no number itself
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: bits of a place inside a text; above them lies the number of the text among those that share an id
PLACE = 31


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` (null: the smallest long) and ``text`` (null: empty), whatever else the table has."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """Rows of ``id_and_text`` with ``part``: the number of a row's text among the different texts of its id.

    It is 0 for every id with one text, however often the row is repeated; only other ids are looked up.
    """
    docs = docs.withColumn("digest", F.md5(F.col("text").cast("binary")))
    several = docs.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    texts = cut_lineage(docs.join(cut_lineage(several), "doc_id", "left_semi").select("doc_id", "digest").distinct())
    parts = cut_lineage(position(texts, ["doc_id"], [F.substring("digest", 1, 2)], [F.col("digest")], "part"))
    return docs.join(parts, ["doc_id", "digest"], "left").select("doc_id", "text", F.coalesce("part", F.lit(0).cast("long")).alias("part"))


def given_id(name: str = "doc_id"):
    """The id as it was given: the smallest long stands for null inside the jobs."""
    return F.when(F.col(name) != F.lit(-(1 << 63)).cast("long"), F.col(name)).alias(name)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python ``BATCH_BYTES`` at a time (a longer row alone), unless it sets a number itself.

    A batch lies in memory several times, in the executor and in its worker, and by rows alone it may be of any size. Plans
    are made when rows are asked for, so the setting stays.
    """
    if spark.conf.get(BYTES, None) is None:
        spark.conf.set(BYTES, str(BATCH_BYTES))


def partitions(df: DataFrame) -> int:
    """Parts of a packed shuffle: what the session sets for shuffles, which a cluster sets by the size of its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Prefix polynomial hashes modulo 2^64: ``span(i, j)`` hashes the values of a range, wherever it lies."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, values: np.ndarray) -> Rolling:
        n = len(values)
        if len(self.up) <= n:
            room = max(n, 2 * len(self.up))
            self.up, self.down = powers(room), powers(room, INVERSE)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=self.prefix[1:])
        return self

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.prefix[stop] - self.prefix[start]) * self.down[start]


def byte_values() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 7)


def slices(batch: pa.RecordBatch, limit: int = SLICE):
    """Slices of a batch as ``first row, end, data, bounds``: their texts lie one after the other in ``data``, with no copy made.

    A slice has at most ``limit`` bytes, or one longer text."""
    if not batch.num_rows:
        return
    text = batch.column(1)
    large = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[text.offset: text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, "right")) - 1)
        b = min(b, len(text))
        yield a, b, data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a]
        a = b


def buffers(batch: pa.RecordBatch, limit: int = SLICE):
    """Slices of a batch with their ids: ``ids, data, bounds``."""
    for a, b, data, bounds in slices(batch, limit):
        yield batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False), data, bounds


def numbered_buffers(batch: pa.RecordBatch):
    """Slices of rows of ``numbered``: ``ids, first places, data, bounds``; places of an id's further texts begin higher up."""
    for a, b, data, bounds in slices(batch):
        ids, parts = (batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in (0, 2))
        yield ids, parts << PLACE, data, bounds


def word_hashes(data: np.ndarray, bounds: np.ndarray, values: np.ndarray):
    """A hash of every word (bytes between ASCII white space) and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    full = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    first = full.copy()
    first[1:] &= ~full[:-1] | cut[1:-1]
    last = full.copy()
    last[:-1] &= ~full[1:] | cut[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    # each byte counts by a hash of its place in the word, so no pattern of bytes cancels out; in pieces that end between words
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + PIECE)))
        lo, hi = start[a], stop[b - 1]
        longest = int((stop[a:b] - start[a:b]).max())
        weight = mix(np.arange(longest, dtype=np.uint64), 67) | np.uint64(1)
        gap = np.diff(start[a:b], append=hi)
        place = np.minimum(np.arange(hi - lo) - np.repeat(start[a:b] - lo, gap), longest - 1)
        terms = values[data[lo:hi]] * weight[place]
        terms[~full[lo:hi]] = 0
        out[a:b] = np.add.reduceat(terms, start[a:b] - lo) + (stop[a:b] - start[a:b]).astype(np.uint64)
        a = b
    return mix(out), np.searchsorted(start, bounds)


def release() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system, where its C library can do that."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed value."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(
        head.tobytes() + b"".join(np.ascontiguousarray(a, np.int64).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
    n = int(raw[0])
    ends = np.cumsum(raw[1: n + 1]) + n + 1
    return np.split(raw[n + 1:], ends[:-1] - n - 1)


def record(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


def ranges_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def grouped(order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order and the starts of its runs of equal keys."""
    order = np.argsort(order_key, kind="stable")
    ordered = order_key[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order, starts


BLOCKED = {"block": pa.int32(), "found": pa.binary()}


def block_rows(doc: np.ndarray, blocks: int, *columns: np.ndarray, extra: dict | None = None):
    """Findings on many documents as one row for each block of documents: a bucket's result has few rows, however many
    documents it touches. The first of ``columns`` are places. ``extra``: further columns, with one value for all rows."""
    if not len(doc):
        return
    text = mix((columns[0] >> PLACE).view(np.uint64), 61)  # texts that share an id go to different blocks
    block = (mix(doc.view(np.uint64) ^ text, 59) % np.uint64(blocks)).astype(np.int64)
    order = np.lexsort((*columns[::-1], doc, block))
    block, doc, columns = block[order], doc[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = np.append(cuts[1:], len(block))
    blobs = [pack(np.diff(doc[a:b], prepend=0), np.diff(columns[0][a:b], prepend=0), *(c[a:b] for c in columns[1:]))
             for a, b in zip(cuts, ends, strict=True)]
    more = {k: [v] * len(cuts) for k, v in (extra or {}).items()}
    schema = BLOCKED | {k: pa.int32() for k in more}
    yield record(schema, block=block[cuts], found=blobs, **more)


def block_columns(batches) -> list[np.ndarray]:
    """All findings of a block: documents and columns, ordered by document, then by the columns."""
    parts = []
    for batch in batches:
        for blob in batch.column("found").to_pylist():
            doc, first, *rest = unpack(blob)
            parts.append((np.cumsum(doc), np.cumsum(first), *rest))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((*columns[:0:-1], columns[0]))
    return [c[order] for c in columns]


def document_slices(doc: np.ndarray, place: np.ndarray):
    """Ids, numbers of their texts and ranges of rows of each text in ordered columns."""
    part = place >> PLACE
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[at], part[at], list(zip(at.tolist(), [*at[1:].tolist(), len(doc)], strict=True))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of ranges."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    at = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    return start[at], stop[np.append(at[1:], len(start)) - 1]


def document_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a block with findings ``place, length``: one row per text with its maximal runs, packed."""
    doc, place, length = block_columns(batches)
    ids, parts, rows = document_slices(doc, place)
    start = place & ((1 << PLACE) - 1)
    blobs = [pack(*merged(start[a:b], start[a:b] + length[a:b])) for a, b in rows]
    schema = {"doc_id": pa.int64(), "part": pa.int64(), "ranges": pa.binary()}
    for lo in range(0, len(ids), 10_000):
        hi = lo + 10_000
        yield record(schema, doc_id=ids[lo:hi], part=parts[lo:hi], ranges=blobs[lo:hi])
