"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, repeats merged into removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    Rolling,
    block_rows,
    byte_values,
    document_ranges,
    given_id,
    grouped,
    id_and_text,
    mix,
    numbered,
    numbered_buffers,
    pack,
    partitions,
    record,
    unpack,
    word_hashes,
)

PACKED = {"bucket": pa.int32(), "hashes": pa.binary(), "places": pa.binary(), "known": pa.binary()}
#: windows that a task combines before the shuffle
CHUNK = 1_000_000


def window_chunks(batches, size: int):
    """Hash pairs of all windows with document and first word, in chunks; a longer text is cut with an overlap."""
    words_rolling, values = Rolling(), byte_values()
    held, n = [], 0
    for batch in batches:
        for ids, base, data, bounds in numbered_buffers(batch):
            words, before = word_hashes(data, bounds, values)
            for lo in range(0, max(1, len(words)), CHUNK):
                hi = min(len(words), lo + CHUNK + size - 1)
                start = np.arange(lo, max(lo, min(lo + CHUNK, hi - size + 1)))
                doc = np.searchsorted(before, start, "right") - 1
                whole = start + size <= before[np.minimum(doc + 1, len(before) - 1)]
                start, doc = start[whole], doc[whole]
                if not len(start):
                    continue
                words_rolling.load(words[lo:hi])
                raw = words_rolling.span(start - lo, start - lo + size)
                held.append((mix(raw, 1), mix(raw + words[start], 2), ids[doc], base[doc] + start - before[doc]))
                n += len(start)
                if n >= CHUNK:
                    whole, held, n = [np.concatenate(x) for x in zip(*held, strict=True)], [], 0
                    yield whole  # its parts are not held beside it
                    del whole
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def later_in_group(order: np.ndarray, starts: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Of groups of equal windows: which rows start after their group's first, and one first row of each group."""
    first = np.zeros(len(order), bool)
    first[starts] = True
    size = np.diff(np.append(starts, len(order)))
    single = order[starts[size == 1]]
    many = np.repeat(size > 1, size)
    rows, group = order[many], np.repeat(np.arange(len(starts)), size)[many]
    by = np.lexsort((pos[rows], doc[rows], group))
    rows, group = rows[by], group[by]
    head = np.concatenate([[True], group[1:] != group[:-1]]) if len(rows) else np.zeros(0, bool)
    lead = rows[head][np.cumsum(head) - 1] if len(rows) else rows
    later = rows[(doc[rows] != doc[lead]) | (pos[rows] != pos[lead])]
    return later, np.concatenate([single, rows[head]])


def places(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, bytes]:
    """An order by document and position, and the places in it as small differences."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    step = np.diff(pos, prepend=0)
    step[at] = pos[at]
    return order, pack(np.diff(doc[at], prepend=0), np.diff(np.append(at, len(doc))), step)


def placed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, count, step = unpack(blob)
    if not len(step):
        return step, step
    total = np.cumsum(step)
    at = np.cumsum(count) - count
    return np.repeat(np.cumsum(ids), count), total - np.repeat(total[at] - step[at], count)


def packer(size: int, buckets: int):
    def run(batches):
        for h, spread, doc, pos in window_chunks(batches, size):
            later, kept = later_in_group(*grouped(h), doc, pos)
            bucket = (spread[kept] % np.uint64(buckets)).astype(np.int64)
            known = doc[later] % buckets
            by = np.argsort(bucket, kind="stable")
            kept, cuts = kept[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
            by = np.argsort(known, kind="stable")
            later, ends = later[by], np.searchsorted(known[by], np.arange(buckets + 1))
            for b in range(buckets):
                own, more = kept[cuts[b]: cuts[b + 1]], later[ends[b]: ends[b + 1]]
                if len(own) or len(more):
                    order, where = places(doc[own], pos[own])
                    yield record(PACKED, bucket=[b], hashes=[h[own][order].tobytes()], places=[where],
                                 known=[places(doc[more], pos[more])[1]])

    return run


def finder(size: int, blocks: int):
    def repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one bucket: all windows that start later than the first equal one."""
        parts, known = [], []
        for batch in batches:
            for h, where, more in zip(*(batch.column(k).to_pylist() for k in ("hashes", "places", "known")), strict=True):
                parts.append((np.frombuffer(h, np.uint64), *placed(where)))
                known.append(placed(more))
        h, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        later, _ = later_in_group(*grouped(h), doc, pos)
        doc = np.concatenate([doc[later], *(x[0] for x in known)])
        pos = np.concatenate([pos[later], *(x[1] for x in known)])
        yield from block_rows(doc, blocks, pos, np.full(len(pos), size))

    return repeated_windows


def substring_dedup(docs: DataFrame, size: int = 20) -> DataFrame:
    """Remove every word covered by a window of ``size`` words that also starts earlier.

    Returns ``doc_id, n_words, n_removed, kept`` (kept words joined by one space). Null texts are empty, a null id sorts
    before all others. Rows that repeat an id and its text are one document: equal (id, start) never removes itself. Different
    texts of one id are documents of their own, in the order of their digests. An empty table gives no rows. Every window is hashed: equal windows have equal 64-bit hashes and equal
    parts of a second hash, which deals them to buckets, so the check grows by a bit as the buckets double. A task sends
    one row of each distinct window, so that a passage held by many documents reaches its bucket once per task chunk.
    """
    docs = numbered(id_and_text(docs))
    buckets = partitions(docs)
    packed = docs.mapInArrow(packer(size, buckets), "bucket int, hashes binary, places binary, known binary")
    found = packed.groupBy("bucket").applyInArrow(finder(size, buckets), "block int, found binary")
    ranges = found.groupBy("block").applyInArrow(document_ranges, "doc_id long, part long, ranges binary")

    def cut(batches):
        schema = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
        for batch in batches:
            out = {k: [] for k in schema}
            for doc, text, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                kept = words
                if blob:
                    start, stop = unpack(blob)
                    stop = np.minimum(stop, len(words))
                    kept = [w for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(words)], strict=True) for w in words[a:b]]
                for k, v in zip(schema, (doc, len(words), len(words) - len(kept), b" ".join(kept).decode()), strict=True):
                    out[k].append(v)
            yield record(schema, **out)

    return docs.join(ranges, ["doc_id", "part"], "left").select("doc_id", "text", "ranges").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept string").withColumn(
        "doc_id", given_id())


def kept_digest(df: DataFrame) -> DataFrame:
    """The digest columns of the query in place of the texts."""
    return df.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")


def brute_force(rows: list[tuple[int, str]], size: int = 20) -> list[tuple]:
    """For tests: the same from plain Python."""
    seen, out = {}, {}
    texts = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(texts):
        w = texts[d]
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i: i + size])
            if k in seen:
                keep[i: i + size] = [False] * size
            seen.setdefault(k, 1)
        kept = b" ".join(compress(w, keep))
        out[d] = (d, len(w), keep.count(False), hashlib.sha256(kept).hexdigest())
    return [out[d] for d in sorted(out)]
