"""Suffix-array dedup: repeated byte strings found by a suffix sort that compares prefix hashes instead of bytes.

Every window of ``length`` bytes is filed under the smallest hash of the ``seed`` bytes long strings in it, so equal
windows of any two documents meet in one group. Neighbouring windows under one seed travel as one stretch. Equal
stretches are settled by digest; stretches that differ are brought together with their bytes, and their suffixes are
sorted by a mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut_lineage
from .common import (
    PLACE,
    SLICE,
    Rolling,
    block_columns,
    block_rows,
    byte_values,
    document_ranges,
    document_slices,
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
)
from .substrings import placed, places

PACKED = {"bucket": pa.int32(), "seeds": pa.binary(), "digests": pa.binary(), "places": pa.binary(), "counts": pa.binary(),
          "known": pa.binary(), "known_counts": pa.binary()}
CONTEXT = {"bucket": pa.int32(), "seed": pa.int64(), "doc_id": pa.int64(), "start": pa.int64(), "bytes": pa.binary()}
#: stretches that a task combines before the shuffle
CHUNK = 400_000
#: windows of one stretch at most; a group of more different stretches than MANY is dealt out by whole windows
LONGEST, MANY = 256, 2000
#: added to the number of windows of a stretch that may repeat within itself
ITSELF = 1024
#: windows sorted at once
AT_ONCE = 1_000_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w:]) if width > w else x


def stretches(batches, length: int, seed: int):
    """``seed hash, digest, document, first window, number of windows`` of all stretches, slice by slice."""
    rolling, values = Rolling(), byte_values()
    for batch in batches:
        for ids, base, data, bounds in numbered_buffers(batch):
            for lo in range(0, max(1, len(data)), 2 * SLICE):  # longer than that: one long text, cut with an overlap
                part = data[lo: lo + 2 * SLICE + length - 1]
                n = len(part) - length + 1
                if n <= 0:
                    continue
                rolling.load(values[part])
                at = np.arange(len(part) - seed + 1)
                strings, width = mix(rolling.span(at, at + seed)), length - seed + 1
                smallest = sliding_min(strings, width)
                start = np.arange(n)
                edge = bounds[1:-1] - lo
                edge = edge[(edge > 0) & (edge < len(part))]
                fits = np.ones(n + length, bool)
                for back in range(1, length):  # windows that would reach into the next text
                    fits[np.maximum(edge - back, 0)] = False
                fits = fits[:n]
                new = np.ones(n, bool)
                new[1:] = (smallest[1:] != smallest[:-1]) | ~fits[:-1]
                new[edge[edge < n]] = True
                first = start[new & fits]
                stop = np.append(np.flatnonzero(new | ~fits), n)
                count = stop[np.searchsorted(stop, first, "right")] - first
                pieces = -(-count // LONGEST)
                if len(pieces) and pieces.max() > 1:
                    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    first, count = np.repeat(first, pieces) + k * LONGEST, np.repeat(count, pieces) - k * LONGEST
                    count = np.minimum(count, LONGEST)
                doc = np.searchsorted(bounds, first + lo, "right") - 1
                # a stretch that holds its seed twice may repeat within itself
                padded = np.concatenate([np.zeros(width - 1, np.uint64), smallest, np.zeros(width - 1, np.uint64)])
                most = ~sliding_min(~padded, width)
                picks = np.flatnonzero(strings == most)
                double = np.concatenate([[0], np.cumsum(strings[picks[1:]] == strings[picks[:-1]])])
                a, b = np.searchsorted(picks, first), np.searchsorted(picks, first + count + width - 1)
                itself = double[np.maximum(b - 1, 0)] > double[np.minimum(a, len(double) - 1)]
                digest = mix(rolling.span(first, first + count + length - 1) + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 5)
                yield smallest[first], digest, ids[doc], base[doc] + first + lo - bounds[doc], count + ITSELF * itself


def settled(seeds, digests, doc, pos):
    """Rows that repeat an earlier equal stretch, first rows of all stretches, and (of those) which have others under their seed."""
    order, at = grouped(seeds)
    size = np.diff(np.append(at, len(order)))
    many = np.repeat(size > 1, size)
    single, rows = order[~many], order[many]
    group = np.repeat(np.arange(len(at)), size)[many]
    by = np.lexsort((pos[rows], doc[rows], digests[rows], group))
    rows, group = rows[by], group[by]
    if not len(rows):
        return rows, single, np.zeros(len(single), np.int64)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    head = new | np.concatenate([[True], digests[rows][1:] != digests[rows][:-1]])
    lead = rows[head][np.cumsum(head) - 1]
    later = rows[(doc[rows] != doc[lead]) | (pos[rows] != pos[lead])]
    rows, group = rows[head], group[head]
    different = np.bincount(group)[group]
    return later, np.concatenate([single, rows]), np.concatenate([np.ones(len(single), np.int64), different])


def packer(length: int, seed: int, buckets: int):
    def flush(held):
        seeds, digests, doc, pos, count = (np.concatenate(x) for x in zip(*held, strict=True))
        later, kept, _ = settled(seeds, digests, doc, pos)
        bucket, known = (mix(seeds[kept], 3) % np.uint64(buckets)).astype(np.int64), doc[later] % buckets
        by = np.argsort(bucket, kind="stable")
        kept, cuts = kept[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
        by = np.argsort(known, kind="stable")
        later, ends = later[by], np.searchsorted(known[by], np.arange(buckets + 1))
        for b in range(buckets):
            own, more = kept[cuts[b]: cuts[b + 1]], later[ends[b]: ends[b + 1]]
            if len(own) or len(more):
                order, where = places(doc[own], pos[own])
                own = own[order]
                order, known_where = places(doc[more], pos[more])
                yield record(PACKED, bucket=[b], seeds=[seeds[own].tobytes()], digests=[digests[own].tobytes()], places=[where],
                             counts=[pack(count[own])], known=[known_where], known_counts=[pack(count[more][order] % ITSELF)])

    def run(batches):
        held, n = [], 0
        for x in stretches(batches, length, seed):
            held.append(x)
            n += len(x[0])
            if n >= CHUNK:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def settler(length: int, blocks: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one bucket: what repeats a whole stretch, and the stretches that meet others under their seed."""
        parts, known = [], []
        for batch in batches:
            for row in batch.to_pylist():
                known.append((*placed(row["known"]), unpack(row["known_counts"])[0]))
                parts.append((np.frombuffer(row["seeds"], np.uint64), np.frombuffer(row["digests"], np.uint64), *placed(row["places"]),
                              unpack(row["counts"])[0]))
        seeds, digests, doc, pos, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        later, kept, different = settled(seeds, digests, doc, pos)
        count, itself = count % ITSELF, count >= ITSELF
        gone = [np.concatenate([x[later], *more]) for x, more in zip((doc, pos, count), zip(*known, strict=True), strict=True)]
        yield from block_rows(gone[0], blocks, gone[1], gone[2] + length - 1, extra={"contested": 0})
        open_ = (different > 1) | itself[kept]
        kept, different = kept[open_], different[open_]
        yield from block_rows(doc[kept], blocks, pos[kept], count[kept], seeds[kept].view(np.int64), (different > MANY).astype(np.int64),
                              extra={"contested": 1})

    return settle


def document_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a block: one row per text with its contested stretches, packed."""
    doc, place, *columns = block_columns(batches)
    ids, parts, rows = document_slices(doc, place)
    columns = [place & ((1 << PLACE) - 1), *columns]
    blobs = [pack(*(c[a:b] for c in columns)) for a, b in rows]
    schema = {"doc_id": pa.int64(), "part": pa.int64(), "stretches": pa.binary()}
    for lo in range(0, len(ids), 5000):
        hi = lo + 5000
        yield record(schema, doc_id=ids[lo:hi], part=parts[lo:hi], stretches=blobs[lo:hi])


def fetcher(length: int, buckets: int):
    def fetch(batches):
        """The bytes of contested stretches; of a group of very many, each window by itself, dealt out by its content."""
        for batch in batches:
            out = {k: [] for k in CONTEXT}

            def add(bucket, seed, doc, start, content, out=out):
                for k, v in zip(CONTEXT, (bucket, seed, doc, start, content), strict=True):
                    out[k].append(v)

            held = 0
            for doc, text, part, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(),
                                             batch.column(3).to_pylist(), strict=True):
                text, base = text.as_buffer().to_pybytes(), part << PLACE
                if blob:
                    starts, counts, seeds, hot = unpack(blob)
                    where = (mix(seeds.view(np.uint64), 3) % np.uint64(buckets)).astype(np.int64)
                    for b, s, a, n, h in zip(where.tolist(), seeds.tolist(), starts.tolist(), counts.tolist(), hot.tolist(), strict=True):
                        if not h:
                            add(b, s, doc, base + a, text[a: a + n + length - 1])
                        else:
                            for w in range(a, a + n):
                                content = text[w: w + length]
                                add((hash_of(content) ^ (s & 0xFFFFFFFF)) % buckets, s, doc, base + w, content)
                        held += n + length if not h else n * length
                        if held > 4 * SLICE:
                            yield record(CONTEXT, **out)
                            for v in out.values():
                                v.clear()
                            held = 0
            yield record(CONTEXT, **out)

    return fetch


def hash_of(content: bytes) -> int:
    import zlib

    return zlib.crc32(content)


class Suffixes:
    """A text buffer whose suffixes compare by prefix polynomial hashes over at most ``length`` bytes."""

    def __init__(self, buffer: bytes, length: int):
        self.data = np.frombuffer(buffer + bytes(length + 8), np.uint8)
        self.length = length
        self.rolling = Rolling().load(byte_values()[self.data])

    def prefix(self, at, n):
        return self.rolling.span(at, at + n)

    def common(self, a, b):
        """Length of the longest common extension of the suffixes at a and b, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) // 2
            same = self.prefix(a, mid) == self.prefix(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            high = np.maximum(high, low)
        return low

    def less(self, a, b):
        """Whether suffix a sorts before suffix b."""
        n = self.common(a, b)
        return (n < self.length) & (self.data[a + n] < self.data[b + n])

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of the suffixes of each segment (a sorted column); all merges of a level at once."""
        n = len(at)
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(starts, n))
        base, total = np.repeat(starts, size), np.repeat(size, size)
        local, perm, width = np.arange(n) - base, np.arange(n), 1
        while width < size.max():
            pair = local // (2 * width) * (2 * width)
            left = local - pair < width
            low = np.where(left, pair + width, pair)
            low = np.minimum(low, total)
            high = np.minimum(np.where(left, pair + 2 * width, pair + width), total)
            begin = low.copy()
            open_ = np.flatnonzero(low < high)
            while len(open_):  # place of each suffix in the other run
                mid = (low[open_] + high[open_]) // 2
                own, other = at[perm[open_]], at[perm[base[open_] + mid]]
                is_left = left[open_]
                goes = np.empty(len(open_), bool)
                goes[is_left] = self.less(other[is_left], own[is_left])
                goes[~is_left] = ~self.less(own[~is_left], other[~is_left])
                low[open_] = np.where(goes, mid + 1, low[open_])
                high[open_] = np.where(goes, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            own_rank = np.where(left, local - pair, local - pair - width)
            target = base + pair + own_rank + (low - begin)
            moved = np.empty_like(perm)
            moved[target] = perm
            perm, width = moved, 2 * width
        return perm

    def same_bytes(self, a, b):
        """Collision check: whether the bytes of both windows are the same."""
        words = np.lib.stride_tricks.as_strided(self.data, (len(self.data) - 7, 8), (1, 1))
        out = np.ones(len(a), bool)
        for i in [*range(0, self.length - 7, 8), max(0, self.length - 8)]:
            live = np.flatnonzero(out)
            out[live] = (words[a[live] + i] == words[b[live] + i]).all(1)
        return out


def later_windows(contents: list[bytes], seeds: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int, seed: int):
    """Documents and starts of all windows, in these stretches, that start later than an equal window of the same seed."""
    buffer = b"".join(contents)
    sizes = np.array([len(x) for x in contents], np.int64)
    begin = np.cumsum(sizes) - sizes
    suffixes = Suffixes(buffer, length)
    count = sizes - length + 1
    stretch = np.repeat(np.arange(len(contents)), count)
    inner = np.arange(len(stretch)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[stretch] + inner
    # windows can be equal only if their seed lies at the same place
    all_at = np.arange(len(buffer))
    owner = np.repeat(np.arange(len(contents)), sizes)
    hit = mix(suffixes.prefix(all_at, seed)) == seeds[owner]
    following = np.where(hit, all_at, 1 << 62)
    following = np.minimum.accumulate(following[::-1])[::-1]
    offset = np.minimum(following[at] - at, length)
    order = np.lexsort((offset, seeds[stretch]))
    at, stretch, inner, offset = at[order], stretch[order], inner[order], offset[order]
    key = seeds[stretch]
    segment = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (offset[1:] != offset[:-1])]))
    perm = suffixes.sort(at, segment)
    at, stretch, inner = at[perm], stretch[perm], inner[perm]
    whole = suffixes.prefix(at, length)
    near = np.concatenate([[False], (whole[1:] == whole[:-1]) & (segment[1:] == segment[:-1])])
    rows = np.flatnonzero(near)
    wrong = rows[~suffixes.same_bytes(at[rows - 1], at[rows])]
    for s in np.unique(segment[wrong]):  # a collision: that segment by its bytes
        own = np.flatnonzero(segment == s)
        own_order = own[sorted(range(len(own)), key=lambda i: buffer[at[own[i]]: at[own[i]] + length])]
        at[own], stretch[own], inner[own] = at[own_order], stretch[own_order], inner[own_order]
        near[own[1:]] = [buffer[x: x + length] == buffer[y: y + length] for x, y in zip(at[own[:-1]], at[own[1:]], strict=True)]
        near[own[0]] = False
    run = np.cumsum(~near)
    d, p = doc[stretch], start[stretch] + inner
    by = np.lexsort((p, d, run))
    d, p, run = d[by], p[by], run[by]
    head = np.concatenate([[True], run[1:] != run[:-1]])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (d != d[first]) | (p != p[first])
    return d[later], p[later]


def sorter(length: int, seed: int, blocks: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one bucket: the windows of contested stretches that start later than an equal one."""
        table = pa.Table.from_batches(list(batches))
        seeds = table.column("seed").to_numpy().view(np.uint64)
        doc, start = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
        contents = table.column("bytes")
        order = np.argsort(seeds, kind="stable")
        windows = np.cumsum(np.asarray([len(x.as_buffer()) - length + 1 for x in contents], np.int64)[order])
        new = np.flatnonzero(np.concatenate([[True], seeds[order][1:] != seeds[order][:-1]]))
        a, found = 0, []
        while a < len(order):  # whole groups, about AT_ONCE windows at a time
            done = windows[a - 1] if a else 0
            b = int(np.searchsorted(windows, done + AT_ONCE, "right"))
            k = int(np.searchsorted(new, max(b, a + 1), "right"))
            b = int(new[k - 1]) if k and new[k - 1] > a else (int(new[k]) if k < len(new) else len(order))
            if windows[-1] <= done + AT_ONCE:
                b = len(order)
            own = order[a:b]
            found.append(later_windows([contents[int(i)].as_buffer().to_pybytes() for i in own], seeds[own], doc[own], start[own], length, seed))
            a = b
        d, p = (np.concatenate(x) for x in zip(*found, strict=True))
        yield from block_rows(d, blocks, p, np.full(len(p), length))

    return sort


def suffix_dedup(docs: DataFrame, length: int = 100, seed: int = 40) -> DataFrame:
    """Remove every byte covered by a ``length`` bytes long string that also starts earlier.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes; cuts can fall inside a character). Null
    texts are empty, a null id sorts before all others. Rows that repeat an id and its text are one document: equal
    (id, start) never removes itself. Different texts of one id are documents of their own, in the order of their digests.
    An empty table gives no rows.
    """
    if not 8 <= seed <= length:
        raise ValueError("seed must be from 8 to length")
    docs = numbered(id_and_text(docs))
    buckets = partitions(docs)
    packed = docs.mapInArrow(packer(length, seed, buckets), "bucket int, seeds binary, digests binary, places binary, "
                             "counts binary, known binary, known_counts binary")
    first = cut_lineage(packed.groupBy("bucket").applyInArrow(settler(length, buckets), "block int, found binary, contested int"))
    stretches_of = first.where("contested = 1").groupBy("block").applyInArrow(document_stretches, "doc_id long, part long, stretches binary")
    contexts = docs.join(stretches_of, ["doc_id", "part"]).select("doc_id", "text", "part", "stretches").mapInArrow(
        fetcher(length, buckets), "bucket int, seed long, doc_id long, start long, bytes binary")
    second = contexts.groupBy("bucket").applyInArrow(sorter(length, seed, buckets), "block int, found binary")
    found = first.where("contested = 0").select("block", "found").unionByName(second)
    ranges = found.groupBy("block").applyInArrow(document_ranges, "doc_id long, part long, ranges binary")

    def cut(batches):
        schema = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        for batch in batches:
            out = {k: [] for k in schema}
            for doc, text, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_buffer().to_pybytes()
                kept, gone, spans = text, 0, 0
                if blob:
                    a, b = unpack(blob)
                    b = np.minimum(b, len(text))
                    gone, spans = int((b - a).sum()), len(a)
                    ends = [0, *b.tolist()]
                    kept = b"".join(text[x:y] for x, y in zip(ends, [*a.tolist(), len(text)], strict=True))
                for k, v in zip(schema, (doc, len(text), gone, spans, kept), strict=True):
                    out[k].append(v)
            yield record(schema, **out)

    return docs.join(ranges, ["doc_id", "part"], "left").select("doc_id", "text", "ranges").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumn("doc_id", given_id())


def brute_force(rows: list[tuple[int, str]], length: int = 100) -> list[tuple]:
    """For tests: the same from plain Python."""
    import hashlib

    seen, out = set(), []
    for d, t in sorted((d, (t or "").encode()) for d, t in rows):
        keep = bytearray(b"\x01" * len(t))
        for i in range(len(t) - length + 1):
            k = t[i: i + length]
            if k in seen:
                keep[i: i + length] = bytes(length)
            seen.add(k)
        runs = sum(1 for i, v in enumerate(keep) if not v and (i == 0 or keep[i - 1]))
        out.append((d, len(t), keep.count(0), runs, hashlib.sha256(bytes(b for b, v in zip(t, keep, strict=True) if v)).hexdigest()))
    return out
