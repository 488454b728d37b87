"""N-gram Jaccard join: exact links between documents whose shingle sets are alike, found in regions of the metric space.

Jaccard distance is a metric, but unrelated documents all lie at distance 1 from each other, so pivots alone cannot split
a corpus: every window would hold all of it. The space is therefore first cut into regions that no link crosses. The
universe of shingles is dealt into more classes than linked sets can differ in shingles, so linked sets agree wholly on
some class that is not empty; documents that agree on a class are joined, and the connected groups are the regions (large
regions are cut again with other classes, as often as that parts them). Within a region, pivots create Voronoi cells, documents near a border are replicated by
triangle-inequality windows, and cells are joined recursively and exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import LOWER, buffers, byte_values, given_id, grouped, id_and_text, mix, pack, partitions, record, release, small_batches, unpack, word_hashes

PACKED = {"bucket": pa.int32(), "nodes": pa.binary(), "signatures": pa.binary(), "owners": pa.binary()}
#: signatures that a task combines before the shuffle; members of a region that is cut again; members of a cell joined at once
CHUNK, LARGE, LEAF = 2_000_000, 20_000, 64
PIVOTS = 12


class Rings:
    """Classes of set sizes such that linked sets lie in the same or in neighbouring ones, with the scheme of each."""

    def __init__(self, percent: int):
        self.percent, self.bounds = percent, [1, 2]

    def ring(self, n: int) -> int:
        while self.bounds[-1] <= n:
            top = self.bounds[-1] - 1
            self.bounds.append(max(self.bounds[-1] + 1, top * 100 // self.percent + 1))
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def scheme(self, ring: int) -> tuple[int, int]:
        """Number of classes and how many of them are told, for links whose smaller set lies in ``ring``."""
        largest = self.bounds[ring + 1] - 1
        differ = (100 - self.percent) * largest // self.percent
        spare = -(-(differ + 1) // 4) if differ else 0
        return differ + 1 + spare, differ + 1


def shingle_sets(batches, words: int):
    """Ids and sorted distinct shingle hashes of each text, slice by slice; fewer words than a shingle count as one."""
    values = byte_values()
    for batch in batches:
        for ids, data, bounds in buffers(batch):
            hashes, before = word_hashes(LOWER[data], bounds, values)
            total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
            for k in range(words):
                total += mix(hashes[k: k + len(total)], 11 + k)
            total = mix(total, 3)
            sets = []
            for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                if b - a >= words:
                    sets.append(np.unique(total[a: b - words + 1]))
                elif b > a:
                    whole = sum(int(x) * (2 * i + 1) for i, x in enumerate(mix(hashes[a:b], 17).tolist())) + b - a
                    sets.append(mix(np.array([whole % (1 << 64)], np.uint64), 19))
                else:
                    sets.append(np.zeros(0, np.uint64))
            yield ids, sets


def digest(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([mix(s, 23).sum(dtype=np.uint64), mix(s, 29).sum(dtype=np.uint64)], np.uint64).tobytes()


def identifier(words: int):
    schema = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "node": pa.binary()}

    def run(batches):
        for ids, sets in shingle_sets(batches, words):
            yield record(schema, doc_id=ids, n_shingles=[len(s) for s in sets], node=[digest(s) if len(s) else None for s in sets])

    return run


def signatures(s: np.ndarray, rings: Rings, level: int) -> np.ndarray:
    """What the set shares with any set that it links with, in one signature at least.

    Linked sets disagree on fewer classes than are told, so they agree on more than are left out. The classes with most
    shingles are told (ties: the first): of those that two sets agree on, the largest is among the told ones of both. Empty
    classes say nothing and are never told. Where one would have to be, the least shingles by hash are told as well: so
    many that linked sets have one of them in common.
    """
    own = rings.ring(len(s))
    rings.ring(rings.bounds[own + 1] if own + 1 < len(rings.bounds) else len(s) + 1)
    out, where, what = [], mix(s, 101 + level), mix(s, 31)
    for ring in (own, own - 1) if own else (own,):
        classes, told = rings.scheme(ring)
        at = (where % np.uint64(classes)).astype(np.int64)
        sums = np.zeros(classes, np.uint64)
        np.add.at(sums, at, what)
        count = np.bincount(at, minlength=classes)
        keep = np.argsort(-count, kind="stable")[:told]
        keep = keep[count[keep] > 0]
        out.append(mix(sums[keep] + keep.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1000 + ring))
        if len(keep) < told:
            least = np.sort(mix(s, 501 + level))[: len(s) - -(-rings.percent * len(s) // 100) + 1]
            out.append(mix(least, 907))
    return np.unique(np.concatenate(out))


def packer(words: int, percent: int, buckets: int, level: int):
    def flush(nodes, held):
        sigs = np.concatenate(held)
        owner = np.repeat(np.arange(len(nodes)), [len(x) for x in held])
        bucket = (mix(sigs, 41) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        table = np.frombuffer(b"".join(nodes), "V16")
        for b in range(buckets):
            own = by[cuts[b]: cuts[b + 1]]
            if len(own):
                used, at = np.unique(owner[own], return_inverse=True)
                yield record(PACKED, bucket=[b], nodes=[table[used].tobytes()], signatures=[sigs[own].tobytes()],
                             owners=[pack(np.diff(at, prepend=0))])

    def run(batches):
        rings, nodes, held, n, seen = Rings(percent), [], [], 0, set()
        for batch in batches:
            salts = np.zeros(batch.num_rows, np.uint64)
            if batch.num_columns > 2:  # regions that are cut again: signatures meet only within one
                salts = np.array([int.from_bytes(x[:8], "little") for x in batch.column(2).to_pylist()], np.uint64)
            done = 0
            for ids, sets in shingle_sets([batch], words):
                for s, salt in zip(sets, salts[done: done + len(ids)], strict=True):
                    if not len(s) or (node := digest(s)) in seen:
                        continue
                    seen.add(node)
                    nodes.append(node)
                    held.append(mix(signatures(s, rings, level) ^ salt, 43))
                    n += len(held[-1])
                done += len(ids)
                if n >= CHUNK:
                    yield from flush(nodes, held)
                    nodes, held, n, seen = [], [], 0, set()
        if held:
            yield from flush(nodes, held)
        del nodes, held, seen
        release()

    return run


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the places 0 to n-1 that each is connected with by the edges."""
    label = np.arange(n)
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := label[label], label):
            label = further
    return label


def agreeing(batches):
    """Of each bucket: sets that signatures connect, each with the least of them; one row per set, however many they share."""
    def edges(held):
        if not held:
            return
        nodes = np.concatenate([x[0] for x in held])
        base = np.cumsum([0, *(len(x[0]) for x in held)])
        table, index = np.unique(nodes, return_inverse=True)
        sigs = np.concatenate([x[1] for x in held])
        owner = index[np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)])]
        order, at = grouped(sigs)
        size = np.diff(np.append(at, len(order)))
        many = np.repeat(size > 1, size)
        group, owner = np.repeat(np.arange(len(at)), size)[many], owner[order][many]
        if not len(owner):
            return
        by = np.lexsort((owner, group))
        group, owner = group[by], owner[by]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        least = owner[head][np.cumsum(head) - 1]
        label = least_labels(least, owner, len(table))
        pairs = np.stack([label, np.arange(len(table))], 1)[label != np.arange(len(table))]
        raw = table.view("V16")
        for lo in range(0, len(pairs), 20_000):
            part = pairs[lo: lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([raw[i].tobytes() for i in part[:, k]], pa.binary()) for k in (0, 1)], ["a", "b"])

    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                yield from edges(held)
                held, now = [], row["bucket"]
            held.append((np.frombuffer(row["nodes"], "S16").view("V16").view([("x", "<u8"), ("y", "<u8")]),
                         np.frombuffer(row["signatures"], np.uint64), np.cumsum(unpack(row["owners"])[0])))
    yield from edges(held)


def node_places(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes, in order, and the place of each given one among them."""
    return np.unique(np.frombuffer(b"".join(raw), [("x", "<u8"), ("y", "<u8")]), return_inverse=True)


def edge_packer(edges, parts: int):
    """The edges that a task finds, packed by the part that their farther node is dealt to."""
    schema = {"part": pa.int32(), "a": pa.binary(), "b": pa.binary()}

    def flush(held):
        a, b = (np.frombuffer(b"".join(x), "V16") for x in held)
        part = (mix(b.view("<u8")[::2], 47) % np.uint64(parts)).astype(np.int64)
        order, at = grouped(part)
        for own in np.split(order, at[1:]):
            yield record(schema, part=[part[own[0]]], a=[a[own].tobytes()], b=[b[own].tobytes()])

    def run(batches):
        held, n = ([], []), 0
        for batch in edges(batches):
            for k in (0, 1):
                held[k].extend(batch.column(k).to_pylist())
            n += batch.num_rows
            if n >= CHUNK:
                yield from flush(held)
                held, n = ([], []), 0
        if n:
            yield from flush(held)

    return run


def spanning(batches):
    """Of each part: an edge from the least node of each connected group to each other, however many buckets told of them."""
    def edges(held):
        if not held[0]:
            return
        n = sum(map(len, held[0])) // 16
        table, at = node_places(held[0] + held[1])
        label = least_labels(at[:n], at[n:], len(table))
        own, raw = np.flatnonzero(label != np.arange(len(table))), table.view("V16")
        for lo in range(0, len(own), 20_000):
            part = own[lo: lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([raw[i].tobytes() for i in k], pa.binary()) for k in (label[part], part)], ["a", "b"])

    held, now = ([], []), None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != now:
                yield from edges(held)
                held, now = ([], []), row["part"]
            held[0].append(row["a"])
            held[1].append(row["b"])
    yield from edges(held)


def components(edges: DataFrame) -> DataFrame:
    """``node, region``: the least node of each connected group, by labels that spread and jump until none changes."""
    both = cut_lineage(edges.union(edges.select("b", "a")).toDF("node", "other").distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("region")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "region"), "other").groupBy("node").agg(F.min("region").alias("least"))
        spread = labels.join(near, "node").select("node", "region", F.least("region", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("region").alias("far"))
        new = cut_lineage(spread.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("region"), (F.least("next", F.coalesce("far", "next")) < F.col("region")).alias("changed")))
        labels = new.drop("changed")
        if not new.where("changed").limit(1).count():
            return labels


def regions(docs: DataFrame, words: int, percent: int, level: int) -> DataFrame:
    """``node, region`` of all sets that agree with another on a class. ``docs``: ``doc_id, text`` and, from level 1 on, the old region."""
    packed = docs.mapInArrow(packer(words, percent, partitions(docs), level), "bucket int, nodes binary, signatures binary, owners binary")
    # two sets may meet in every bucket: the edges of a node from all buckets come together, twice, before they become rows
    schema, source, rows = "part int, a binary, b binary", agreeing, packed.repartition("bucket").sortWithinPartitions("bucket")
    for parts in (-(-partitions(docs) // 8), -(-partitions(docs) // 64)):
        told = rows.mapInArrow(edge_packer(source, parts), schema)
        source, rows = spanning, told.repartition("part").sortWithinPartitions("part")
    edges = rows.mapInArrow(spanning, "a binary, b binary")
    return components(edges)


class Region:
    """Exact join of the sets of one region."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets])
        flat, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.universe = len(flat)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def tokens(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.size[members]
        rank = np.repeat(np.arange(len(members)), count)
        inner = np.arange(len(rank)) - np.repeat(np.cumsum(count) - count, count)
        return self.flat[np.repeat(self.at[members], count) + inner], rank

    def shared(self, x: int, tokens: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
        mark = np.zeros(self.universe, bool)
        mark[self.flat[self.at[x]: self.at[x + 1]]] = True
        return np.bincount(rank[mark[tokens]], minlength=n)

    def direct(self, members: np.ndarray, owned: np.ndarray) -> None:
        """Every owned member against all members of a cell, over the documents that hold each of its shingles."""
        tokens, rank = self.tokens(members)
        order = np.argsort(tokens, kind="stable")
        tokens, rank = tokens[order], rank[order]
        names, begin, count = np.unique(tokens, return_index=True, return_counts=True)
        size, p = self.size[members], self.percent
        for i in np.flatnonzero(owned).tolist():
            k = np.searchsorted(names, self.flat[self.at[members[i]]: self.at[members[i] + 1]])
            k = k[count[k] > 1]
            if not len(k):
                continue
            c = count[k]
            where = np.repeat(begin[k] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            both = np.bincount(rank[where], minlength=len(members))
            hit = np.flatnonzero((100 * both >= p * (size + size[i] - both)) & (members > members[i]))
            if len(hit):
                self.pairs.append((np.full(len(hit), members[i]), members[hit]))

    def join(self, members: np.ndarray, owned: np.ndarray, depth: int = 0) -> None:
        """Voronoi cells around far-apart pivots; windows of twice the radius bring in all that can link across a border."""
        n = len(members)
        if n <= LEAF or not owned.any():
            return self.direct(members, owned)
        tokens, rank = self.tokens(members)
        pivot, far, columns = 0, np.full(n, np.inf), []
        for _ in range(PIVOTS):
            both = self.shared(members[pivot], tokens, rank, n)
            columns.append(1 - both / (self.size[members] + self.size[members[pivot]] - both))
            far = np.minimum(far, columns[-1])
            pivot = int(far.argmax())
            if far[pivot] == 0:
                break
        distance = np.stack(columns, 1)
        home, least = distance.argmin(1), distance.min(1)
        window = 2 * (1 - self.percent / 100) + 1e-9
        cells = [np.flatnonzero(distance[:, k] <= least + window) for k in range(distance.shape[1])]
        if sum(len(c) ** 2 for c in cells) > 0.7 * n * n or depth > 20:  # no border keeps enough apart
            return self.direct(members, owned)
        for k, cell in enumerate(cells):
            self.join(members[cell], owned[cell] & (home[cell] == k), depth + 1)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of each set as pairs of positions."""
        self.join(np.arange(len(self.size)), np.ones(len(self.size), bool))
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.pairs, strict=True))


def joiner(percent: int):
    schema = {"rep": pa.int64(), "component_id": pa.int64(), "linked": pa.int64()}

    def solve(rows):
        reps = np.array([r["rep"] for r in rows])
        order = np.argsort(reps)
        reps, copies = reps[order], np.array([r["copies"] for r in rows])[order]
        a, b = Region([np.frombuffer(rows[i]["shingles"], np.uint64) for i in order], percent).result()
        parent = list(range(len(reps)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        links = np.zeros(len(reps), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        return record(schema, rep=reps, component_id=reps[[find(x) for x in range(len(reps))]], linked=links)

    def run(batches):
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["region"] != held[0]["region"]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)
        del held
        release()

    return run


def jaccard_join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """Links of all documents whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id`` (least doc_id that links reach, itself included), ``n_links`` (linked
    documents, copies included) and ``class_id`` (least doc_id with the same set). A-Z are lower-cased; fewer words than a
    shingle count as one shingle; a text without words links with nothing. A null text is empty. Rows that repeat an id
    count as copies of their sets, a null id as the least id (a group that holds one has a null ``component_id``). An empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    ids = cut_lineage(docs.mapInArrow(identifier(words), "doc_id long, n_shingles long, node binary"))
    classes = ids.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    found = regions(docs, words, percent, 0)
    level, before = 1, None
    while True:
        large = cut_lineage(found.groupBy("region").count().where(F.col("count") > LARGE))
        now = large.agg(F.count("*"), F.max("count"), F.sum("count")).first()
        if not now[0] or now == before:  # nothing large, or other classes do not part it any more
            break
        again = found.join(large, "region").join(classes, "node").select(F.col("rep").alias("doc_id"), "region")
        cut = regions(docs.join(again, "doc_id").select("doc_id", "text", "region"), words, percent, level)
        found = cut_lineage(found.join(large, "region", "left_anti").select("node", "region").union(cut))
        level, before = level + 1, now
    members = found.join(classes, "node").select("rep", "copies", "region")

    def sets(batches):
        schema = {"rep": pa.int64(), "copies": pa.int64(), "region": pa.binary(), "shingles": pa.binary()}
        for batch in batches:
            copies, region, done = batch.column(2).to_pylist(), batch.column(3).to_pylist(), 0
            for own, found_sets in shingle_sets([batch], words):
                n = len(own)
                yield record(schema, rep=own, copies=copies[done: done + n], region=region[done: done + n],
                             shingles=[s.tobytes() for s in found_sets])
                done += n

    one = docs.join(members.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "copies", "region")
    joined = (one.mapInArrow(sets, "rep long, copies long, region binary, shingles binary").repartition("region")
              .sortWithinPartitions("region", "rep").mapInArrow(joiner(percent), "rep long, component_id long, linked long"))
    # rows that repeat an id give the same set more than once
    joined = joined.groupBy("rep").agg(F.min("component_id").alias("component_id"), F.max("linked").alias("linked"))
    result = classes.join(joined, "rep", "left").select("node", "rep", "copies", "component_id", "linked")
    return ids.join(result, "node", "left").select(
        "doc_id", "n_shingles",
        F.coalesce("component_id", "rep", "doc_id").alias("component_id"),
        (F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("rep", "doc_id").alias("class_id")).select(
        given_id(), "n_shingles", given_id("component_id"), "n_links", given_id("class_id"))
