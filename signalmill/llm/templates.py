"""Benchmark decontamination by templates: numbers, names and units become placeholders, template windows are joined by
hash, and a match counts only where the placeholders' values map consistently between item and document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from .common import mix, release, small_batches

#: fixed values: unit words
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days "
    "week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent degree degrees meter meters metre "
    "metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds "
    "liter liters litre litres".split())
NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?")
GLUED = re.compile(r"([-+]?[$€£]?\d[\d.,]*)([a-z]+)")
EDGE = ".,;:!?\"'()[]{}<>*_`~|#&$%=-"
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
#: words that a task remembers, and bytes of benchmark text that one pass over the documents looks for
KNOWN, BLOCK_BYTES = 300_000, 8 << 20


def number_seed(kind: int) -> np.uint64:
    return mix(np.array([kind], np.uint64), 97)[0]


class Canonical:
    """Words as template tokens; what a word is by itself is looked up once."""

    def __init__(self):
        self.clear()
        self.marks = MARKS

    def clear(self):
        self.known, self.new, self.taken = {}, [], 0
        self.values, self.kinds, self.ends = np.zeros(1024, np.uint64), np.zeros(1024, np.int8), np.zeros(1024, bool)

    def learn(self, word: str) -> int:
        bare = word.strip(EDGE) or word
        low = bare.lower()
        kind = LITERAL
        glued = GLUED.fullmatch(low)
        if NUMBER.fullmatch(low) or glued and glued[2] in UNITS:
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        elif bare[:1].isupper() and bare[1:].islower():
            kind = NAME
        end = word.rstrip("\"')]}*_")[-1:]
        self.new.append((xxhash.xxh64_intdigest(low), kind, end != "" and end in ".!?:"))
        return self.taken + len(self.new) - 1

    def settle(self) -> None:
        """Put newly learned words behind the others; the arrays double as they fill."""
        end = self.taken + len(self.new)
        for name, column in zip(("values", "kinds", "ends"), zip(*self.new, strict=True), strict=True):
            held = getattr(self, name)
            if end > len(held):
                held = np.concatenate([held, np.zeros(max(len(held), end - len(held)), held.dtype)])
                setattr(self, name, held)
            held[self.taken: end] = column
        self.new, self.taken = [], end

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word, its template hash, its kind and its kind whatever stands before it. A unit needs a number
        before it; a name needs a word before it that does not end a sentence."""
        words = text.split()
        if len(self.known) > KNOWN:
            self.clear()
        known = self.known
        at = [known[w] if w in known else known.setdefault(w, self.learn(w)) for w in words]
        if self.new:
            self.settle()
        at = np.array(at, np.int64)
        values, kinds, ends = self.values[at], self.kinds[at], self.ends[at]
        before = np.concatenate([[LITERAL], kinds[:-1]]) if len(at) else kinds
        opens = np.concatenate([[True], ends[:-1]]) if len(at) else ends
        alone = kinds
        kinds = np.where((kinds == UNIT) & (before != NUM) | (kinds == NAME) & opens, LITERAL, kinds)
        return values, np.where(kinds == LITERAL, values, self.marks[kinds]), kinds, alone


MARKS = np.array([number_seed(k) for k in range(4)], np.uint64)


def windows(values: np.ndarray, template: np.ndarray, kinds: np.ndarray, alone: np.ndarray, size: int, literals: int):
    """Hash of each window: of its template, or, where fewer than ``literals`` words are literal, of the words themselves.

    A window's first word may be literal or not by the word before the window, which is not part of it. ``places, hashes``
    after the first result are the windows whose first word can be taken the other way.
    """
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    shown, plain = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(size):
        odd = np.uint64(((2 * k + 3) * 0x9E3779B97F4A7C15 | 1) & ((1 << 64) - 1))
        shown += template[k: k + n] * odd
        plain += values[k: k + n] * odd
    count = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    literal = count[size:] - count[:-size]

    def hashes(shown, plain, literal):
        return np.where(literal < literals, mix(plain, 103), mix(shown, 107)) + np.uint64(size)

    at = np.flatnonzero((alone[:n] == UNIT) | (alone[:n] == NAME))
    was = kinds[at] == LITERAL
    first = np.where(was, MARKS[alone[at]], values[at])
    odd = np.uint64((3 * 0x9E3779B97F4A7C15 | 1) & ((1 << 64) - 1))
    other = hashes(shown[at] + (first - template[at]) * odd, plain[at], literal[at] + np.where(was, -1, 1))
    return hashes(shown, plain, literal), at, other


class Items:
    """Windows of a block of benchmark items, ready to be looked up."""

    def __init__(self, rows: list[tuple], size: int, literals: int, least: int):
        make = Canonical()
        self.size, self.literals, self.least, self.items = size, literals, least, []
        parts = []
        for item, text in rows:
            values, template, kinds, alone = make(text or "")
            if not len(values):
                continue
            own = min(size, len(values))
            found, _, _ = windows(values, template, kinds, alone, own, self.needed(own))
            parts.append((found, np.full(len(found), len(self.items)), np.arange(len(found)), np.full(len(found), own)))
            self.items.append((item, values, kinds))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3
        order = np.argsort(columns[0], kind="stable")
        self.hashes, self.item, self.place, self.length = (c[order] for c in columns)
        self.lengths = sorted(set(self.length.tolist()))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes & np.uint64((1 << 20) - 1)] = True

    def needed(self, size: int) -> int:
        """Literal words without which a window is looked for word by word; short items always are."""
        return size + 1 if size < self.least else min(self.literals, size)

    def leaks(self, values, template, kinds, alone, share: float) -> list[tuple]:
        """``item, words covered, words of the item`` for each item that the document holds ``share`` of or more."""
        hits = []
        for size in self.lengths:
            own, places, other = windows(values, template, kinds, alone, size, self.needed(size))
            at = np.flatnonzero(self.bits[own & np.uint64((1 << 20) - 1)])
            more = np.flatnonzero(self.bits[other & np.uint64((1 << 20) - 1)])
            sought, at = np.concatenate([own[at], other[more]]), np.concatenate([at, places[more]])
            low, high = np.searchsorted(self.hashes, sought, "left"), np.searchsorted(self.hashes, sought, "right")
            count = high - low
            if count.any():
                entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                hits.append((np.repeat(at, count), entry))
        if not hits:
            return []
        at, entry = (np.concatenate(x) for x in zip(*hits, strict=True))
        # windows of one item at one distance belong together
        item, shift = self.item[entry], at - self.place[entry]
        order = np.lexsort((at, shift, item))
        covered: dict[int, np.ndarray] = {}
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(item[order]) != 0) | (np.diff(shift[order]) != 0)]))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:b]
            k, move = int(item[own[0]]), int(shift[own[0]])
            _, there, there_kinds = self.items[k]
            mask = covered.setdefault(k, np.zeros(len(there), bool))
            mask |= self.consistent(self.place[entry[own]], self.length[entry[own]], there, there_kinds, values, move)
        return [(self.items[k][0], int(m.sum()), len(m)) for k, m in sorted(covered.items()) if m.sum() >= share * len(m)]

    @staticmethod
    def consistent(places, lengths, there, there_kinds, values, move) -> np.ndarray:
        """Item words in matched windows without a slot whose value stands for another one elsewhere. A matched window's
        words have the kinds of the item's."""
        mask = np.zeros(len(there), bool)
        for p, n in zip(places.tolist(), lengths.tolist(), strict=True):
            mask[p: p + n] = True
        slots = np.flatnonzero(mask & (there_kinds != LITERAL))
        forward, backward, wrong = {}, {}, []
        for i in slots.tolist():
            a, b = (int(there_kinds[i]), int(there[i])), (int(there_kinds[i]), int(values[i + move]))
            if forward.setdefault(a, b) != b or backward.setdefault(b, a) != a:
                wrong.append(i)
        if wrong:
            mask[:] = False
            for p, n in zip(places.tolist(), lengths.tolist(), strict=True):
                if not any(p <= i < p + n for i in wrong):
                    mask[p: p + n] = True
        return mask


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about BLOCK_BYTES of text: one pass over the documents sends one part to every task."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def block_items(block: DataFrame, size: int, literals: int, least: int):
    """The block's windows as plain arrays and lists: executors need no copy of this package to read them."""
    rows = sorted((tuple(r) for r in block.collect()), key=lambda r: (str(r[0]), r[1]))
    return block.sparkSession.sparkContext.broadcast(vars(Items(rows, size, literals, least)))


def from_parts(parts: dict) -> Items:
    items = Items.__new__(Items)
    vars(items).update(parts)
    return items


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 8, share: float = 0.5, literals: int = 3, least: int = 4) -> DataFrame:
    """Benchmark items in every whole text: ``doc_id, contaminated, item_ids, covered_words`` (of the fullest item).

    A document is contaminated by an item if matched windows of ``size`` template words (an item with fewer is one
    window) cover ``share`` of the item's words. Items of fewer than ``least`` words are looked for as whole exact phrases;
    null items and items without words are not. A null text is empty; each row is judged by its own text. ``item_ids`` has
    the type of ``item_id``. An empty table gives no rows, an empty benchmark contaminates nothing.
    """
    small_batches(docs.sparkSession)
    kind = ArrayType(benchmark.schema["item_id"].dataType)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.lit(None).cast(kind).alias("item_ids"), F.lit(0).cast("long").alias("covered_words"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("item_ids", to_arrow_type(kind)), ("covered_words", pa.int64())])
    for block in blocks(benchmark):
        rows = rows.mapInArrow(_marker(block_items(block, size, literals, least), share, schema), rows.schema)
    return rows.select("doc_id", F.expr("item_ids IS NOT NULL").alias("contaminated"),
                       F.coalesce(F.array_sort("item_ids"), F.array().cast(kind)).alias("item_ids"), "covered_words")


def _marker(items, share, schema):
    def run(batches):
        make, look = Canonical(), from_parts(items.value)
        for batch in batches:
            ids, covered = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, text in enumerate(batch.column(1)):
                found = look.leaks(*make(text.as_py()), share)
                if found:
                    ids[i] = (ids[i] or []) + [k for k, _, _ in found]
                    covered[i] = max(covered[i], *(n for _, n, _ in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, schema.field(2).type),
                                              pa.array(covered, pa.int64())], schema=schema)
        del make, look
        release()

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 8, share: float = 0.5, literals: int = 3, least: int = 4) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no benchmark item contaminates. A null text is empty and stays, repeated
    rows are judged one by one; an empty table stays empty, an empty benchmark removes nothing."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    schema = docs.schema
    for block in blocks(benchmark):
        items = block_items(block, size, literals, least)

        def run(batches, items=items):
            make, look = Canonical(), from_parts(items.value)
            for batch in batches:
                keep = [not look.leaks(*make(t.as_py() or ""), share) for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))
            del make, look
            release()

        docs = docs.mapInArrow(run, schema)
    return docs
