"""Runs of words that repeat with a period, found through a grammar of the words.

Re-Pair: the most frequent adjacent pairs are replaced by new symbols until no pair occurs twice, pairs that do not overlap
in one round; what is left of a document is joined two by two. Every replacement is one node of a derivation: a stretch of
words cut in two. A run lies in a lowest node and there crosses its cut, so each different node is searched once, at one
of its places, for the runs that cross its cut, and what is found holds at all its places. Stretches are compared by prefix
hashes and every run that is reported is compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MASK, buffers, merged, mix, ranges_of

PRIME = (1 << 31) - 1
ROOT = 48271  # a primitive root of it
#: pairs of node and period that are looked at together
TOGETHER = 1 << 21
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Numbers(dict):
    """A number for every different word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Hashes:
    """Prefix hashes of words modulo a prime: equal stretches have equal hashes; others are told apart with a chance of 2^-31."""

    def __init__(self, word: np.ndarray):
        n = len(word)
        power = np.ones(1, np.int64)
        while len(power) <= n:
            power = np.concatenate([power, power * pow(ROOT, len(power), PRIME) % PRIME])
        value = (mix(word.astype(np.uint64), 13) & np.uint64(MASK >> 33)).astype(np.int64)
        self.power = power
        self.prefix = np.concatenate([[0], np.cumsum(value * power[:n] % PRIME) % PRIME])

    def repeats(self, at: np.ndarray, size: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Do ``size`` words from ``at`` look like those ``shift`` words later?"""
        near = (self.prefix[at + size] - self.prefix[at]) % PRIME
        far = (self.prefix[at + size + shift] - self.prefix[at + shift]) % PRIME
        return near * self.power[shift] % PRIME == far


def apart(place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of adjacent pairs, some that do not overlap: least ranks first, every second one of equal pairs in a row,
    until no other could be added."""
    taken = np.zeros(len(place), bool)
    left = np.arange(len(place))
    while len(left):
        p, r = place[left], rank[left]
        touch = np.diff(p) == 1
        begin = np.concatenate([[True], ~(touch & (r[1:] == r[:-1]))])
        inner = np.arange(len(p)) - np.maximum.accumulate(np.where(begin, np.arange(len(p)), 0))
        key = 2 * r + inner % 2
        less = key[:-1] < key[1:]
        best = np.ones(len(p), bool)
        best[:-1] &= ~touch | less
        best[1:] &= ~touch | ~less
        taken[left[best]] = True
        gone = best.copy()
        gone[1:] |= touch & best[:-1]
        gone[:-1] |= touch & best[1:]
        left = left[~gone]
    return taken


def grammar(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``node, start, cut, stop`` of every replacement over several documents; equal nodes derive equal words."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    symbol, start, stop = word.astype(np.int64), np.arange(len(word)), np.arange(1, len(word) + 1)
    following = first_new = int(word.max(initial=-1)) + 1
    events = []

    def replace(at: np.ndarray, node: np.ndarray):
        nonlocal symbol, start, stop, owner
        events.append((node, start[at], stop[at], stop[at + 1]))
        symbol[at], stop[at] = node, stop[at + 1]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, start, stop, owner = symbol[keep], start[keep], stop[keep], owner[keep]

    first_new = 0
    while True:
        # a pair of old symbols was rare before and cannot have become frequent
        new = symbol >= first_new
        at = np.flatnonzero((owner[1:] == owner[:-1]) & (new[1:] | new[:-1]))
        pairs, which, count = np.unique(symbol[at] << 32 | symbol[at + 1], return_inverse=True, return_counts=True)
        frequent = count[which] > 1
        if not frequent.any():
            break
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((pairs, -count))] = np.arange(len(pairs))
        at, which = at[frequent], which[frequent]
        some = apart(at, rank[which])
        number = np.unique(which[some], return_inverse=True)[1]
        first_new = following
        replace(at[some], following + number)
        following += int(number.max()) + 1
    while len(symbol) and (owner[1:] == owner[:-1]).any():
        begin = np.concatenate([[True], owner[1:] != owner[:-1]])
        inner = np.arange(len(symbol)) - np.maximum.accumulate(np.where(begin, np.arange(len(symbol)), 0))
        at = np.flatnonzero((inner[:-1] % 2 == 0) & ~begin[1:])
        replace(at, following + np.arange(len(at)))
        following += len(at)
    if not events:
        return tuple(np.zeros((4, 0), np.int64))
    return tuple(np.concatenate(x) for x in zip(*events, strict=True))


def needed(period, least: int, times: int):
    """How many words in a row a run must share with those one period later."""
    return np.maximum(least - period, (times - 1) * period)


def reach(hashes: Hashes, at: np.ndarray, room: np.ndarray, shift: np.ndarray, back: bool) -> np.ndarray:
    """The most words, up to ``room``, that repeat ``shift`` words later from ``at`` on, or before it."""
    low, high = np.zeros(len(at), np.int64), room.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = hashes.repeats(at - middle if back else at, middle, shift)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def crossing_exactly(word: np.ndarray, low: int, cut: int, high: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """Runs of a stretch that cross the cut, by comparing words at every period."""
    found = {}
    for period in range((high - low) // times, 0, -1):
        a, b = ranges_of(word[low: high - period] == word[low + period: high])
        for s, e in zip((a + low).tolist(), (b + low).tolist(), strict=True):
            if s < cut < e + period and e - s >= needed(period, least, times):
                found[s, e + period] = period
    return [(s, e, period) for (s, e), period in found.items()]


def crossings(word, hashes, low, cut, high, least: int, times: int):
    """``which, start, stop, period`` of the runs that cross the cut of each stretch."""
    out = []
    width = (high - low) // times
    ends = np.cumsum(width)
    a = 0
    while a < len(low):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right")))
        which = np.repeat(np.arange(a, b), width[a:b])
        period = 1 + np.arange(len(which)) - (np.cumsum(width[a:b]) - width[a:b])[which - a]
        lo, m, hi = low[which], cut[which], high[which]
        # a run that crosses reaches one period beyond the cut to the right, or to the left
        for at, inside in ((m - 1, m + period <= hi), (m - period, m - period >= lo)):
            k = np.flatnonzero(inside)
            k = k[word[at[k]] == word[at[k] + period[k]]]
            shift, anchor, l, h = period[k], at[k], lo[k], hi[k] - period[k]
            need = needed(shift, least, times)
            half = (need + 1) // 2
            before, after = anchor + 1 - half >= l, anchor + half <= h
            before[before] = hashes.repeats((anchor + 1 - half)[before], half[before], shift[before])
            after[after] = hashes.repeats(anchor[after], half[after], shift[after])
            near = before | after
            k, shift, anchor, l, h = k[near], shift[near], anchor[near], l[near], h[near]
            start = anchor - reach(hashes, anchor, anchor - l, shift, True)
            stop = anchor + reach(hashes, anchor, h - anchor, shift, False)
            long = stop - start >= need[near]
            out.append((which[k][long], start[long], (stop + shift)[long], shift[long]))
        a = b
    which, start, stop, period = (np.concatenate(x) for x in zip(*out, strict=True)) if out else np.zeros((4, 0), np.int64)
    # of the periods of one stretch the smallest
    order = np.lexsort((period, stop, start, which))
    which, start, stop, period = which[order], start[order], stop[order], period[order]
    lead = np.ones(len(which), bool)
    lead[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    which, start, stop, period = which[lead], start[lead], stop[lead], period[lead]
    wrong = {w for w, s, e, p in zip(which.tolist(), start.tolist(), stop.tolist(), period.tolist(), strict=True)
             if not np.array_equal(word[s: e - p], word[s + p: e])}
    if wrong:  # hashes that agreed by chance
        good = ~np.isin(which, list(wrong))
        more = [(w, *run) for w in sorted(wrong) for run in crossing_exactly(word, int(low[w]), int(cut[w]), int(high[w]), least, times)]
        extra = np.array(more, np.int64).reshape(-1, 4).T
        which, start, stop, period = (np.concatenate([x[good], y]) for x, y in zip((which, start, stop, period), extra, strict=True))
    return which, start, stop, period


def find_runs(word: np.ndarray, bounds: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """``document, start, stop, period`` of all runs, ordered; places are counted over all documents."""
    node, low, cut, high = grammar(word, bounds)
    wide = np.flatnonzero(high - low >= least)
    node, low, cut, high = node[wide], low[wide], cut[wide], high[wide]
    names, shown = np.unique(node, return_index=True)
    which, start, stop, period = crossings(word, Hashes(word), low[shown], cut[shown], high[shown], least, times)
    # to all places of the nodes
    order = np.argsort(node, kind="stable")
    a, b = (np.searchsorted(node[order], names[which], side) for side in ("left", "right"))
    many = b - a
    run = np.repeat(np.arange(len(which)), many)
    place = low[order[np.arange(len(run)) - (np.cumsum(many) - many)[run] + a[run]]] - low[shown][which[run]]
    start, stop, period = start[run] + place, stop[run] + place, period[run]
    document = np.searchsorted(bounds, start, "right") - 1
    # pieces of one run overlap by a period or more
    order = np.lexsort((start, period, document))
    document, start, stop, period = document[order], start[order], stop[order], period[order]
    group = np.cumsum(np.concatenate([[0], (document[1:] != document[:-1]) | (period[1:] != period[:-1])])) if len(order) else order
    far = group * (len(word) + 1)
    high_water = np.maximum.accumulate(stop + far) if len(order) else stop
    begin = np.ones(len(order), bool)
    begin[1:] = (group[1:] != group[:-1]) | ((start + far)[1:] > high_water[:-1] - period[1:])
    at = np.flatnonzero(begin)
    stop = (high_water - far)[np.append(at[1:], len(order)) - 1] if len(order) else stop
    document, start, period = document[at], start[at], period[at]
    order = np.lexsort((period, start, document))
    return document[order], start[order], stop[order], period[order]


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: the runs (``start, length, period`` in words, ordered by start, then
    period) and the text with what a run repeats after its first period left out, its words joined by single spaces.

    A run is a stretch of ``least`` words or more that holds its smallest period ``times`` times or more and that no word before or
    after continues. Words lie between ASCII white space and are compared as they are. A word goes if any run holds it after
    that run's first period. Null and empty texts have no words, no runs and an empty result. Rows are judged each by
    itself, whatever their ids (null too); other columns are not read; an empty table gives no rows. Nothing is shuffled; a
    task holds a mebibyte of text, or one longer text, at a time.
    """
    if times < 2 or least < 2:
        raise ValueError("a run holds its period at least twice and has two words or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def search(batches):
        for batch in batches:
            at = 0
            for _, data, bounds in buffers(batch):
                texts = [data[a:b].tobytes().split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                number = Numbers()
                counts = [len(t) for t in texts]
                limits = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                word = np.fromiter((number[w] for t in texts for w in t), np.int64, int(limits[-1]))
                runs = [[] for _ in texts]
                document, start, stop, period = find_runs(word, limits, least, times)
                for d, s, e, p in zip(document.tolist(), start.tolist(), stop.tolist(), period.tolist(), strict=True):
                    runs[d].append({"start": s - int(limits[d]), "length": e - s, "period": p})
                for d in np.unique(document).tolist():
                    own = document == d
                    a, b = merged(start[own] + period[own] - limits[d], stop[own] - limits[d])
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), counts[d]]
                    texts[d] = [w for i in range(0, len(edges), 2) for w in texts[d][edges[i]: edges[i + 1]]]
                kept = [b" ".join(t).decode() for t in texts]
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.string())], schema=schema)

    return rows.mapInArrow(
        search, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: str) -> Column:
    """The run with the greatest exact ratio of length to period; of equal ones the first."""
    def better(best: Column, run: Column) -> Column:
        more = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents, of which those whose crc32 ends in 0 have a periodic end: with ``h`` the crc32 of the
    decimal id, ``g = floor(h / 10)`` and n words, the words from ``g % n`` on repeat the first ``1 + floor((n - g % n) / (3 + g % 8))``
    of them. Texts that stay keep their white space. A null id stays unchanged."""
    words = docs.select("doc_id", "text", F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)").alias("words"),
                        F.crc32(F.col("doc_id").cast("long").cast("string")).alias("h"))
    named = words.select("doc_id", "text", "words", F.size("words").alias("n"), F.col("h"), F.expr("h div 10").alias("g"))
    part = named.withColumn("a", F.expr("CAST(CASE WHEN n > 0 THEN g % n ELSE 0 END AS INT)"))
    part = part.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    tail = F.expr("flatten(array_repeat(slice(words, a + 1, p), CAST(ceil((n - a) / p) AS INT)))")
    edited = F.concat(F.expr("slice(words, 1, a)"), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return part.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The strongest run of each row of ``periodic_runs``, and digests of all its runs and of what is left of its text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("best", strongest("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
