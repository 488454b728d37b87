"""Document fingerprints by consistent weighted sampling: a text is a set of words weighted by how often they occur."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_id, id_and_text, mix, partitions, record

#: parameters of words that a task keeps between texts
KNOWN = 120_000


def uniforms(keys: np.ndarray, samples: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) of 24 bits for each key and sample, from one hash."""
    factors = mix(np.arange(samples, dtype=np.uint64), 83 + stream) | np.uint64(1)
    bits = mix(keys, 71 + stream)[:, None] * factors[None, :]
    bits ^= bits >> np.uint64(31)
    bits *= np.uint64(0xBF58476D1CE4E5B9)
    high = (bits >> np.uint64(40)).astype(np.float32)
    low = ((bits >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32)
    return (low + np.float32(0.5)) * np.float32(2.0**-24), (high + np.float32(0.5)) * np.float32(2.0**-24)


class Sampler:
    """Of each weighted set: for every sample, the word and the quantised weight with the least of a gamma-based value.

    For word w of weight s: r and c are gamma(2, 1), b is uniform, all drawn from w alone; t = floor(ln s / r + b);
    ln a = ln c - r (t - b + 1). Two sets agree on (word, t) with a probability equal to their generalised Jaccard similarity.
    Kept per word: r, b and ln c - r (1 - b), which is ln a where t is 0, as for every word that occurs once.
    """

    def __init__(self, samples: int):
        self.samples, self.known = samples, {}
        self.allot(KNOWN)

    def allot(self, n: int):
        self.r, self.b, self.base = (np.zeros((n, self.samples), np.float32) for _ in range(3))
        self.keys = np.zeros(n, np.uint64)

    def rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > len(self.keys):
            self.known, new = {}, words
        if new:
            at, end = len(self.known), len(self.known) + len(new)
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in new), np.uint64, len(new))
            (r0, r1), (c0, c1), (b, _) = (uniforms(keys, self.samples, k) for k in range(3))
            self.keys[at:end] = keys
            self.r[at:end] = r = -np.log(r0 * r1)
            self.b[at:end] = b
            self.base[at:end] = np.log(-np.log(c0 * c1)) - r * (1 - b)
            self.known.update(zip(new, range(at, end), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def signature(self, text: str) -> np.ndarray:
        """16 bits per sample; all zero where a text has no words."""
        counts = Counter(text.split())
        if not counts:
            return np.zeros(self.samples, np.uint16)
        return self.of_weights(list(counts), np.fromiter(counts.values(), np.float32, len(counts)))

    def of_weights(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        best = np.full(self.samples, np.inf, np.float32)
        out, k = np.zeros(self.samples, np.uint64), np.arange(self.samples)
        for lo in range(0, len(words), 4096):
            row, weight = self.rows(words[lo: lo + 4096]), weights[lo: lo + 4096]
            once = row[weight == 1]
            more = row[weight != 1]
            found = []
            if len(once):
                log_a = self.base[once]
                least = log_a.argmin(0)
                found.append((log_a[least, k], self.keys[once[least]], np.zeros(self.samples, np.int64)))
            if len(more):
                r = self.r[more]
                t = np.floor(np.log(weight[weight != 1])[:, None] / r + self.b[more])
                log_a = self.base[more] - r * t
                least = log_a.argmin(0)
                found.append((log_a[least, k], self.keys[more[least]], t[least, k].astype(np.int64)))
            for value, key, t in found:
                chosen = mix(key + t.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 79)
                # ties between words are settled by the hash, so that their order hardly matters
                nearer = (value < best) | ((value == best) & (chosen < out))
                best, out = np.where(nearer, value, best), np.where(nearer, chosen, out)
        return np.maximum(out & np.uint64(0xFFFF), 1).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; texts without words are like each other and unlike all others."""
    return float((a == b).mean())


def fingerprint(docs: DataFrame, samples: int = 64) -> DataFrame:
    """``doc_id, fingerprint`` (hex, 16 bits a sample) of every text; a null text is empty."""
    schema = {"doc_id": pa.int64(), "fingerprint": pa.string()}

    def run(batches):
        sampler = Sampler(samples)
        for batch in batches:
            yield record(schema, doc_id=batch.column(0).to_pylist(),
                         fingerprint=[sampler.signature(t.as_py()).astype(">u2").tobytes().hex() for t in batch.column(1)])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string").withColumn("doc_id", given_id())


def with_next(docs: DataFrame) -> DataFrame:
    """``part, head, doc_id, text`` in parts ordered by descending doc_id: each part ends with a copy (``head``) of the
    document that follows its last one, the first of all after the last. Ids are dealt to parts of equal width."""
    spark, parts = docs.sparkSession, partitions(docs)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return docs.select(F.lit(0).alias("part"), F.lit(False).alias("head"), "doc_id", "text")
    width = max(1.0, (float(high) - float(low)) / parts)
    part = F.least(F.lit(parts - 1), F.floor((F.lit(float(high)) - F.col("doc_id").cast("double")) / F.lit(width)).cast("int"))
    placed = docs.withColumn("part", F.greatest(F.lit(0), part))
    # one row per part, as many as the shuffle has
    heads = sorted(placed.groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect())
    after = [(heads[(i + 1) % len(heads)].doc_id, heads[i].part) for i in range(len(heads))]
    extra = F.broadcast(spark.createDataFrame(after, "doc_id long, ends int"))
    joined = placed.join(extra, "doc_id", "left")
    return joined.select(
        F.explode(F.when(F.col("ends").isNull(), F.array(F.struct(F.col("part"), F.lit(False).alias("head")))).otherwise(
            F.array(F.struct(F.col("part"), F.lit(False).alias("head")), F.struct(F.col("ends").alias("part"), F.lit(True).alias("head"))))).alias("p"),
        "doc_id", "text").select("p.part", "p.head", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, samples: int = 64) -> DataFrame:
    """Every text beside its edited text (see the query) and the next document by descending doc_id.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts are
    empty, a null id counts as the least. Rows that repeat an id follow each other by text; a single document is its own next.
    """
    schema = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
              "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches):
        sampler = Sampler(samples)
        held = None
        for batch in batches:
            out = {k: [] for k in schema}
            for part, head, doc, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                part, head, doc, text = part.as_py(), head.as_py(), doc.as_py(), text.as_py()
                own = sampler.signature(text)
                if held and held[0] == part:
                    _, last, last_text, last_own = held
                    cut = len(last_text) // 3
                    edited = last_text[: len(last_text) - cut] + text[:cut]
                    other = sampler.signature(edited)
                    row = (last, len(last_text), hashlib.sha256(edited.encode()).hexdigest(), last_own.astype(">u2").tobytes().hex(),
                           other.astype(">u2").tobytes().hex(), likeness(last_own, other), likeness(last_own, own))
                    for k, v in zip(schema, row, strict=True):
                        out[k].append(v)
                held = None if head else (part, doc, text, own)
            yield record(schema, **out)

    rows = with_next(id_and_text(docs)).repartition(partitions(docs), "part")
    rows = rows.sortWithinPartitions("part", "head", F.desc("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                           "near_edited double, near_next double").withColumn("doc_id", given_id())
