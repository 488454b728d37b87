"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

Every feature has a lookup table over its bins, every chosen pair of features one over a grid of coarser bins; a score is
the logistic of the sum of the looked-up values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, buffers, byte_values, given_id, id_and_text, record, release, small_batches, word_hashes

FEATURES = ("log_words", "word_length", "upper", "symbols", "bars", "digits", "stops", "repeats", "distinct", "line_breaks", "letters")


def byte_classes() -> np.ndarray:
    """Upper case, lower case and other letters, digits, symbols, bars, stops, line breaks, white space."""
    out = np.full(256, 4, np.uint8)
    out[65:91], out[97:123], out[128:], out[48:58] = 0, 1, 2, 3
    out[list(b"|")], out[list(b".,;:?'\"()-")], out[10], out[[9, 11, 12, 13, 32]] = 5, 6, 7, 8
    return out


class Features:
    """The features of every text of a batch, in a table with one row per text."""

    def __init__(self):
        self.values, self.classes = byte_values(), byte_classes()

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        """``batch``: any first column, then the texts (null: empty)."""
        out = [np.zeros((0, len(FEATURES)))]
        for ids, data, bounds in buffers(batch, PIECE):
            n = len(ids)
            words, before = word_hashes(data, bounds, self.values)
            owner = np.repeat(np.arange(n) * 9, np.diff(bounds))
            count = np.bincount(owner + self.classes[data], minlength=9 * n).reshape(n, 9).astype(float)
            total = np.diff(before).astype(float)
            same = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
            again = np.concatenate([[0], np.cumsum(same)])
            distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(before[:-1], before[1:], strict=True)], float)
            full, many = np.maximum(count[:, :7].sum(1), 1), np.maximum(total, 1)
            inner = np.minimum(before[:-1] + 1, before[1:])
            letters = count[:, :3].sum(1)
            out.append(np.stack([
                np.log1p(total), full / many, count[:, 0] / np.maximum(letters, 1), count[:, 4] / full, count[:, 5] / many,
                count[:, 3] / full, count[:, 6] / many, (again[before[1:]] - again[inner]) / many, distinct / many,
                count[:, 7] / many, letters / full], 1))
        return np.concatenate(out)


class AdditiveModel:
    """``base``, bin edges and tables of single features, and tables of pairs of features over every ``coarse``-th edge."""

    def __init__(self, bins: int = 32, coarse: int = 4, rounds: int = 150, pairs: int = 4, rate: float = 0.15, leaf: float = 5.0):
        self.bins, self.coarse, self.rounds, self.most_pairs, self.rate, self.leaf = bins, coarse, rounds, pairs, rate, leaf

    def place(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], grid)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        mean = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        self.base = float(np.log(mean / (1 - mean)))
        if not len(y) or y.min() == y.max():
            return self
        at, f = self.place(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                g, h = self.slopes(f, y)
                step = self.rate * self.tree(np.bincount(at[:, j], g, len(table)), np.bincount(at[:, j], h, len(table)), 2)
                table += step
                f += step[at[:, j]]
        wide = at // self.coarse
        width = wide.max(0) + 1
        g, h = self.slopes(f, y)
        gain = {}
        for i in range(x.shape[1]):
            for j in range(i):
                gain[i, j] = self.quarters(*self.cells(wide, i, j, width, g, h))[0]
        for i, j in sorted(gain, key=lambda k: (-gain[k], k))[: self.most_pairs]:
            self.pairs.append((i, j, np.zeros((len(self.tables[i]) // self.coarse + 1, len(self.tables[j]) // self.coarse + 1))))
        for _ in range(self.rounds // 3):
            for i, j, table in self.pairs:
                g, h = self.slopes(f, y)
                step = np.zeros_like(table)
                step[: width[i], : width[j]] = self.rate * self.quarters(*self.cells(wide, i, j, width, g, h))[1]
                table += step
                f += step[wide[:, i], wide[:, j]]
        return self

    @staticmethod
    def slopes(f, y):
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    def tree(self, g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
        """Values of the bins by a tree of that depth over their order."""
        value = np.full(len(g), g.sum() / (h.sum() + 1.0))
        if depth and len(g) > 1:
            gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = np.where((hl > self.leaf / 4) & (hr > self.leaf / 4), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1)
            k = int(gain.argmax())
            if gain[k] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
                value[: k + 1], value[k + 1:] = self.tree(g[: k + 1], h[: k + 1], depth - 1), self.tree(g[k + 1:], h[k + 1:], depth - 1)
        return value

    @staticmethod
    def cells(wide, i, j, width, g, h):
        key = wide[:, i] * width[j] + wide[:, j]
        return tuple(np.bincount(key, v, width[i] * width[j]).reshape(width[i], width[j]) for v in (g, h))

    def quarters(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Best gain of one cut on each axis, and the values of the cells under it."""
        cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
        total = g.sum() ** 2 / (h.sum() + 1)
        if min(g.shape) < 2:
            return 0.0, np.zeros(g.shape)

        def parts(c):
            a = c[:-1, :-1]
            b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
            return a, b, d, c[-1, -1] - a - b - d

        pg, ph = parts(cg), parts(ch)
        gain = sum(x**2 / (w + 1) for x, w in zip(pg, ph, strict=True)) - total
        r, c = np.unravel_index(int(gain.argmax()), gain.shape)
        value = np.zeros(g.shape)
        for x, w, rows, cols in zip(pg, ph, (slice(0, r + 1), slice(0, r + 1), slice(r + 1, None), slice(r + 1, None)),
                                    (slice(0, c + 1), slice(c + 1, None), slice(0, c + 1), slice(c + 1, None)), strict=True):
            value[rows, cols] = x[r, c] / (w[r, c] + 1)
        return float(gain[r, c]), value

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.place(x)
        f = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            f += table[at[:, j]]
        for i, j, table in self.pairs:
            f += table[at[:, i] // self.coarse, at[:, j] // self.coarse]
        return 1 / (1 + np.exp(-f))


def fold(folds: int = 5):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, folds: int = 5) -> AdditiveModel:
    """Learn ``quality`` from at most ``most_rows`` labelled rows (those with the least hashes) outside the held-out fold.

    Labels that are null are left out, as are labels without a document. That bound is what makes the sample small
    enough to be sent to every task and its features to be learned from on the driver.
    """
    small_batches(docs.sparkSession)
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good"))
    known = known.where(fold(folds) != 0).dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(most_rows)
    rows = id_and_text(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "good")
    names = [f"f{i}" for i in range(len(FEATURES))]
    schema = {"doc_id": pa.int64(), "good": pa.bool_()} | {n: pa.float64() for n in names}

    def run(batches):
        make = Features()
        for batch in batches:
            x = make(batch)
            yield record(schema, doc_id=batch.column(0), good=batch.column(2), **{n: x[:, i] for i, n in enumerate(names)})
        release()

    found = sorted(rows.mapInArrow(run, "doc_id long, good boolean, " + ", ".join(f"{n} double" for n in names)).collect())
    x = np.array([r[2:] for r in found], float).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, np.array([r.good for r in found], float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, empty texts too; without labels of both kinds the score is the base rate.

    Labels, language, source and id never enter a score. Rows that repeat an id are scored each by its own text; a null
    text is empty and a null id is not held out.
    """
    model = fit_quality(docs, labels, most_rows)

    def run(batches):
        make, schema = Features(), {"doc_id": pa.int64(), "score": pa.float64()}
        for batch in batches:
            yield record(schema, doc_id=batch.column(0), score=model.score(make(batch)))
        release()

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double").select(given_id(), "score")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts score ``threshold`` or more."""
    model, at = fit_quality(docs, labels, most_rows), docs.columns.index("text")

    def run(batches):
        make = Features()
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            good = model.score(make(pa.RecordBatch.from_arrays([texts, texts], ["id", "text"]))) >= threshold
            yield batch.filter(pa.array(good))
        release()

    return docs.mapInArrow(run, docs.schema)
