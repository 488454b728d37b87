"""Cases that broke earlier versions: built words, weak classes, rows without id, executors without the package."""

from __future__ import annotations

import hashlib
import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalmill.llm import jaccard, lines, substrings, suffixes, templates
from signalmill.llm.common import BATCH_BYTES, BYTES
from tests.llm.test_llm import frame, groups, shingles

SF = "/root/testdata/sf0.001"


def built_word(bits: int) -> tuple[str, str]:
    """A word of ``a`` and ``b`` by the parity of its places' bits, and its complement."""
    parity = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity)


def test_built_words_differ(spark):
    one, other = built_word(11)
    common = [f"w{i}" for i in range(20)]
    docs = [(1, " ".join([*common[:10], one, *common[10:]])), (2, " ".join([*common[:10], other, *common[10:]]))]
    removed = {r.doc_id: r.n_removed for r in substrings.substring_dedup(frame(spark, docs)).collect()}
    assert removed == {1: 0, 2: 0}
    sets, label = groups(docs, 85)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(frame(spark, docs)).collect()} == label == {1: 1, 2: 2}


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for trial in range(400):
        n = int(rng.integers(1, 12 if trial % 2 else 150))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        own = np.unique(a)
        gone = int(rng.integers(0, (100 - percent) * n // 100 + 1))
        most = (100 * (len(own) - gone)) // percent - len(own)  # new elements that keep the link
        b = np.unique(np.concatenate([own[gone:], rng.integers(0, 1 << 62, max(0, most)).astype(np.uint64)]))
        both = len(np.intersect1d(own, b))
        assert 100 * both >= percent * (len(own) + len(b) - both)
        for level in (0, 1):
            rings = jaccard.Rings(percent)
            assert len(np.intersect1d(jaccard.signatures(own, rings, level), jaccard.signatures(b, rings, level)))


def test_small_sets_in_few_classes_share_a_signature():
    """Sets whose shingles fall into few classes: where empty classes are all that agree, single shingles must."""
    rng = np.random.default_rng(5)
    lone = 0
    for _ in range(3000):
        n = int(rng.integers(3, 9))
        pool = rng.integers(0, 1 << 62, n + 1).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[1:])
        if 100 * (n - 1) < 60 * (n + 1):
            continue
        rings = jaccard.Rings(60)
        x, y = jaccard.signatures(a, rings, 0), jaccard.signatures(b, rings, 0)
        lone += len(x) != len(y)
        assert len(np.intersect1d(x, y))
    assert lone


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (5, 60)])
def test_join_of_documents_with_pivots(spark, monkeypatch, words, percent):
    """The given documents and families of edited copies against all pairs; small leaves let pivots and windows work."""
    rng = random.Random(words)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + i, f"unrelated line {i} " + " ".join(rng.choices("red green blue ash oak elm".split(), k=40))) for i in range(40)]
    base = max((t for _, t in rows if t), key=len).split()[:150]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9)}"
        rows.append((20_000 + i, " ".join(copy)))
    monkeypatch.setattr(jaccard, "LEAF", 4)
    sets, label = groups(rows, percent, words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(frame(spark, rows), words, percent).collect()}
    assert got == {d: (len(s), label[d]) for d, s in sets.items()}


def test_regions_hold_related_documents(spark):
    """Unrelated documents do not meet: no region of the given documents goes beyond a few of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sizes = [r["count"] for r in jaccard.regions(docs, 5, 80, 0).groupBy("region").count().collect()]
    assert sizes and max(sizes) < 0.05 * docs.count()


@pytest.mark.parametrize("buckets", [8, 64])
def test_edges_do_not_grow_with_buckets(buckets):
    """Families of near copies meet in most buckets; what becomes rows stays near one edge for each set, and connects the same."""
    rng = random.Random(5)
    texts = []
    for family in range(5):
        base = [f"f{family}w{i}" for i in range(200)]
        for _ in range(60):
            copy = list(base)
            for _ in range(6):
                copy[rng.randrange(200)] = f"x{rng.randrange(1 << 30)}"
            texts.append(" ".join(copy))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    packed = sorted((r for x in jaccard.packer(4, 85, buckets, 0)([batch]) for r in x.to_pylist()), key=lambda r: r["bucket"])
    packed = [pa.RecordBatch.from_pylist([r], pa.schema(jaccard.PACKED)) for r in packed]
    every = {(e["a"], e["b"]) for x in jaccard.agreeing(packed) for e in x.to_pylist()}
    schema, source, rows = pa.schema([("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]), jaccard.agreeing, packed
    for parts in (buckets // 8, 1):
        told = sorted((r for x in jaccard.edge_packer(source, parts)(rows) for r in x.to_pylist()), key=lambda r: r["part"])
        source, rows = jaccard.spanning, [pa.RecordBatch.from_pylist([r], schema) for r in told]
    found = [(e["a"], e["b"]) for x in jaccard.spanning(rows) for e in x.to_pylist()]

    def connected(edges):
        names = sorted({x for e in edges for x in e})
        at = {x: i for i, x in enumerate(names)}
        label = jaccard.least_labels(np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]), len(names))
        return dict(zip(names, label.tolist(), strict=True))

    assert connected(sorted(every)) == connected(found) and len(connected(found)) == len(texts)
    assert len(found) == len(texts) - 5 and (buckets < 64 or len(every) > 4 * len(texts))


def test_rows_without_id_join(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(None, text), (5, text), (6, "something else of its own altogether"), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(frame(spark, docs)).collect()), key=str)
    assert got == sorted([(None, None, None, 1), (5, None, None, 1), (6, 6, 6, 0), (None, None, None, 0)], key=str)
    assert jaccard.jaccard_join(frame(spark, docs).limit(0)).count() == 0


def test_near_duplicates_stage_odd_rows(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, text, "y"), (3, None, "y"), (4, "", "y"), (None, "a b", "z"), (None, "a b", "z")],
                                 "doc_id long, text string, n_shingles string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == [(1, text), (3, None), (4, "")]
    assert [r.text for r in got.collect() if r.doc_id is None] == ["a b"]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_benchmark_items_of_any_id(spark):
    benchmark = spark.createDataFrame([("q-1", "one two three four five six seven eight nine"), ("q-2", None)], "item_id string, text string")
    items = templates.block_items(templates.blocks(benchmark)[0], 8, 3, 4)
    assert b"signalmill" not in pickle.dumps(items.value)  # executors need no copy of the package
    docs = [(1, "say one two three four five six seven eight nine again"), (2, None), (3, "one two three")]
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in templates.find_leaks(frame(spark, docs), benchmark).collect()}
    assert got == {1: (True, ["q-1"]), 2: (False, []), 3: (False, [])}
    assert templates.find_leaks(frame(spark, docs).limit(0), benchmark).count() == 0
    assert templates.drop_leaks(frame(spark, docs), benchmark.limit(0)).count() == 3


def test_shingles_helper():
    assert len(shingles("a b c d e", 4)) == 2


def by_place(rows):
    """Different texts of an id in the order of their digests, numbered as documents of their own."""
    texts = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest()))
    return texts, list(enumerate(t for _, t in texts))


def test_texts_that_share_an_id(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage, base = line(60), "\n".join(line(12) for _ in range(9))
    rows = [(1, passage), (2, base + passage), (2, "short"), (2, "short"), (3, base), (3, passage + " x " + passage), (3, None), (4, base)]
    rows += [(5, f"{line(25)}\n{passage if i % 2 else line(30)}\n{base}") for i in range(12)] + [(6, line(400)), (6, line(300) + " " + passage)]
    texts, plain = by_place(rows)
    ids = [d for d, _ in texts]

    def same(got, want):
        assert len(got) == len(rows)
        assert sorted({tuple(r) for r in got}) == sorted({(ids[w[0]], *w[1:]) for w in want})

    docs = frame(spark, rows)
    same(substrings.kept_digest(substrings.substring_dedup(docs, 20)).collect(), substrings.brute_force(plain, 20))
    same(suffixes.suffix_dedup(docs, 100).withColumn("kept", F.sha2("kept", 256)).collect(), suffixes.brute_force(plain, 100))
    same(lines.line_dedup(docs, 3, 200, True).select("doc_id", "n_lines", "n_removed", "kept").collect(), runs_that_count(plain, 3, 200, True))


def runs_that_count(rows, length, chars, copies):
    """Every run of ``length`` lines with some text or of fewer lines with ``chars`` characters, by plain comparison."""
    seen, whole, want = set(), set(), []
    for d, t in rows:
        x = t.split("\n") if t else []
        size = [len(a.strip(" ")) for a in x]
        keep = [True] * len(x)
        for i in range(len(x)):
            for j in range(i + 1, min(i + length, len(x)) + 1):
                run = tuple(x[i:j])
                if run in seen and sum(size[i:j]) >= (1 if j - i == length else chars):
                    keep[i:j] = [False] * (j - i)
                seen.add(run)
        if copies and any(size):
            if t in whole:
                keep = [False] * len(x)
            whole.add(t)
        want.append((d, len(x), keep.count(False), "\n".join(a for a, b in zip(x, keep, strict=True) if b)))
    return want


@pytest.mark.parametrize(("length", "chars", "copies"), [(3, 12, True), (3, 25, False), (5, 18, True), (4, 1, False), (1, 9, True)])
def test_runs_of_any_number_of_lines(spark, length, chars, copies):
    rng = random.Random(length * chars)
    pool = [f"line {i} " + "x" * rng.randrange(9) for i in range(12)] + ["", "", " ", "  ", "   "]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for d in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n\n"), (204, "one"), (205, "one"), (206, "one\ntwo"), (207, "one\ntwo"), (208, "x one")]
    got = lines.line_dedup(frame(spark, rows), length, chars, copies).select("doc_id", "n_lines", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == runs_that_count(rows, length, chars, copies)


def largest_batch(docs) -> int:
    """Bytes of text in the largest batch that a task of this session gets."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, batch.column(1).to_pylist()))], pa.int64())], ["n"])

    return docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("step", ["quality", "jaccard", "templates", "tokens"])
def test_tasks_get_few_bytes_at_once(spark, step):
    from signalmill.llm import quality, tokens

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.format_string("w%d %s", "id", F.expr("repeat('x', 1000)")).alias("text")).coalesce(1)
    few, labels = docs.limit(20), docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    benchmark = spark.createDataFrame([(1, "some words that are nowhere")], "item_id long, text string")
    run = {"quality": lambda: quality.keep_good(few, labels), "jaccard": lambda: jaccard.jaccard_join(few),
           "templates": lambda: templates.drop_leaks(few, benchmark), "tokens": lambda: tokens.read_token_files(spark, spark_folder(few))}

    def spark_folder(rows):
        import public_tokenizers

        return tokens.token_files(rows, public_tokenizers.path("word_bpe_49k.json"))

    spark.conf.unset(BYTES)
    try:
        assert run[step]().count() <= 20
        assert largest_batch(docs) < 2 * BATCH_BYTES
        spark.conf.set(BYTES, str(1 << 30))  # a number that the session names itself stays
        run[step]().count()
        assert spark.conf.get(BYTES) == str(1 << 30)
    finally:
        spark.conf.unset(BYTES)


def test_features_of_a_long_batch_take_little_memory():
    """They are made piece by piece, and are those of each text by itself."""
    import tracemalloc

    from signalmill.llm.quality import Features

    rng = random.Random(3)
    texts = [" ".join(rng.choices(["One", "two", "$3", "four;", "a|b", "x\ny"], k=400)) for _ in range(1500)]
    texts[7:9] = ["", "word " * 60_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    make = Features()
    tracemalloc.start()
    try:
        found = make(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 << 20
    assert np.array_equal(found, np.concatenate([make(batch.slice(k, 1)) for k in range(len(texts))]))


def test_token_files_hold_few_segments(spark, monkeypatch, tmp_path):
    """Many files for a task, in a folder whose name has what numbers a file: each counts once, in its place."""
    import public_tokenizers

    from signalmill.llm import tokens

    monkeypatch.setattr(tokens, "SEGMENT", 60)
    monkeypatch.setattr(tokens, "PART", 200)
    docs = [(k, f"text number {k} " + "and more words " * (k % 9)) for k in range(600)]
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = tokens.token_files(frame(spark, docs), path, folder=f"{tmp_path}/part-7-c12")
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect()]
    count = [len(list(tokens.segments(x))) for x in files]
    assert sum(count) > 30 and max(count) <= 4
    encoder, at = tokens.Encoder(path), 0
    rows = tokens.read_token_files(spark, folder, with_ids=True).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(600))
    for row in rows:
        ids = [*encoder([docs[row.doc_id][1]])[0].tolist(), 1]
        assert (row.start, row.n_tokens, row.ids) == (at, len(ids), ids)
        at += len(ids)
