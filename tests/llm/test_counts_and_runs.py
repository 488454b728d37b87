"""Token counts, filter orders and periodic runs against plain Python."""
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import filter_audit, periodic, queries, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n int, words int, part string, fails string, digest int, runs string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    """Null ids and texts, empty texts, repeated rows, one id with two texts, equal texts in two parts, periods, one long text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(150)] + ["É", "Über.", "$5", "A|B", "日本"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", "\n", "  "]) for _ in range(n))
    rows = [(None, "x y z"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "a " * 200), (5, text(30)), (5, text(70)), (6, text(80) + "q w e " * 30)]
    rows += [(7, rows[8][1]), (7, rows[8][1]), (8, "HELLO WORLD " * 3), (9, "l’été <|endoftext|> 12 ٣ ՘ \U000323b0a"), (10, text(160_000))]
    rows += [(11, text(40) + "p q " * 20 + text(3) + "q p " * 20), (12, "b a " * 12), (13, "b a " * 11 + "b"), (14, "é " * 23), (15, "é " * 24)]
    rows += [(20 + i, text(r.randint(1, 90))) for i in range(40)]
    return [(d, t, "xx", [None, "", "s1", "s2"][i % 4], 1, 2, "p", "f", 3, "r") for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def order_of(row):
    return tuple((x is not None, x) for x in row)


def test_token_counts(spark, rows, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    want = [(d, len((t or "").encode()), n := len(plain.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, *_ in rows]
    got = [tuple(r) for r in token_counts.token_counts(docs, path).collect()]
    assert sorted(got, key=order_of) == sorted(want, key=order_of)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, public.path("word_bpe_49k.json")).count()


def test_token_counts_of_odd_strings():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    with open(path, "rb") as file:
        counter = token_counts.Counter(file.read(), token_counts.newest_letters(), most=300)
    r = random.Random(1)
    parts = ["a", "b", "'s", "'T", " ", "  ", "\n", "\t", "é", "日", "1", "٣", "<|endoftext|>", "<|end", "　", "\x1c", "\x85", "😀", "̈", "_",
             "aaaa", "the ", "՘", "꟎", "\U000105c0", "zzzzz" * 40]
    for _ in range(1500):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 50)))
        assert counter(s) == len(plain.encode(s, add_special_tokens=False).ids), s
        pieces = [p for own in counter.special.split(s) for p in counter.parts(own, 5)]
        assert "<|endoftext|>".join("".join(counter.parts(own, 5)) for own in counter.special.split(s)) == s
        if not counter.newest.search(s):
            assert sum(len(counter.pieces.findall(p)) for p in pieces) == sum(len(counter.pieces.findall(o)) for o in counter.special.split(s))
    # merging does not ask for pairs in order of place
    merges = token_counts.Merges([("b", "c"), ("a", "b"), ("a", "bc"), ("abc", "abc")])
    assert [merges.count(x) for x in (b"", b"a", b"ab", b"abc", b"abcabc", b"aabc", b"bcbc")] == [0, 1, 1, 1, 1, 2, 2]


def audit_plainly(rows, labels):
    texts = [(d, t or "", s or "") for d, t, _, s, *_ in rows]
    least = {}
    rank = lambda d: (d is not None, d or 0)
    for d, t, _ in texts:
        least[t] = min(least.get(t, rank(d)), rank(d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    failing = []
    for d, t, s in texts:
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": rank(d) > least[t]}
        failing.append((s, {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part in {s for _, _, s in texts}:
        own = [x for x in failing if x[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                done = set(order[: step - 1])
                removed = [x for x in own if letter in x[1] and not done & x[1]]
                share[letter] += len(removed)
                found.append((part, "".join(order), step, sum(not (done | {letter}) & x[1] for x in own), len(removed),
                              sum(letter in x[1] and bool(done & x[1]) for x in own), sum(x[1] == {letter} for x in own),
                              sum(x[2] for x in removed), sum(x[3] for x in removed)))
        out += [(*f, share[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def test_filter_audit(spark, rows, docs):
    ids = [d for d, *_ in rows]
    labels = [(d, i % 2, int(i % 3 == 0), "x") for i, d in enumerate(ids[:40])] + [(5, 0, 1, "y"), (999, 1, 1, "z"), (8, None, None, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, source string")
    got = filter_audit.audit_filters(docs, known)
    assert sorted(map(tuple, got.collect())) == audit_plainly(rows, [x[:3] for x in labels])
    assert filter_audit.audit_filters(docs.limit(0), known).count() == 0
    bare = filter_audit.audit_filters(docs, known.limit(0))
    assert sorted(map(tuple, bare.collect())) == audit_plainly(rows, [])
    # other filters, another part
    two = filter_audit.audit_filters(docs, known, {"X": "size(words) > 3"}, repeat="Y", part="lang")
    assert two.count() == 4 and two.where("step = 1").agg(F.min(F.col("kept") + F.col("removed"))).first()[0] == len(rows)


def plain_runs(w, least, times):
    n, best = len(w), {}
    for q in range(n // times, 0, -1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(least, times * q):
                best[s, e + q - s] = q
            s = e + 1
    return sorted((s, size, q) for (s, size), q in best.items())


def collapsed(w, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs(spark, rows, docs):
    short = [r for r in rows if r[0] != 10]
    for least, times in ((24, 3), (4, 2)):
        got = periodic.periodic_runs(docs.where("doc_id IS NULL OR doc_id <> 10"), least, times).collect()
        want = []
        for d, t, *_ in short:
            w = WORD.findall(t or "")
            runs = plain_runs(w, least, times)
            want.append((d, len(w), tuple(runs), collapsed(w, runs)))
        assert sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got), key=order_of) == sorted(want, key=order_of)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    long = periodic.periodic_runs(docs.where("doc_id = 10")).collect()
    assert len(long) == 1 and long[0].collapsed == " ".join(WORD.findall(dict((r[0], r[1]) for r in rows)[10]))


@pytest.mark.parametrize("prime", [(1 << 31) - 1, 101])  # the second makes hashes of different words agree
def test_runs_of_random_words(monkeypatch, prime):
    monkeypatch.setattr(periodic, "PRIME", prime)
    r = random.Random(prime)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 5)):
            w = [r.randrange(r.choice([1, 2, 9])) for _ in range(r.randint(0, 90))]
            if len(w) > 5:
                a = r.randrange(len(w))
                p = r.randint(1, max(1, (len(w) - a) // 3))
                for i in range(a, len(w)):
                    w[i] = w[a + (i - a) % p]
            texts.append(texts[-1] + w if texts and r.random() < 0.3 else w)
        bounds = np.concatenate([[0], np.cumsum(list(map(len, texts)))]).astype(np.int64)
        word = np.array([x for t in texts for x in t], np.int64)
        d, s, e, p = periodic.find_runs(word, bounds, 6, 2)
        want = [(i, a, size, q) for i, t in enumerate(texts) for a, size, q in plain_runs(t, 6, 2)]
        assert list(zip(d.tolist(), (s - bounds[d]).tolist(), (e - s).tolist(), p.tolist(), strict=True)) == want


def periodic_end(d, w):
    h = zlib.crc32(str(d).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_query(spark):
    folder = "/root/testdata/sf0.001"
    want = []
    for d, t in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        w = periodic_end(d, WORD.findall(t or ""))
        if len(w) > 3000:
            continue
        runs = plain_runs(w, 24, 3)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), collapsed(w, runs))]
        want.append((d, len(runs), *best, best[1] and 1000 * best[1] // best[2], *digest))
    got = queries.QUERIES["op13_periodic_runs"](spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r[0]: tuple(r) for r in got.collect()}
    assert len(want) > 150 and sum(x[1] for x in want) > 5
    assert [got[x[0]] for x in want] == want


def test_strongest_is_exact(spark):
    runs = [[(5, 10, 3), (9, 20, 6)], [(0, 3, 3), (2, 10, 3), (3, 7, 2), (4, 70, 20)], [(7, 3_000_000_001, 3), (9, 3_000_000_000, 3)], []]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(runs)], "i int, runs array<struct<start: long, length: long, period: long>>")
    got = rows.select("i", periodic.strongest("runs").alias("b")).orderBy("i").collect()
    assert [r.b and tuple(r.b) for r in got] == [(5, 10, 3), (3, 7, 2), (7, 3_000_000_001, 3), None]
