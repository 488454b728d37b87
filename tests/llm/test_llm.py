import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import fingerprints, hosts, jaccard, lines, mixing, quality, substrings, suffixes, templates, tokens

SCHEMA = "doc_id long, text string, lang string, source string, bucket int, found string, node string, epoch int, key string, n int"


def rows_of(seed=3):
    """Null and empty texts, one very long, exact and near copies, shared passages, periodic texts, repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(200)] + ["É", "ñandú", "Über."]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))
    passage, base = text(45), text(120)
    out = [None, "", " \n ", "one two", "a b a b " * 90, "xyz" * 400, text(4000) + base, base, base, base + " end"]
    for _ in range(25):
        near = base.split(" ")
        near[r.randrange(len(near))] = "changed"
        out.append(" ".join(near) if r.random() < 0.5 else text(r.randint(5, 60)) + passage + text(r.randint(0, 80)))
    out = [(i, t) for i, t in enumerate(out)]
    return out + [out[7], out[4]]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None if i % 5 == 0 else "en", f"src{i % 3}", 1, "x", "y", 2, "z", 3)
                                  for i, (d, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return rows_of()


def unique(rows):
    return sorted(dict(rows).items())


def test_substrings(spark, rows):
    for size in (3, 20):
        got = substrings.kept_digest(substrings.substring_dedup(frame(spark, rows), size)).collect()
        assert sorted({tuple(r) for r in got}) == substrings.brute_force(unique(rows), size) and len(got) == len(rows)
    assert substrings.substring_dedup(frame(spark, rows).limit(0)).count() == 0


def test_suffixes(spark, rows, monkeypatch):
    for many in (2000, 1):  # the second deals contested groups out by windows
        monkeypatch.setattr(suffixes, "MANY", many)
        got = suffixes.suffix_dedup(frame(spark, rows), 100).withColumn("kept", F.sha2("kept", 256)).collect()
        assert sorted({tuple(r) for r in got}) == suffixes.brute_force(unique(rows), 100) and len(got) == len(rows)
    assert suffixes.suffix_dedup(frame(spark, rows).limit(0)).count() == 0


def test_suffix_order():
    data = b"banana bandana banana" * 3
    s = suffixes.Suffixes(data, 12)
    at = np.arange(len(data) - 12)
    order = s.sort(at, np.zeros(len(at), int))
    assert [data[i: i + 12] for i in at[order]] == sorted(data[i: i + 12] for i in at)


def test_token_codec():
    rng = np.random.default_rng(0)
    for n in (0, 1, 4095, 4096, 4097, 30_000):
        for values in (rng.integers(0, 49408, n), rng.integers(0, 2**63, n), np.where(rng.random(n) < 0.01, 2**62, rng.geometric(0.01, n))):
            words, first = tokens.encode(values)
            assert (tokens.decode(words, first, n) == values.astype(np.uint64)).all()
            assert (tokens.decode(words, first, n, n // 3, n // 2) == values[n // 3: n // 2].astype(np.uint64)).all()


def test_token_files(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    odd = rows + [(900, "a<|endoftext|>b \x1c q Ǆ ﬁ é　x İ Σ\x0b's a's")]
    plain, start, want = Tokenizer.from_file(path), 0, []
    for d, t in sorted(odd, key=lambda x: (x[0], x[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    folder = tokens.token_files(frame(spark, odd), path)
    assert sorted(map(tuple, tokens.read_token_files(spark, folder, with_ids=True).collect())) == want
    assert tokens.read_token_files(spark, tokens.token_files(frame(spark, odd).limit(0), path)).count() == 0


def test_each_word_is_encoded_once():
    """Words that repeat, whatever marks, case and white space are around them, go to the model once; ids are the tokenizer's own."""
    public = pytest.importorskip("public_tokenizers")
    encoder, asked = tokens.Encoder(public.path("word_bpe_49k.json")), collections.Counter()

    class Model:
        def __init__(self, model):
            self.model = model

        def tokenize(self, word):
            asked[word] += 1
            return self.model.tokenize(word)

    encoder.model = Model(encoder.model)
    rng, stems = random.Random(8), ["anblewh", "erenstö", "größe", "a", "zwölf", "çaÀé"]
    texts = ["".join(rng.choice("({\n \t\x0b#") + rng.choice([str.lower, str.upper, str.title])(rng.choice(stems)) + rng.choice([",", "&&&", " ", "\r9", "_", "-"])
                     for _ in range(50)) for _ in range(40)]
    odd = list("abAZéßÀÿ×÷ªµº'’<|>,.!&( 9\n\t\r\x1c\x85\xa0\x00\u0301\u0307\u0338İÅΣ\u212aŸǰ٢中") + ["<|endoftext|>", "<|STARTOFTEXT|>", "'s", "n't"]
    texts += ["".join(rng.choices(odd, k=rng.randint(0, 14))) for _ in range(3000)]
    ids, counts = encoder(texts)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert max(asked.values()) == 1 and asked["anblewh"] and asked["a"]
    assert [x.tolist() for x in encoder(texts[:3])][0] == sum(want[:3], [])
    encoder.cuts = False  # as for a tokenizer of another kind
    assert encoder(texts[:3])[0].tolist() == sum(want[:3], [])


def test_words_end_with_their_texts():
    """Texts lie one after the other as bytes: nothing is cut across their ends, and pieces that need the whole tokenizer keep their case."""
    public = pytest.importorskip("public_tokenizers")
    encoder = tokens.Encoder(public.path("word_bpe_49k.json"))
    texts = ["", "", "AB<", "|CD", "É", "é", "ab", "CD", "1", "23", "<|ENDOFTEXT|>", "X<|endoftext|>Y", "A×B", "÷", "it's", "IT'S", "Don", "'t", "", "ÀÖ×ØÞß ÿ",
             "a\tb's\x0bC d", "中", "文 x\r", "\u0301", "e", "!!", "!", " ", "\n", "ÉTÉ\n中É", ""]
    for some in (texts, texts[::-1], [""], ["", ""], []):
        ids, counts = encoder(some)
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


def test_known_words_take_less_time_than_a_regular_expression():
    """CPU time of texts whose words were met before, against cutting and looking up each word by itself (it took 1.6 times that, now half)."""
    public = pytest.importorskip("public_tokenizers")
    encoder, rng = tokens.Encoder(public.path("word_bpe_49k.json")), random.Random(4)
    stems = ["".join(rng.choices("abdeinorstÀö", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "", ",", ".\n"]) for _ in range(400)) for _ in range(250)]
    parts, numbers = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+|[0-9]").findall, collections.defaultdict(int)
    encoder(texts)

    def least(job):
        times = []
        for _ in range(3):
            begin = time.process_time()
            job()
            times.append(time.process_time() - begin)
        return min(times)

    assert least(lambda: encoder(texts)) < least(lambda: [list(map(numbers.__getitem__, parts(t.lower()))) for t in texts])


def shingles(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows, percent, k=4):
    """Least linked id of each id, by comparing all pairs."""
    sets = {d: shingles(t, k) for d, t in rows}
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return sets, label


@pytest.mark.parametrize(("percent", "large"), [(85, 20_000), (60, 3)])
def test_jaccard(spark, rows, monkeypatch, percent, large):
    monkeypatch.setattr(jaccard, "LARGE", large)  # the second cuts regions again
    sets, label = groups(unique(rows), percent)
    got = jaccard.jaccard_join(frame(spark, rows), 4, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), label[d]) for d, s in sets.items()}
    assert len(got) == len(rows)


def test_region_recursion():
    rng = np.random.default_rng(1)
    sets = []
    for c in range(12):
        base = rng.integers(0, 1 << 60, 120)
        for _ in range(25):
            sets.append(np.unique(np.concatenate([base[rng.random(120) > 0.06], rng.integers(0, 1 << 60, 4)])).astype(np.uint64))
    a, b = jaccard.Region(sets, 85).result()
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - k)}
    assert want and set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_fingerprints(spark, rows):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()}
    ids = sorted(dict(rows), reverse=True)
    texts = {d: t or "" for d, t in rows}
    for i, d in enumerate(ids):
        t, n = texts[d], texts[ids[(i + 1) % len(ids)]]
        if sum(x == d for x, _ in rows) == 1:
            m = len(t) // 3
            assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest() and got[d].n_chars == len(t)
    assert got[7].fingerprint == got[8].fingerprint and got[8].near_next == 1.0 and got[0].near_next in (0.0, 1.0)
    assert fingerprints.edited_fingerprints(frame(spark, rows).limit(0)).count() == 0
    assert fingerprints.edited_fingerprints(frame(spark, [(5, "alone here")])).first().near_next == 1.0


def test_collision_rate_is_weighted_jaccard():
    s = fingerprints.Sampler(2048)
    a, b = "x x x y y z w", "x x y y y z v"
    assert abs(fingerprints.likeness(s.signature(a), s.signature(b)) - 5 / 9) < 0.04


def test_quality(spark, rows):
    r = random.Random(5)
    good = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(150)]
    docs = [(i, t if i % 3 else t.upper() + " !!! ###") for i, t in enumerate(good)] + [(1000 + d, t) for d, t in rows]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)] + [(5, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(frame(spark, docs), labels).collect()
    assert len(got) == len(docs) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    held = [g for g in got if g.doc_id < 150 and g.held_out]
    assert held and all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert all(g.predicted == (g.doc_id % 3 > 0) for g in held)
    kept = quality.keep_good(frame(spark, docs), labels)
    assert kept.columns == frame(spark, docs).columns and {k.doc_id for k in kept.collect()} == {g.doc_id for g in got if g.predicted}
    assert {g.score for g in quality.score_quality(frame(spark, docs), labels.limit(0)).collect()} == {0.5}


def test_templates(spark, rows):
    item = "If Alice buys 12 apples for 30 cents then how many more apples does Alice need so that the basket of 12 kg holds twice the old weight"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "two words"), (4, "seven short words stand in this item")], "item_id long, text string")
    other = item.replace("Alice", "Bob").replace("12", "17").replace("30", "45")
    mixed = item.replace("Alice buys", "Bob buys").replace("12 apples", "17 apples")  # Alice and 12 stand for two values each
    docs = [(0, f"before it {item} after"), (1, f"start {other} end"), (2, f"start {mixed}"), (3, "so seven short words stand in this item too")]
    docs += [(100 + d, t) for d, t in rows]
    got = {r.doc_id: r for r in templates.find_leaks(frame(spark, docs), benchmark, share=0.9).collect()}
    assert got[0].item_ids == [1] and got[1].item_ids == [1] and got[3].item_ids == [4] and not got[2].contaminated
    assert sum(r.contaminated for r in got.values()) == 3
    kept = templates.drop_leaks(frame(spark, docs), benchmark, share=0.9)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in (0, 1, 3))
    assert not any(r.contaminated for r in templates.find_leaks(frame(spark, docs), benchmark.limit(0)).collect())


def test_mixing(spark, rows):
    docs = frame(spark, rows)
    plan_rows = mixing.mix_sources(docs, F.lit("d"), {"source": {"src1": 5}}, percent=60, epochs=3).collect()
    total = sum(len((t or "").split()) for _, t in rows)
    assert sum(r.taken_tokens for r in plan_rows) <= total * 0.6 + max(len((t or "").split()) for _, t in rows)
    assert sum(r.taken_tokens for r in plan_rows) >= total * 0.6 - 20
    assert {r.lang for r in plan_rows} <= {"(none)", "en"}
    whole = mixing.mix_documents(docs, F.lit("d"), {}, 60, 3, 7)
    assert whole.columns == docs.columns
    again = mixing.mix_sources(docs, F.lit("d"), {}, 60, 3, 7)
    assert collections.Counter(r.doc_id for r in whole.collect()) == collections.Counter(r.doc_id for r in again.collect())
    assert mixing.mix_sources(docs.limit(0), F.lit("d"), {}).count() == 0


def test_hosts(spark):
    link = '<a href="{}">x</a>'
    pages = [(1, "https://Spam.net/x?q", ""), (2, "http://a.b.example.NET/en/y", ""), (3, None, None), (4, "nothing", "x"),
             (5, "http://friend.com/1", link.format("//spam.net/") + link.format("http://spam.net/z")), (6, "http://friend.com/2#a", None),
             (7, "http://good.com", link.format("https://w.org/fr/1")), (8, "http://w.org/fr/1", link.format("http://good.com/")),
             (9, "http://www.example.com/de/a", ""), (10, "http://notnet/", ""), (8, "http://w.org/fr/1", "")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in hosts.judge_urls(df).collect()}
    rules = {k: (r.rule, r.verdict) for k, r in got.items()}
    assert rules[1] == ("net/", "block") and rules[2] == ("example.net/en/", "allow") and rules[8] == ("org/fr/", "allow")
    assert rules[9] == ("example.com/de/", "block") and rules[3] == rules[4] == (None, "allow") and (got[3].host, got[3].path) == ("", "")
    assert got[2].host == "a.b.example.net" and got[1].path == "/x" and rules[10] == (None, "allow")
    assert rules[5] == (None, "block") and got[5].distrust > got[5].trust  # it links to blocked pages only
    assert rules[7] == (None, "allow") and got[7].trust > 0
    assert hosts.judge_urls(df.limit(0)).count() == 0


def test_hub_mass_has_room(spark):
    """What flows through a hub that very many trusted hosts link to, times the grain, is beyond 64 bits."""
    seeds = spark.createDataFrame([("hub", 10**14), ("x", 7), ("y", 0)], "host string, seed long")
    edges = spark.createDataFrame([("hub", "x", 2), ("hub", "y", 1), ("x", "hub", 1)], "source string, target string, links long")
    got = {r.host: r.mass for r in hosts.propagate(seeds, edges, 15, 10**12).collect()}
    share = {("hub", "x"): 2 * hosts.GRAIN // 3, ("hub", "y"): hosts.GRAIN // 3, ("x", "hub"): hosts.GRAIN}
    start = {"hub": 10**14 * 15 // 100, "x": 1, "y": 0}
    mass, gain = start, None
    while gain is None or gain * 85 > 10**12 * 15:
        after = {h: start[h] + sum(mass[a] * s // hosts.GRAIN * 85 // 100 for (a, b), s in share.items() if b == h) for h in start}
        mass, gain = after, sum(after.values()) - sum(mass.values())
    assert got == mass


def test_lines(spark, rows):
    for length in (1, 2, 3, 5):
        seen, want = set(), []
        for d, t in unique(rows):
            x = t.split("\n") if t else []
            keep = [True] * len(x)
            for i in range(len(x) - length + 1):
                k = tuple(x[i: i + length])
                if "".join(k).strip(" "):
                    if k in seen:
                        keep[i: i + length] = [False] * length
                    seen.add(k)
            want.append((d, len(x), keep.count(False), "\n".join(a for a, b in zip(x, keep, strict=True) if b)))
        got = lines.line_dedup(frame(spark, rows), length).select("doc_id", "n_lines", "n_removed", "kept").collect()
        assert sorted({tuple(r) for r in got}) == want and len(got) == len(rows)
    assert lines.line_dedup(frame(spark, rows).limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.quality_classifier(spark, docs, folder)
    one = corpus_pipeline.near_duplicates(spark, good, folder)
    _, label = groups([(r.doc_id, r.text) for r in good.collect()], 80, 5)
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, least in label.items() if d == least)
    clean = corpus_pipeline.benchmark_decontamination(spark, one, folder)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in clean.collect()}
    assert {r.doc_id for r in one.collect() if not any(i in r.text for i in items)} == kept
    mixed = corpus_pipeline.mixing(spark, clean, folder)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= kept
    assert corpus_pipeline.run(spark, folder).count() == mixed.count()


def test_pipeline_near_duplicates(spark):
    """The stage against all pairs at 5 words and 0.8: two changed places keep 5-word similarity above it, not 4-word above 0.85."""
    import corpus_pipeline

    r = random.Random(11)
    texts = []
    for n in (60, 80, 100, 120):
        base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
        texts.append(base)
        for changes in (1, 2, 3, 4):
            other = list(base)
            for i in range(changes):
                other[i if i < 3 else n // 2] = f"changed{changes}x{i}"
            texts.append(other)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]

    def kept(k, percent):
        sets, label = {d: shingles(t, k) for d, t in docs}, {d: d for d, _ in docs}
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        while any(label[a] != label[b] for a, b in links):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return sorted(d for d, least in label.items() if d == least)

    assert kept(5, 80) != kept(4, 85)
    got = corpus_pipeline.near_duplicates(spark, frame(spark, docs), "")
    assert sorted(x.doc_id for x in got.collect()) == kept(5, 80)


def test_short_items(spark):
    items = ["What is the capital of France today", "hours Alice spent in Rome", "Blue Whale", "What costs 12 apples and 3 kg flour", "", "yes",
             "one two three four five six seven eight of Alice has 3 apples for Alice and 4 for all"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = ["quiz What is the capital of France today", "and 12 hours Alice spent in Rome", "a blue whale, swimming", "a whale blue",
            "quiz What costs 15 apples and 4 kg flour", "quiz How costs 15 apples and 4 kg flour", "Yes.", "yesterday",
            "Alice has 3 apples for Alice and 4 for all", "What is the capitol of Spain today"]
    got = {r.doc_id: r.item_ids for r in templates.find_leaks(frame(spark, list(enumerate(docs))), benchmark, share=0.5).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 3: [], 4: [3], 5: [], 6: [5], 7: [], 8: [6], 9: []}
    kept = templates.drop_leaks(frame(spark, list(enumerate(docs))), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 7, 9]


def test_hosts_far_apart(spark):
    """Distrust along a chain falls with each hop and does not come back where the rounds end; in a ring it is summed up."""
    link = '<a href="http://{}/">x</a>'
    pages = [(0, "http://spam.net/", "")] + [(k, f"http://h{k}.com/", link.format(f"h{k - 1}.com" if k > 1 else "spam.net")) for k in range(1, 15)]
    pages += [(20, "http://other.net/", ""), (21, "http://r1.com/", link.format("other.net") + link.format("r2.com")),
              (22, "http://r2.com/", link.format("r3.com")), (23, "http://r3.com/", link.format("r1.com"))]
    got = {r.page_id: r for r in hosts.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    limit, unit = hosts.UNIT * 15 * 50 // 10_000, 0.15 * hosts.UNIT
    for k in range(15):
        assert abs(got[k].distrust - unit * 0.85**k) <= limit / 1000
        assert got[k].verdict == ("block" if k <= 4 else "allow")
    for k, hops in ((21, 1), (23, 2), (22, 3)):  # distrust runs against the links
        assert abs(got[k].distrust - unit * 0.85**hops / (1 - 0.85**3)) <= limit / 1000
