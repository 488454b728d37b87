"""Token ids as files: Simple-8b words with escapes and per-block offsets, written and read by Spark.

File format, all integers little-endian 64 bit: a file is a run of segments. A segment is ``MAGIC, number of documents,
number of ids, number of words``, then the document ids, the number of ids of each document, the first word of each block
of ``BLOCK`` ids, and the words. The top 4 bits of a word are its selector, the other 60 its ids, lowest bits first.
Selector 15 is an escape: the next word holds one id as it is. Spark's text sink ends each segment with a line feed.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .common import LOWER, SPACE, given_id, id_and_text, partitions, record, release, slices, small_batches

MAGIC = int.from_bytes(b"S8BTOK01", "little")
BLOCK = 4096
ESCAPE = 15
#: fixed values: bits of each id by selector; selector 0 is not used
BITS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
COUNTS = [0, *(60 // b for b in BITS[1:])]
#: ids in a word and bits from one id to the next by selector, the escape included
PACKED, SHIFTS = np.array([*COUNTS, 1], np.int32), np.array([*BITS, 0], np.int32)
#: the least value that is too large for each selector from 1 on
LIMITS = np.array([1 << b for b in BITS[1:]], np.uint64)
#: ids in a segment before it is written, and segments in a file: a file is read as one value
SEGMENT, SEGMENTS = 500_000, 4
#: rows that go to Python at once
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: bytes of text whose words are held at once
PART = 1 << 18
#: kinds of bytes for the cut into words: white space, letters (those beyond ASCII begin with C3), marks, digits, all else
WHITE, LETTER, MARK, DIGIT, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[33:127] = MARK
KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xc0), 0xc3]] = LETTER
KINDS[48:58] = DIGIT
KINDS[SPACE], KINDS[ord("'")] = WHITE, OTHER


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``words`` and the first word of each block; every block starts a new word."""
    values = np.asarray(values, np.uint64)
    out, first, done = [], [], 0
    for a in range(0, len(values), 64 * BLOCK):
        part = values[a: a + 64 * BLOCK]
        n = len(part)
        need = np.zeros((-(-n // BLOCK), BLOCK), np.uint8)  # a row for each block; what lies after the last id needs nothing
        flat = need.reshape(-1)[:n]
        flat += 1
        for limit in LIMITS[LIMITS <= part.max()]:
            flat += part >= limit
        # the most that an id of a window needs, for longer and longer windows that end with their block; a selector
        # packs more than the next one, and where it fits the next one fits as well
        most, size, selector = need.copy(), 1, np.full(need.shape, ESCAPE, np.uint8)
        for s in range(14, 0, -1):
            step = COUNTS[s] - size
            if step:
                np.maximum(most[:, :-step], most[:, step:], out=most[:, :-step])
            size = COUNTS[s]
            selector -= most <= s
        selector = selector.reshape(-1)[:n]
        at = np.arange(n, dtype=np.int32)
        block_end = np.minimum((at // BLOCK + 1) * BLOCK, n)
        after = np.minimum(at + PACKED[selector], block_end)
        following = np.append(np.where(after < block_end, after, n), n)  # n: no further word in the block
        head, now = np.zeros(n + 1, bool), np.arange(0, n, BLOCK)
        while len(now):  # all blocks go from word to word together
            for _ in range(64):
                head[now] = True
                now = following[now]
            now = now[now < n]
        heads = np.flatnonzero(head[:n])
        selector, count = selector[heads], after[heads] - heads
        escaped = selector == ESCAPE
        place = np.cumsum(1 + escaped) - (1 + escaped)
        words = np.zeros(len(heads) + int(escaped.sum()), np.uint64)
        shift = (at - np.repeat(heads.astype(np.int32), count)) * np.repeat(SHIFTS[selector], count)
        held = np.bitwise_or.reduceat(part << shift.astype(np.uint64), heads)
        words[place + escaped] = held
        words[place] = selector.astype(np.uint64) << np.uint64(60) | np.where(escaped, np.uint64(0), held)
        first.append(place[np.searchsorted(heads, np.arange(0, n, BLOCK))] + done)
        out.append(words)
        done += len(words)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(first)


def decode(words: np.ndarray, first: np.ndarray, n: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The ids ``lo`` to ``hi`` of ``n``; only the blocks that hold them are read, all their words at once."""
    hi = n if hi is None else hi
    if lo >= hi:
        return np.zeros(0, np.uint64)
    b0, b1 = lo // BLOCK, -(-hi // BLOCK)
    ends = np.append(first, len(words))
    words = words[ends[b0]: ends[b1]]
    block = np.repeat(np.arange(b0, b1), np.diff(ends[b0: b1 + 1]))
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():  # a raw word may look like an escape
        if not raw[i]:
            raw[i + 1] = True
    live = ~raw
    count = np.array([*COUNTS, 1])[selector] * live
    size = np.minimum(BLOCK, n - np.arange(b0, b1) * BLOCK)
    # a block's last word may be filled in part
    before = np.cumsum(count) - count
    start_of_block = before[np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])]
    inner = before - start_of_block[block - b0]
    count = np.where(live, np.minimum(count, size[block - b0] - inner), 0)
    place = inner + (block - b0) * BLOCK
    out = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(selector[live]):
        own = np.flatnonzero(live & (selector == s))
        if s == ESCAPE:
            out[place[own]] = words[own + 1]
            continue
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            some = own[count[own] > k]
            out[place[some] + k] = (words[some] >> np.uint64(k * BITS[s])) & mask
    return out[lo - b0 * BLOCK: hi - b0 * BLOCK]


def segment(docs: list[int], counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = encode(ids)
    head = np.array([MAGIC, len(docs), len(ids), len(words)], np.int64)
    parts = [head, np.array(docs, np.int64), np.array(counts, np.int64), first.astype(np.int64), words]
    return b"".join(x.tobytes() for x in parts)


def ids_in_file(content: bytes) -> int:
    """Number of ids in a file, from the heads of its segments."""
    at = total = 0
    while at < len(content):
        _, n, ids, words = np.frombuffer(content, np.int64, 4, at).tolist()
        total += ids
        at += 32 + 8 * (2 * n - (-ids // BLOCK) + words) + 1
    return total


def segments(content: bytes):
    """``documents, counts, first words, words`` of each segment of a file."""
    at, content = 0, memoryview(content)
    while at < len(content):
        magic, n, ids, words = np.frombuffer(content, np.int64, 4, at).tolist()
        if magic != MAGIC:
            raise ValueError("not a token file")
        sizes = (n, n, -(-ids // BLOCK), words)
        at += 32
        out = []
        for k, size in enumerate(sizes):
            out.append(np.frombuffer(content, np.uint64 if k == 3 else np.int64, size, at))
            at += 8 * size
        if content[at: at + 1] != b"\n":
            raise ValueError("a segment does not end where it should")
        at += 1
        yield out


class Numbers(dict):
    """Numbers of strings; those asked for the first time get the next numbers and wait for their ids.

    The ids of the string with number k are ``ids[start[k]: start[k + 1]]``.
    """

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []
        self.ids, self.start = np.zeros(4096, np.uint32), np.zeros(1024, np.int64)

    def numbers(self, strings: list[str]) -> np.ndarray:
        """The numbers of strings that all differ."""
        found = np.fromiter(map(self.get, strings, itertools.repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(found < 0)
        found[new] = np.arange(len(self), len(self) + len(new))
        self.waiting = [strings[k] for k in new.tolist()]
        self.update(zip(self.waiting, found[new].tolist(), strict=True))
        return found

    def settle(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """The ids of all that wait, one after the other; both arrays double as they fill."""
        first, taken = len(self) - len(self.waiting), int(self.start[len(self) - len(self.waiting)])
        for name, n in (("ids", taken + len(ids)), ("start", len(self) + 1)):
            held = getattr(self, name)
            if n > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(len(held), n - len(held)), held.dtype)]))
        self.ids[taken: taken + len(ids)] = ids
        self.start[first + 1: len(self) + 1] = taken + np.cumsum(counts)
        self.waiting = []

    def look_up(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings with these numbers and how many each has."""
        start = self.start[at]
        count = self.start[at + 1] - start
        return self.ids[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())], count


class Encoder:
    """Ids of texts. Texts are cut into words, and each word is encoded once.

    That holds for a tokenizer that normalizes and splits as ``NORMALIZER`` and ``SPLIT`` say: it drops white space, never
    looks beyond it, and lets runs of letters end at marks. Any other encodes each text in one call. A word is a run of
    Latin letters in lower case or of ASCII marks, or a digit; the tokenizer hands its bytes to its model as they are, so
    the model gets it at once. A piece between spaces and line feeds is one word where more than that may matter: with an
    apostrophe (contractions), ``<|`` (special strings), control characters or anything but letters beyond ASCII. Such
    words are encoded as one string, if they are new, and told apart by the places of their ids.
    """

    NORMALIZER = {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

    def __init__(self, path: str, most: int = 300_000):
        import codecs
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.cuts = all(steps) and [json.loads(x.__getstate__()) for x in steps] == [self.NORMALIZER, self.SPLIT]
        table = [chr(k) for k in range(256)]
        for x in map(chr, (*range(0xdf, 0xf7), *range(0xf8, 0x100)) if self.cuts else ()):
            for byte, own in zip(x.encode(), "".join(y for y, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(x)), strict=True):
                table[byte] = own
        table = "".join(table)
        self.bytes = lambda text: codecs.charmap_decode(text.encode(), "strict", table)[0]
        self.most, self.words = most, Numbers()
        self.whole = re.compile(r"<\||['\x00-\x08\x0e-\x1f\x7f-\xbf\xd7\xf7\u0100-\U0010ffff]").search

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of texts whose bytes lie one after the other, and how many each text has."""
        raw = data.tobytes()
        kind = np.frombuffer(bytearray(raw.translate(KINDS.tobytes())), np.uint8)
        low = np.frombuffer(bytearray(raw.translate(LOWER.tobytes())), np.uint8)
        lead = np.flatnonzero(data[:-1] == 0xc3)
        after = data[lead + 1]
        sign = (after == 0x97) | (after == 0xb7)  # the signs of multiplication and division
        kind[lead[sign]] = OTHER
        low[lead[(after >= 0x80) & (after < 0x9f) & ~sign] + 1] += 32
        if b"<|" in raw:
            at = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
            kind[at[~np.isin(at + 1, bounds)]] = OTHER
        other = np.flatnonzero(kind == OTHER)
        if len(other):  # their pieces stay as they are
            gap = np.flatnonzero((data == ord(" ")) | (data == ord("\n")))
            start, end = np.union1d(gap + 1, bounds[:-1]), np.union1d(gap, bounds[1:])
            edge = np.zeros(len(data) + 1, np.int8)
            edge[np.unique(start[np.searchsorted(start, other, "right") - 1])] += 1
            edge[np.unique(end[np.searchsorted(end, other, "right")])] -= 1
            piece = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
            kind[piece], low[piece] = OTHER, data[piece]
        full = kind != WHITE
        head = kind == DIGIT
        head[1:] |= kind[1:] != kind[:-1]
        head[bounds[bounds < len(data)]] = True
        head &= full
        kept = low[full]
        offsets = np.append(np.flatnonzero(head[full]), len(kept)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        return words.dictionary_encode(), np.diff(np.searchsorted(np.flatnonzero(head), bounds))

    def settle(self) -> None:
        """Encode the words that wait."""
        new, model, ids, counts = self.words.waiting, self.model, [], []
        text = " ".join(new)
        rest = [word for word in new if self.whole(word)] if self.whole(text) else []
        if rest:
            coded = self.tokenizer.encode(" ".join(rest), add_special_tokens=False)
            rest_ids, place = coded.ids, np.array(coded.offsets, np.int64).reshape(-1, 2)[:, 0]
            ends = iter(np.searchsorted(place, np.cumsum([len(w) + 1 for w in rest])).tolist())
            rest, done = set(rest), 0
        for word, letters in zip(new, self.bytes(text).split(" "), strict=True):
            if word in rest:
                end = next(ends)
                own, done = rest_ids[done:end], end
            else:
                own = [x.id for x in model.tokenize(letters)]
            ids += own
            counts.append(len(own))
        self.words.settle(np.array(ids, np.uint32), np.array(counts, np.int64))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        parts = [text.encode() for text in texts]
        return self.of_bytes(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))

    def of_bytes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that lie one after the other in ``data``."""
        if not self.cuts:
            texts = [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            found = [self.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
            return np.array([x for ids in found for x in ids], np.uint32), np.array(list(map(len, found)), np.int64)
        if len(self.words) > self.most:
            self.words = Numbers()
        words, size = self.cut(data, bounds)
        at = self.words.numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        if self.words.waiting:
            self.settle()
        ids, count = self.words.look_up(at)
        return ids, np.diff(np.append(0, np.cumsum(count))[np.cumsum(size)], prepend=0)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> str:
    """Write the ids of all documents, each followed by ``end_id``, in ascending doc_id order; returns the folder.

    Files are ordered by name, segments within them by place. Spark's own sink writes them, so any file system that Spark
    reaches will do and a lost task's output never shows. Rows with equal ids are ordered by text; a null text is
    empty and a null id comes first. A document is never cut, so a segment holds at least one.
    """
    small_batches(docs.sparkSession)
    rows = id_and_text(docs)
    folder = folder or f"{checkpoint_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def write(batches):
        release()
        encode_texts = Encoder(tokenizer)
        release()
        docs, counts, held, n = [], [], [], 0

        def flush():
            value = segment(docs, np.concatenate(counts), np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

        for batch in batches:
            for a, b, data, bounds in slices(batch, PART):
                ids, count = encode_texts.of_bytes(data, bounds)
                docs += batch.column(0).slice(a, b - a).to_pylist()
                counts.append(count + 1)
                held.append(np.insert(ids, np.cumsum(count), end_id))
                n += len(held[-1])
                if n >= SEGMENT:
                    yield flush()
                    docs, counts, held, n = [], [], [], 0
                    release()
        if docs:
            yield flush()
        del encode_texts, docs, counts, held
        release()

    # each task learns its words anew, so tasks take twice the usual part
    ordered = rows.repartitionByRange(-(-partitions(rows) // 2), "doc_id").sortWithinPartitions("doc_id", "text")
    values = ordered.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    spark = docs.sparkSession
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(1000, int(before)) if int(before) > 0 else 1000))  # the texts of a task lie in memory bit by bit
    try:
        values.write.option("maxRecordsPerFile", SEGMENTS).text(folder)
    finally:
        spark.conf.set(BATCH, before)
    return folder


def read_token_files(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``)."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(folder)
    # part number, then the file's number within it; both by their place in the name, as folders and job ids may look alike
    numbers = (F.lpad(F.regexp_extract("path", name, 1), 9, "0") for name in (r"part-(\d+)-[^/]*$", r"-c(\d+)[^/-]*$"))
    order = F.concat_ws("-", *numbers)
    files = files.select(order.alias("file"), "content")
    schema = {"file": pa.string(), "inner": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    kind = "file string, inner long, doc_id long, n_tokens long, ids_crc32 long"
    if with_ids:
        schema["ids"], kind = pa.list_(pa.int32()), kind + ", ids array<int>"

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for docs, counts, first, words in segments(content.as_buffer()):
                    ends = np.cumsum(counts)
                    out = {k: [] for k in schema}
                    all_ids = decode(words, first, int(ends[-1]) if len(ends) else 0).astype("<u4")
                    for doc, n, end in zip(docs.tolist(), counts.tolist(), ends.tolist(), strict=True):
                        own = all_ids[end - n: end]
                        row = [file, before + end - n, doc, n, zlib.crc32(own.tobytes())] + ([own.astype(np.int32)] if with_ids else [])
                        for k, v in zip(schema, row, strict=True):
                            out[k].append(v)
                    before += int(ends[-1]) if len(ends) else 0
                    yield record(schema, **out)
        release()

    def measure(batches):
        for batch in batches:
            sizes = [ids_in_file(content.as_buffer()) for content in batch.column(1)]
            yield record({"file": pa.string(), "size": pa.int64()}, file=batch.column(0), size=sizes)

    rows = files.mapInArrow(read, kind)
    # where each file starts: one row per file is summed along their order
    sizes = files.mapInArrow(measure, "file string, size long")
    begins = sizes.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("begin"))
    rest = ["n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    return rows.join(begins, "file").select(given_id(), (F.col("begin") + F.col("inner")).alias("start"), *rest)
