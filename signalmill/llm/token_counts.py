"""Token counts by byte-pair merging, without making the tokens.

A text's pieces are counted one by one: the bytes of a piece are its first symbols, a heap gives the adjacent pair of the
lowest rank, a linked list joins it, and the count is the number of symbols less the number of merges. Counts of pieces are
kept per task, so a piece is merged once. The rows are never shuffled.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, record

#: fixed value: the pieces that byte-level vocabularies of this kind split a text into
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pieces whose counts a task holds before it starts anew
MOST = 500_000
COUNTED = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64()}


def byte_symbols() -> list[str]:
    """The character that stands for each byte: visible characters of Latin-1 for themselves, the others from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def newest_letters() -> str:
    """A class of the letters and numbers that may be too new for the tokenizer: Python's own tables do not have them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    ranges: list[list[int]] = []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else r"(?!)"


class TooNew(LookupError):
    """A piece holds characters that the tokenizer may split in another way."""


class Merges:
    """Ranks of symbol pairs. A symbol is a number; the first 256 are the bytes."""

    def __init__(self, pairs):
        number = {s: b for b, s in enumerate(byte_symbols())}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(pairs):
            pair = number[left], number[right]
            self.ranks[pair] = rank, number.setdefault(left + right, len(number))

    def count(self, piece: bytes) -> int:
        """Symbols that are left when no adjacent pair has a rank; of equal pairs the first goes first."""
        symbol, end = list(piece), len(piece)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        find = self.ranks.get
        heap = [(found[0], i) for i, pair in enumerate(zip(symbol, symbol[1:])) if (found := find(pair))]
        heapq.heapify(heap)
        left = end
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            found = find((symbol[i], symbol[j])) if j < end else None
            if found is None or found[0] != rank:  # one of the two has been merged since
                continue
            symbol[i], symbol[j] = found[1], -1
            left -= 1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if found := find((symbol[i], symbol[k])):
                    heapq.heappush(heap, (found[0], i))
            h = before[i]
            if h >= 0 and (found := find((symbol[h], symbol[i]))):
                heapq.heappush(heap, (found[0], h))
        return left


def parts_of(vocabulary: bytes) -> tuple[dict, list[dict]]:
    """Model and added tokens of a tokenizer's file; refuses what is more than byte-level pieces and merges."""
    file = json.loads(vocabulary)
    model, before, added = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not (
        file["normalizer"] or before.get("add_prefix_space") or model.get("dropout") or model.get("ignore_merges")
        or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("only plain byte-level vocabularies with pair merges can be counted")
    return model, added


class Counter(dict):
    """Number of tokens of a text; as a dictionary, the counts of pieces met so far."""

    def __init__(self, vocabulary: bytes, newest: str, most: int = MOST):
        super().__init__()
        self.vocabulary, self.newest, self.split = vocabulary, regex.compile(newest), None
        model, added = parts_of(vocabulary)
        self.merges = Merges(p.split(" ") if isinstance(p, str) else p for p in model["merges"])
        self.pieces = regex.compile(PIECE)
        self.gap = regex.compile(r"(?<=\S) (?=\S)")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.most = most

    def __missing__(self, piece: str) -> int:
        if self.newest.search(piece):
            raise TooNew
        self[piece] = n = self.merges.count(piece.encode())
        return n

    def asked(self, part: str) -> int:
        """The count with pieces as the tokenizer itself splits them."""
        if self.split is None:
            from tokenizers import Tokenizer

            self.split = Tokenizer.from_str(self.vocabulary.decode()).pre_tokenizer.pre_tokenize_str
            self.byte = {s: b for b, s in enumerate(byte_symbols())}
        return sum(self.merges.count(bytes(map(self.byte.__getitem__, piece))) for piece, _ in self.split(part))

    def parts(self, text: str, size: int = SLICE):
        """Slices of a long text. They end before a space between other characters, where a piece ends in any case."""
        at = 0
        while len(text) - at > size and (cut := self.gap.search(text, at + size)):
            yield text[at: cut.start()]
            at = cut.start()
        yield text[at:]

    def __call__(self, text: str) -> int:
        if len(self) > self.most:
            self.clear()
        texts = self.special.split(text) if self.special else [text]
        total = len(texts) - 1  # a special string counts as one
        for own in texts:
            for part in self.parts(own):
                try:
                    total += sum(map(self.__getitem__, self.pieces.findall(part)))
                except TooNew:
                    total += self.asked(part)
        return total


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row: the tokens that ``vocabulary`` (the file of a byte-level
    tokenizer) gives for the whole text, without begin or end; strings of special tokens in a text are single tokens.

    The file, a few megabytes whatever the corpus, is read here and sent to the tasks. A null text is empty, an empty one
    has no tokens, a null id stays null, repeated rows are counted each, other columns are not read, an empty table gives
    no rows. Texts of any length are counted in slices; a single piece needs some 200 bytes a byte while it is merged.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()
    parts_of(content)
    shared = docs.sparkSession.sparkContext.broadcast((content, newest_letters()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def count(batches):
        counter = Counter(*shared.value)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield record(COUNTED, doc_id=batch.column(0), n_bytes=[len(t.encode()) for t in texts], n_tokens=list(map(counter, texts)))

    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
