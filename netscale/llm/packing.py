"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of n tokens belongs to reciprocal class j = capacity // n, and every bin of class j takes j pieces, whatever their lengths. Each
worker fills the bins of its own partition in one pass and holds open bins only. As documents may be cut, a remainder that would leave
much of its share of a bin empty gives up a piece of the next class's exact size first, so bins end up nearly full.
"""

from __future__ import annotations

import json
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from netscale.llm.common import blocks, frugal, text_of

#: Pieces below this length aren't cut any more.
SHORTEST = 64
#: Tokens of a bin that may stay empty for the sake of fewer cuts.
SLACK = 20
#: White-space separated pieces of text whose ids a worker remembers.
CACHED = 200_000
#: Characters that are a piece of their own after letters.
PLAIN = frozenset(string.punctuation)


class Encoder:
    """ids of a text as the tokenizers library gives them, without special tokens added.

    For a lower-casing BPE with word ends, ids don't depend on what stands beyond white space. So ids of what stands between white space
    are remembered, and what is new is merged by a byte-pair coder over the same ranks if it's Latin-1, else by the library itself.
    """

    #: The normaliser, splitter and model of such a tokenizer.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMAL = ["NFC", "Replace", "Lowercase"]
    #: Texts on which the two coders must agree, else the library does all.
    PROBES = ("It's 2 O'CLOCK, isn't it?", "naïve Éclair -- [x] a_b 3.14\t\n", "internationalisation unbelievablyxq zzzzqqq !!!", "Straße ﬁ 日本", "\xff\xa0\xad a'LL", "")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = [x["pattern"].get("Regex") for x in splits if x["type"] == "Split"]
        self.fast = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and normal == self.NORMAL and split == [self.SPLIT] and not model.get("dropout")
        self.kept: dict[str, bytes] = {}
        if self.fast:
            self.special = [x["content"] for x in spec["added_tokens"]]
            try:
                self._coder(model)
                self.fast = all(self.ids(t) == self._by_library(t) for t in self.PROBES)
            except AttributeError:  # the merging of one piece is no public member of its library
                self.fast = False

    def _coder(self, model: dict) -> None:
        import regex
        import tiktoken

        # the printable stand-ins of bytes: printable Latin-1 for itself, the others from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
        end = b"\xff"  # of a word; UTF-8 has no such byte
        ids = {}
        for token, i in model["vocab"].items():
            word = token.removesuffix("</w>")
            ids[bytes(byte[c] for c in word) + (end if word != token else b"")] = i
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rank = {}
        for i, (a, b) in enumerate(parts):
            rank.setdefault(a + b, 512 + i)
        raw = {token: rank.get(token) for token in model["vocab"]}
        single = [t for t, r in raw.items() if r is None and len(t.removesuffix("</w>")) == 1]
        order = {t: i for i, t in enumerate(sorted(single, key=lambda t: t.endswith("</w>")))}
        ranks, self.id = {}, {}
        for token in model["vocab"]:
            r = order.get(token, raw[token])
            if r is None:
                continue
            word = token.removesuffix("</w>")
            ranks[bytes(byte[c] for c in word) + (end if word != token else b"")] = r
        self.id = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, r in ranks.items():
            self.id[r] = ids[k]
        if all(self.id[r] == r for r in ranks.values()):
            self.id = None
        self.end, self.find = end, regex.compile(self.SPLIT).findall
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _by_library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, chunk: str) -> bytes:
        try:
            if len(chunk) > 500:
                raise ValueError
            chunk.encode("latin-1")
        except ValueError:
            return self._by_library(chunk)
        chunk = chunk.lower()
        if chunk.isalpha():
            pieces = [chunk]
        elif chunk[:-1].isalpha() and chunk[-1] in PLAIN:
            pieces = [chunk[:-1], chunk[-1]]
        else:
            pieces = self.find(chunk)
        out: list[int] = []
        for piece in pieces:
            out += self.merge(piece.encode() + self.end)
        return array("I", out if self.id is None else self.id[out].tolist()).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers."""
        if not self.fast or any(x in text for x in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._by_library(text)
        kept, chunks = self.kept, text.split()
        if len(kept) > CACHED:
            kept.clear()
        out = list(map(kept.get, chunks))
        if None in out:
            for i, chunk in enumerate(chunks):
                if out[i] is None:
                    found = kept.get(chunk)
                    if found is None:
                        found = kept[chunk] = self._new(chunk)
                    out[i] = found
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def cuts(n: int, capacity: int) -> Iterator[int]:
    """Lengths of the pieces of n tokens."""
    while n >= capacity:
        yield capacity
        n -= capacity
    while n >= SHORTEST and capacity - n * (capacity // n) > SLACK:
        yield (piece := capacity // (capacity // n + 1))
        n -= piece
    if n:
        yield n


class Bins:
    """The open bins of a partition: of each class, the pieces of the bin that isn't full."""

    def __init__(self, capacity: int, partition: int):
        self.capacity, self.next = capacity, partition << 40
        self.open: dict[int, list[tuple]] = {}

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids.tobytes(), total, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for n in cuts(len(ids), self.capacity):
            kind = self.capacity // n
            held = self.open.setdefault(kind, [])
            held.append((doc, start, ids[start : start + n], len(ids)))
            start += n
            if len(held) == kind:
                yield from self.sequence(self.open.pop(kind))

    def close(self) -> Iterator[tuple]:
        """What is left in open bins, end to end: full sequences, then ones whose length is a power of two, which need no padding."""
        rest = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open, left = {}, sum(len(p[2]) for p in rest)
        rest.reverse()
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= room
            pieces = []
            while room:
                doc, start, ids, total = rest.pop()
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                pieces.append((doc, start, ids, total))
                room -= len(ids)
            yield from self.sequence(pieces)


_COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _pack(path: str, capacity: int, end_id: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, bins = encoder(path), np.array([end_id], "<u4").tobytes(), Bins(capacity, TaskContext.get().partitionId())

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _COLUMNS)

        for batch in batches:
            for block in blocks(batch, "text"):
                rows: list[tuple] = []
                for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                    rows += bins.add(doc, np.frombuffer(coder.ids(text) + end, "<u4"))
                if rows:
                    yield made(rows)
        if rows := list(bins.close()):
            yield made(rows)

    return run


def harmonic_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `capacity` tokens.

    A document is its ids by the tokenizers file `tokenizer` (a path that every executor has), without special tokens added, and then
    end_id. Returns of each piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bits each), doc_tokens, sequence_id and
    offset (its place in the sequence; a sequence's pieces leave no gap). Each id of a document is in exactly one piece. A sequence of
    any other length than a power of two is to be padded to capacity.
    A null text is empty: its document has end_id only. Null doc_ids stay null, and rows that repeat are packed each. Other columns of
    docs aren't read. A text is encoded as a whole, however long. An empty table gives no piece.
    """
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return plain.mapInArrow(_pack(tokenizer, capacity, end_id), schema)
