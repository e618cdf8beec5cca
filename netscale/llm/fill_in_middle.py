"""Fill-in-middle: documents cut into prefix, middle and suffix, and put together with the middle last.

A kernel works on the UTF-8 buffers of whole batches: a table of byte classes, a mask of the bytes at which a unit starts, running counts of
units and characters, and binary searches in these for the cuts of all rows together. No text becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netscale.llm.common import blocks, extended, frugal, text_of, utf8

#: Fixed: what stands before prefix, suffix and middle.
MARKS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = range(3)

#: Classes of bytes: one that goes on with a character, an ASCII letter, any other first byte of a character.
GOES_ON, LETTER, OTHER = range(3)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = GOES_ON
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER

DRAWS = ("__h1", "__h2", "__h3", "__h4")


def draws(key: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers of a row, the first 8-digit groups of the hex SHA-256 of seed:key. A null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(DRAWS)]


def _running(mask: np.ndarray) -> np.ndarray:
    """How many of the mask's bytes come before each byte, and in all."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 2**31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a mark starts, and in which text; one across two texts is none."""
    kinds = np.frombuffer(MARKS, np.uint8)[1::3]
    hit = np.flatnonzero((data[:-2] == ord("<")) & np.isin(data[1:-1], kinds) & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    doc = np.searchsorted(at, hit, "right") - 1
    inside = hit + 3 <= at[doc + 1]
    return hit[inside], doc[inside]


def _gather(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Texts of the segments of each row (start, length: rows x segments of source)."""
    ends = np.cumsum(length, dtype=np.int64).reshape(length.shape)
    total = int(ends[-1, -1]) if len(ends) else 0
    flat_start, flat_length, flat_end = start.ravel(), length.ravel(), ends.ravel()
    if len(flat_start) * 1024 < total:  # a few long segments: whole slices at a time need no index of bytes
        out = np.empty(total, np.uint8)
        for s, n, e in zip(flat_start.tolist(), flat_length.tolist(), flat_end.tolist(), strict=True):
            out[e - n : e] = source[s : s + n]
    else:
        out = source[np.repeat(flat_start - (flat_end - flat_length), flat_length) + np.arange(total)]
    at = np.r_[0, ends[:, -1]] if len(ends) else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def cut(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, h4: np.ndarray, plain: int, spm: int) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all texts (null: empty)."""
    data, at = utf8(texts)
    kind = CLASS[data]
    starts = kind != GOES_ON
    chars = _running(starts)
    # a unit starts at a character, but not at a letter after a letter of its text
    joined = np.zeros(len(data), bool)
    joined[1:] = (kind[1:] == LETTER) & (kind[:-1] == LETTER)
    joined[at[:-1][at[:-1] < len(data)]] = False
    units = _running(starts & ~joined)
    base = units[at[:-1]].astype(np.int64)
    n = units[at[1:]] - base
    a, b = h1 % (n + 1), h2 % (n + 1)
    # the byte at which unit number k of a text starts; unit n starts where the text ends
    upto = units[1:]
    first, second = (np.minimum(np.searchsorted(upto, base + k + 1, "left"), at[1:]) for k in (np.minimum(a, b), np.maximum(a, b)))
    is_plain = (n == 0) | (h3 % 100 >= plain)
    is_plain[_marks(data, at)[1]] = True
    is_spm = ~is_plain & (h4 % 100 < spm)
    source = np.concatenate([data, np.frombuffer(MARKS, np.uint8)])
    mark = len(data) + 3 * np.arange(3)
    zero, three = np.zeros(len(n), np.int64), np.full(len(n), 3)
    parts = {PREFIX: (at[:-1], first - at[:-1]), MIDDLE: (first, second - first), SUFFIX: (second, at[1:] - second)}

    def ordered(*which: int) -> tuple[np.ndarray, np.ndarray]:
        start, length = [], []
        for p in which:
            start += [zero + mark[p], parts[p][0]]
            length += [three, parts[p][1]]
        return np.stack(start, 1), np.stack(length, 1)

    (start, length), (spm_start, spm_length) = ordered(PREFIX, SUFFIX, MIDDLE), ordered(SUFFIX, PREFIX, MIDDLE)
    start[is_spm], length[is_spm] = spm_start[is_spm], spm_length[is_spm]
    length[is_plain] = 0
    start[is_plain, 1], length[is_plain, 1] = at[:-1][is_plain], np.diff(at)[is_plain]
    form = pa.DictionaryArray.from_arrays(pa.array(np.where(is_plain, 0, np.where(is_spm, 2, 1)), pa.int8()), pa.array(["plain", "psm", "spm"])).cast(pa.string())
    return {
        "n": pa.array(n, pa.int64()),
        "form": form,
        "prefix_chars": pa.array((chars[first] - chars[at[:-1]]).astype(np.int64), mask=is_plain),
        "middle_chars": pa.array((chars[second] - chars[first]).astype(np.int64), mask=is_plain),
        "output": _gather(source, start, length),
    }


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that cut() was given: each of the three marks stands once in an output that isn't plain."""
    data, at = utf8(output)
    kind = form.to_numpy(zero_copy_only=False)
    marked = np.flatnonzero(kind != "plain")
    hit, doc = _marks(data, at)
    hit = hit[np.isin(doc, marked)].reshape(len(marked), 3)
    start, length = np.zeros((len(kind), 3), np.int64), np.zeros((len(kind), 3), np.int64)
    start[:, 0], length[:, 0] = at[:-1], np.diff(at)
    s, e = hit + 3, np.c_[hit[:, 1:], at[1:][marked]]
    spm = (kind[marked] == "spm")[:, None]
    order = np.where(spm, [1, 2, 0], [0, 2, 1])  # of prefix, middle and suffix among the parts
    start[marked], length[marked] = np.take_along_axis(s, order, 1), np.take_along_axis(e - s, order, 1)
    return _gather(data, start, length)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 90, spm: int = 20) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output, each replacing a column of its name.

    A text of n units ([A-Za-z]+ or any other character) is cut after two counts of units, drawn from its key. plain: the percentage
    of texts that are cut; of those, spm percent have the suffix first. Texts that are empty (as null is) or hold a mark stay as they are
    (form plain, null counts of characters). A null key draws as an empty one does, equal rows draw alike, and an empty table
    gives an empty one. One pass without a shuffle; a task holds a batch, and indexes about 2 MB of text (or one longer text) at a time.
    """
    more = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = extended(docs.schema, *more)
    held = docs.withColumn("__text", text_of(text)).select("*", *draws(F.col(key), seed))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "__text"):
                h = [block.column(name).to_numpy() for name in DRAWS]
                made = cut(block.column("__text"), *h, plain, spm)
                yield pa.record_batch([made[f.name] if f.name in made else block.column(f.name) for f in schema.fields], [f.name for f in schema.fields])

    return held.mapInArrow(run, schema)


def restore(outputs: DataFrame, output: str = "output", form: str = "form", text: str = "restored") -> DataFrame:
    """fill_in_middle's rows with the text each was made of, from output and form alone. A null output is an empty one."""
    schema = extended(outputs.schema, (text, T.StringType()))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, output):
                made = rebuilt(block.column(output), block.column(form))
                yield pa.record_batch([made if f.name == text else block.column(f.name) for f in schema.fields], [f.name for f in schema.fields])

    return outputs.mapInArrow(run, schema)
