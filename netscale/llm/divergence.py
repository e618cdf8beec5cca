"""Audit of how the vocabularies of sources diverge, by language.

A first pass over the texts makes a count-min sketch of the documents that have each (language, term). Its estimates never are too low, so a
second pass leaves out the terms that can't be in enough documents before anything is shuffled. What survives is counted exactly, and
pairs of sources meet in joins on the terms that both have; terms that only one or none has enter by sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.llm.common import Words, blocks, frugal, mix, utf8, written

#: The bytes of [\x00-\x40\x5B-\x60\x7B-\x7F], which lie between terms.
GAP = np.ones(256, bool)
GAP[0x41:0x5B] = GAP[0x61:0x7B] = GAP[0x80:] = False

#: Rows and columns of the sketch: a byte each, so 16 MB, whatever the corpus.
DEPTH, WIDTH = 4, 1 << 22
#: Cells that travel together when sketches are merged.
CHUNK = 1 << 18
#: Counts stop here; it must not be below the least number of documents.
FULL = 255


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


class Terms:
    """Terms of a block of documents (null columns are empty): which one each is, and the document it's in."""

    def __init__(self, block: pa.RecordBatch):
        data, at = utf8(block.column("text"))
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        words = Words(data, at, GAP)
        size = np.r_[0, np.cumsum(words.end - words.start)].astype(np.int64)
        each = pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(data[~GAP[data]])))
        self.doc = words.doc
        self.term, self.terms = _coded(each)
        self.lang, self.langs = _coded(block.column("lang"))
        self.source, self.sources = _coded(block.column("source"))

    def hashes(self) -> np.ndarray:
        return _hashes(self.terms)

    def per_document(self) -> tuple[np.ndarray, np.ndarray]:
        """Each document and term once, and how often it has it."""
        return np.unique(self.doc * max(1, len(self.terms)) + self.term, return_counts=True)


def _hashes(texts: pa.Array) -> np.ndarray:
    data, at = utf8(texts)
    w = Words(data, at, np.zeros(256, bool))
    out = np.zeros(len(texts), np.uint64)
    out[w.doc] = w.hashes()  # an empty text has no word
    return out


def _cells(lang: np.ndarray, term: np.ndarray, depth: int, width: int) -> Iterator[np.ndarray]:
    """Where (language, term) is counted in each row of a sketch; width is a power of two."""
    both = mix(lang * np.uint64(0x9E3779B97F4A7C15) ^ term)
    for row in range(depth):
        both = mix(both + np.uint64(2 * row + 1))
        yield (both & np.uint64(width - 1)).astype(np.int64) + row * width


def _sketched(depth: int, width: int):
    """Chunks of the sketch of a task's documents."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(depth * width, np.int32)
        for batch in batches:
            for block in blocks(batch, "text"):
                t = Terms(block)
                if not len(t.term):
                    continue
                once, _ = t.per_document()
                doc, term = once // len(t.terms), once % len(t.terms)
                pair, n = np.unique(t.lang[doc] * len(t.terms) + term, return_counts=True)
                lang, term = _hashes(t.langs)[pair // len(t.terms)], t.hashes()[pair % len(t.terms)]
                for at in _cells(lang, term, depth, width):
                    np.add.at(cells, at, n)
                np.minimum(cells, FULL, out=cells)
        yield from _chunks(cells)

    return run


def _chunks(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(cells), CHUNK):
        if cells[k : k + CHUNK].any():
            yield pa.record_batch([pa.array([k // CHUNK], pa.int32()), pa.array([cells[k : k + CHUNK].astype(np.uint8).tobytes()], pa.binary())], ["chunk", "cells"])


@frugal
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks of a task; a task holds one array for each number."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells"), strict=True):
            more = np.frombuffer(cells.as_buffer(), np.uint8)
            held[k] = np.minimum(held[k].astype(np.int32) + more, FULL).astype(np.uint8) if k in held else more.copy()
    for k, cells in held.items():
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["chunk", "cells"])


def document_frequencies(docs: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> np.ndarray:
    """A count-min sketch of the documents (lang, source, text) that have each (language, term): depth x width bytes, full at 255."""
    schema = "chunk int, cells binary"
    parts = docs.mapInArrow(_sketched(depth, width), schema).repartition("chunk").mapInArrow(_merged, schema)
    out = np.zeros(depth * width, np.uint8)
    for chunk in parts.toLocalIterator():  # of bounded size: depth * width bytes in all
        out[chunk.chunk * CHUNK : chunk.chunk * CHUNK + len(chunk.cells)] = np.frombuffer(chunk.cells, np.uint8)
    return out


def _counted(sketch, depth: int, width: int, least: int):
    """(lang, source, term, n_docs, n) of each block for the terms that may be in enough documents."""
    names = ["lang", "source", "term", "n_docs", "n"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sketch.value
        for batch in batches:
            for block in blocks(batch, "text"):
                t = Terms(block)
                if not len(t.term):
                    continue
                once, times = t.per_document()
                doc, term = once // len(t.terms), once % len(t.terms)
                pair, where = np.unique(t.lang[doc] * len(t.terms) + term, return_inverse=True)
                lang, hashed = _hashes(t.langs)[pair // len(t.terms)], t.hashes()[pair % len(t.terms)]
                enough = np.ones(len(pair), bool)
                for at in _cells(lang, hashed, depth, width):
                    enough &= cells[at] >= least
                keep = enough[where]
                key = (t.source[doc[keep]] * len(t.langs) + t.lang[doc[keep]]) * len(t.terms) + term[keep]
                key, where = np.unique(key, return_inverse=True)
                n = np.bincount(where, times[keep], len(key)).astype(np.int64)
                group = key // len(t.terms)
                columns = [t.langs.take(pa.array(group % len(t.langs))), t.sources.take(pa.array(group // len(t.langs))), t.terms.take(pa.array(key % len(t.terms))).cast(pa.string())]
                yield pa.record_batch([*columns, pa.array(np.bincount(where, minlength=len(key)), pa.int64()), pa.array(n)], names)

    return run


def term_counts(docs: DataFrame, least: int = 30, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(lang, source, term, n_docs, n), exact, of all terms that the sketch doesn't rule out for their language."""
    if not 1 <= least <= FULL:
        raise ValueError(f"least is from 1 to {FULL}")
    sketch = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs, depth, width))
    rows = docs.mapInArrow(_counted(sketch, depth, width, least), "lang string, source string, term string, n_docs long, n long")
    out = written(rows.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")), "term_counts")
    sketch.destroy()
    return out


def _share(n: str, total: str, terms: str, scale: int, prior: int) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * terms)) in whole numbers."""
    over = f"cast({total} as decimal(20,0)) + {prior} * cast({terms} as decimal(15,0))"
    return F.expr(f"1 + ({scale} * (cast({n} as decimal(20,0)) + {prior})) div ({over})")


def divergence(docs: DataFrame, least: int = 30, top: int = 50, scale: int = 1_000_000_000, prior: int = 5, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text; null ones are empty, other columns are ignored).

    A language keeps the terms ([^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+, A-Z lower-cased) that at least `least` of its documents have; rows that
    repeat count each. A term's share in a group is 1 + floor(scale * (n + prior) / (N + prior * V)). Part `pair`: summed differences of
    shares between a source and each other one of its language, all ranks; 0 where a language keeps no term, and no row for a
    language of one source. Part `term`: terms of which a source has more than its language, the first `top`. Ties go by item in UTF-8. A
    group without terms is part of all that. An empty table gives an empty one.

    Texts are read twice in batches; what is shuffled are counts of surviving terms. Only the sketch (depth * width bytes) is broadcast.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(read, least, depth, width)
    kept = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("d"), F.sum("n").alias("n_lang")).where(F.col("d") >= least)
    kept = written(kept.select("lang", "term", "n_lang"), "kept_terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    held = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "kept_counts")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "v", "total_lang"]).withColumn("p0", F.when(F.col("v") > 0, _share("0", "total", "v", scale, prior)))
    groups = written(groups, "groups")
    rows = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "p0", _share("n", "total", "v", scale, prior).alias("p"), _share("n_lang", "total_lang", "v", scale, prior).alias("q"))
    rows = written(rows, "shares")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    pairs = _pairs(groups, rows)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def _pairs(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, other, value): differences of shares summed over all kept terms, for both orders of a pair.

    With a's share p and its share 0 of a term that it lacks, |p - q| over all terms is V |p0 - q0|, and for each term that a has |p - q0| -
    |p0 - q0|, the same for b, and for each that both have what these two got wrong. The first needs only how many of a's terms have
    which share: (p - q0) + 2 max(q0 - p, 0), where only the few shares below q0 count.
    """
    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"))
    every = one.join(two, "lang").where("a <> b")
    by_share = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    sums = by_share.groupBy("lang", F.col("source").alias("a")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("sum_p"))
    low = by_share.join(two, "lang").where("source <> b and p < q0").groupBy("lang", F.col("source").alias("a"), "b").agg(F.sum(2 * F.col("n") * (F.col("q0") - F.col("p"))).alias("low"))
    own = every.join(sums, ["lang", "a"], "left").join(low, ["lang", "a", "b"], "left").fillna(0, ["n", "sum_p", "low"])
    gap = F.abs(F.col("p0") - F.col("q0"))
    own = own.select("lang", "a", "b", (F.col("sum_p") - F.col("n") * F.col("q0") + F.col("low") - F.col("n") * gap).alias("own"), (F.col("v") * gap).alias("base"))
    x = rows.select("lang", "term", F.col("source").alias("a"), "p", "p0")
    y = rows.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    wrong = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q")) + gap
    both = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(wrong).alias("both"))
    # each pair's two sides, once by its smaller source first
    sides = own.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "own", "base")
    total = sides.groupBy("lang", "a", "b").agg(F.sum("own").alias("own"), F.first("base").alias("base")).join(both, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("base") + F.col("own") + F.coalesce("both", F.lit(0)), F.lit(0)).cast("long").alias("value")
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other")), F.struct(F.col("b").alias("source"), F.col("a").alias("other"))))
    return total.select("lang", ways.alias("w"), value).select("lang", "w.source", "w.other", "value")
