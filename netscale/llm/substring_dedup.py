"""Removal of passages that recur across documents: candidate anchors, then sharded Aho-Corasick automata.

1. Every window of `window` words holds one anchor: its `gram`-word piece of the smallest hash. The same window has the same anchor
   wherever it stands, so windows that recur lie at anchors that recur. Anchors are counted by a pre-aggregated groupBy.
2. Each run of windows at a recurring anchor is a segment. Segments of one anchor form a shard; an anchor that very many documents have
   is split, so that each of its windows becomes a segment and a shard of its own.
3. A task takes the distinct segments of its shards in bounded groups and confirms which windows recur there. Windows that always stand
   together are one passage, as long as can be. The passages are compiled to an automaton, each once, and all segments are streamed through
   it, which alone tells where passages occur.
4. The occurrences go back to the documents that hold the segments, and the words that are covered are removed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netscale.llm.common import blocks, extended, frugal, id_of, mix, text_of, words_of, written

#: An anchor that more documents have is split to its windows.
HOT_DOCS = 1000
#: Segments that are compiled to an automaton at a time, unless one shard alone has more.
SEGMENTS = 500
#: Segments that a task gathers and merges before it sends them to their shards.
MERGED = 100_000


def _anchors(words, window: int, gram: int):
    """Of each window that lies in one text: its first word and its anchor's word; the hashes of all grams."""
    g, _ = words.grams(words.hashes(), gram)
    n = max(0, len(words.start) - window + 1)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    least, place = g[:n].copy(), np.arange(n)
    for j in range(1, window - gram + 1):
        better = g[j : n + j] < least
        least[better] = g[j : n + j][better]
        place[better] = np.flatnonzero(better) + j
    own = words.doc[:n] == words.doc[window - 1 :]
    return np.flatnonzero(own), place[own], g


def _count(window: int, gram: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in blocks(batch, "text"):
                words = words_of(block.column("text"))
                _, place, g = _anchors(words, window, gram)
                place = np.unique(place)
                doc = words.doc[place].astype(np.uint64)
                order = np.lexsort((doc, g[place]))
                h, d = g[place][order], doc[order]
                if len(h):
                    found.append(h[np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]])
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def _places(window: int, gram: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                words = words_of(block.column("text"))
                _, place, g = _anchors(words, window, gram)
                place = np.unique(place)
                doc = words.doc[place]
                ids, th = (block.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("id", "th"))
                yield pa.record_batch([pa.array(g[place].view(np.int64)), pa.array(ids), pa.array(th), pa.array((place - words.first[doc]).astype(np.int32))], ["h", "id", "th", "at"])

    return run


def _segments(window: int, gram: int):
    names = ["shard", "seg", "id", "th", "start", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                words = words_of(block.column("text"))
                first, place, g = _anchors(words, window, gram)
                if not len(first):
                    continue
                lists = block.column("at")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(block.num_rows), np.diff(lists.offsets.to_numpy()))
                hot = flat < 0
                at = words.first[owner] + np.where(hot, -flat - 1, flat)
                kind = np.zeros(len(words.start) + window, np.int8)
                kind[at[at < len(words.start)]] = 1
                kind[at[hot & (at < len(words.start))]] = 2
                kind = kind[place]
                keep = kind > 0
                first, place, kind = first[keep], place[keep], kind[keep]
                if not len(first):
                    continue
                new = np.r_[True, (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1) | (kind[1:] == 2)]
                a = np.flatnonzero(new)
                b = np.r_[a[1:], len(first)] - 1
                head, tail, kind, place = first[a], first[b] + window - 1, kind[a], place[a]
                # every word and one space: segments with the same words have the same bytes
                lengths = words.end - words.start + 1
                to = np.cumsum(lengths)
                data = np.full(int(to[-1]), 32, np.uint8)
                source = np.repeat(words.start - (to - lengths), lengths) + np.arange(len(data))
                inner = np.ones(len(data), bool)
                inner[to - 1] = False
                data[inner] = words.data[source[inner]]
                raw = data.tobytes()
                texts = [raw[s:e] for s, e in zip((to - lengths)[head].tolist(), (to[tail] - 1).tolist(), strict=True)]
                segs = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
                shard = g[place].view(np.int64).copy()
                for i in np.flatnonzero(kind == 2):
                    shard[i] = xxhash.xxh3_64_intdigest(texts[i], 1) - 2**63
                doc = words.doc[head]
                ids, th = (block.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("id", "th"))
                columns = [shard, segs, ids, th, (head - words.first[doc]).astype(np.int32), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.record_batch([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _grouped(table: pa.Table) -> pa.Table:
    return table.group_by(["shard", "seg"], use_threads=False).aggregate([("text", "min"), ("least", "min"), ("most", "max")]).rename_columns(["shard", "seg", "text", "least", "most"])


@frugal
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment once for many documents, with its smallest and largest id: what a task sends of a hot one is bounded."""
    held, rows = [], 0
    for batch in batches:
        held.append(pa.table([*(batch.column(c) for c in ("shard", "seg", "text", "id", "id"))], ["shard", "seg", "text", "least", "most"]))
        rows += batch.num_rows
        if rows >= MERGED:
            yield from _grouped(pa.concat_tables(held)).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from _grouped(pa.concat_tables(held)).combine_chunks().to_batches()


def passages_of(code: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal passages of segments: first and last word of one occurrence of each, and the smallest id of the segments that have it.

    Segment i is code[at[i] : at[i + 1]], of documents from least[i] to most[i]. Windows that some two documents have are in one passage
    if they follow one another in just the same segments.
    """
    n = max(0, len(code) - window + 1)
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hashed = np.zeros(n, np.uint64)
    for j in range(window):
        hashed = hashed * np.uint64(0xFF51AFD7ED558CCD) + mix(code[j : n + j].astype(np.uint64) + np.uint64(1))
    place = np.flatnonzero(np.arange(n) + window <= at[own[:n] + 1])
    seg = own[place]
    _, first, number = np.unique(mix(hashed[place]), return_index=True, return_inverse=True)  # the first is of the smallest segment
    low, high, together = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min), np.zeros(len(first), np.uint64)
    np.minimum.at(low, number, least[seg])
    np.maximum.at(high, number, most[seg])
    np.add.at(together, number, mix(seg.astype(np.uint64) + np.uint64(1)))
    kept = np.sort(first[low < high])
    if not len(kept):
        return kept, kept, kept
    new = np.r_[True, (place[kept[1:]] != place[kept[:-1]] + 1) | (seg[kept[1:]] != seg[kept[:-1]]) | (together[number[kept[1:]]] != together[number[kept[:-1]]])]
    a = np.flatnonzero(new)
    return place[kept[a]], place[kept[np.r_[a[1:], len(kept)] - 1]] + window - 1, low[number[kept[a]]]


def _located(table: pa.Table, window: int) -> pa.Table | None:
    """(shard, seg, offs, ends, lows) of segments (shard, seg, text, least, most): where recurring passages stand in them, in words, and the
    smallest id that has each."""
    words = pc.split_pattern(table["text"].combine_chunks(), " ")
    code, at = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64), words.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    least, most = table["least"].to_numpy(), table["most"].to_numpy()
    a, b, lows = passages_of(code, at, least, most, window)
    if not len(a):
        return None
    # all segments in one sequence, -1 between them
    stream = np.full(len(code) + len(at) - 1, -1, np.int64)
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    stream[np.arange(len(code)) + own] = code
    stream = tuple((stream + 1).tolist())
    passages = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, (x, y) in enumerate(zip((a + own[a]).tolist(), (b + own[a] + 1).tolist(), strict=True)):
        passages.add_word(stream[x:y], i)
    passages.make_automaton()
    end, which = (np.array(x, np.int64) for x in zip(*passages.iter(stream), strict=True))
    base = at[:-1] + np.arange(len(at) - 1)
    seg = np.searchsorted(base, end, "right") - 1
    keep = lows[which] < most[seg]
    end, which, seg = end[keep], which[keep], seg[keep]
    counts = np.bincount(seg, minlength=len(at) - 1)
    some = np.flatnonzero(counts)
    lists = pa.array(np.r_[0, np.cumsum(counts[some])].astype(np.int32))
    ends = end - base[seg] + 1
    values = [pa.array((ends - (b - a + 1)[which]).astype(np.int32)), pa.array(ends.astype(np.int32)), pa.array(lows[which])]
    rows = table.take(pa.array(some))
    return pa.table([rows["shard"], rows["seg"], *(pa.ListArray.from_arrays(lists, v) for v in values)], ["shard", "seg", "offs", "ends", "lows"])


def _automata(window: int):
    def searched(table: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, i = table["shard"].to_numpy(), 0
        while i < len(shard):  # whole shards; small automata, as a node's branches are searched one by one
            j = int(np.searchsorted(shard, shard[min(i + SEGMENTS, len(shard)) - 1], "right"))
            if found := _located(table.slice(i, j - i), window):
                yield from found.combine_chunks().to_batches()
            i = j

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([rest, table]) if rest is not None else table
                shard = table["shard"].to_numpy()
                cut = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0  # the last shard may go on
                rest, table = table.slice(cut), table.slice(0, cut)
            elif rest is not None:
                table = rest
            else:
                break
            if table.num_rows:
                table = _grouped(table.combine_chunks())
                table = table.take(pa.array(np.argsort(table["shard"].to_numpy(), kind="stable")))
                shard = table["shard"].to_numpy()
                first = np.r_[True, shard[1:] != shard[:-1]]
                once = first & np.r_[first[1:], True] & (table["least"].to_numpy() == table["most"].to_numpy())
                yield from searched(table.filter(pa.array(~once)))  # a shard of one segment in one document has nothing that recurs

    return run


def _cover(text_column: str, names: list[str]):
    """Words outside all covered spans stay, each with the white space before it, or joined by one space."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "__text"):
                words = words_of(block.column("__text"))
                n = np.diff(words.first)
                lists = block.column("__spans")
                a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
                owner = np.repeat(np.arange(block.num_rows), np.diff(lists.offsets.to_numpy()))
                cover = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(cover, words.first[owner] + a, 1)
                np.add.at(cover, words.first[owner] + b, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed = np.diff(np.r_[0, np.cumsum(gone)][words.first])
                kept, own = [], block.column("__text").to_pylist()
                for i, text in enumerate(own):
                    if removed[i]:
                        a, b = words.first[i], words.first[i + 1]
                        raw, base, out, last, some = text.encode(), words.at[i], [], 0, False
                        for s, e, g in zip((words.start[a:b] - base).tolist(), (words.end[a:b] - base).tolist(), gone[a:b].tolist(), strict=True):
                            if not g:
                                out.append(raw[last:e] if some else raw[s:e])
                                some = True
                            last = e
                        text = b"".join(out).decode()
                    kept.append(text)
                values = {f: block.column(f) for f in names if f in block.schema.names}
                values |= {"n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), text_column: pa.array(kept, pa.string())}
                yield pa.record_batch([values[f] for f in names], names)

    return run


def covered_spans(docs: DataFrame, window: int = 13, gram: int = 5, text: str = "text", doc_id: str = "doc_id", hot_docs: int = HOT_DOCS) -> DataFrame:
    """(id, th, spans) of documents that hold windows which some document with a smaller id has too: th, a 64-bit hash of the text; spans
    (start, end) of such windows, in words.

    A null id is the largest long and a null text is empty; rows of the same id and text, in any number, give one row. Other columns aren't
    read. An empty table gives no rows.
    """
    plain = docs.select(id_of(doc_id).alias("id"), text_of(text).alias("text")).withColumn("th", F.xxhash64("text"))
    recurring = plain.select("text").mapInArrow(_count(window, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    recurring = written(recurring, "anchors", narrow=True)  # so that Spark can split a frequent anchor's rows in the join
    places = plain.mapInArrow(_places(window, gram), "h long, id long, th long, at int").join(recurring, "h")
    places = places.select("id", "th", F.expr(f"if(n > {int(hot_docs)}, -at - 1, at)").alias("at")).groupBy("id", "th").agg(F.collect_set("at").alias("at"))
    held = plain.join(places, ["id", "th"])
    held = written(held.mapInArrow(_segments(window, gram), "shard long, seg long, id long, th long, start int, text string"), "segments")
    shards = held.select("shard", "seg", "text", "id").mapInArrow(_merge, "shard long, seg long, text string, least long, most long")
    shards = shards.repartition("shard").sortWithinPartitions("shard", "seg")
    found = shards.mapInArrow(_automata(window), "shard long, seg long, offs array<int>, ends array<int>, lows array<long>")
    hits = held.select("shard", "seg", "id", "th", "start").join(found, ["shard", "seg"])
    spans = F.expr("transform(filter(arrays_zip(offs, ends, lows), x -> x.lows < id), x -> struct(start + x.offs as start, start + x.ends as end))")
    hits = hits.select("id", "th", F.explode(spans).alias("span"))
    return written(hits.groupBy("id", "th").agg(F.collect_set("span").alias("spans")), "spans", narrow=True)


def substring_dedup(docs: DataFrame, window: int = 13, gram: int = 5, text: str = "text", doc_id: str = "doc_id", hot_docs: int = HOT_DOCS) -> DataFrame:
    """Remove every word that lies in a window of `window` words which a document with a smaller id has as well.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; windows are judged on the input. All columns of docs stay; text holds the words that
    are left with the white space between them, n_words and n_removed (long) are added (and replace columns of these names).
    A text without removals is unchanged, and a null text stays null (0 words). A null id ranks after all others. Rows that repeat are
    each treated alike; rows of the same id never remove from one another. An empty table gives an empty one.
    """
    spans = covered_spans(docs, window, gram, text, doc_id, hot_docs)
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    rows = docs.select(*names).withColumns({"__text": text_of(text), "__id": id_of(doc_id)}).withColumn("__th", F.xxhash64("__text"))
    joined = rows.join(spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans")), ["__id", "__th"], "left")
    joined = joined.withColumn("__spans", F.coalesce("__spans", F.expr("cast(array() as array<struct<start: int, end: int>>)"))).withColumn("__null", F.isnull(text))
    plain = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields if f.name in names])
    schema = extended(plain, ("n_words", T.LongType()), ("n_removed", T.LongType()), ("__null", T.BooleanType()))
    out = joined.drop(text, "__id", "__th").mapInArrow(_cover(text, schema.names), schema)
    return out.withColumn(text, F.when(~F.col("__null"), F.col(text))).drop("__null")
