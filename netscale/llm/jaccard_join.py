"""Exact Jaccard join of word shingle sets by partitions of the universe.

Sets of sizes s and t with a similarity of 3/4 or more differ in at most H = (s + t) // 7 shingles. For each band of sizes (of the larger
set) the universe of shingles is cut into m segments, a little more than H. A set whose shingles lie in more than H segments agrees with
every partner on the whole content of one of these, so equal (segment, content) signatures give all candidates.

Costs decide how a difference is allotted to segments. A fixed-size count sketch tells frequent shingles: their part of the universe is
never used (-1), all other segments must agree wholly (0), and sets of up to six shingles are one segment that may differ by one shingle,
by its one-deletion neighbourhood (+1). A set that then has too few segments adds its prefix (its first s // 4 + 1 shingles, infrequent
ones first), which finds partners in the same state; with any other partner, that partner's segments suffice.

Signatures travel as packed arrays, equal sets of a task once. Of each signature's group all are compared with one member first. Then, in
rounds, each component of a group but its largest asks for its most likely pairs with other components; these are verified, components
join, and pairs that proved apart aren't asked for again, until no group has a pair left that is neither connected nor apart. So what
leaves a group in a round grows with its components, never with its pairs. Parity sketches of 4 to 8 bits a shingle, which bound the
difference of two sets from below, rule out nearly all pairs that aren't similar; the others are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netscale.llm.common import NO_ID, SEEN, blocks, frugal, id_of, mix, runs, text_of, words_of, written
from netscale.llm.components import components

#: Cells of the count sketch and the parts it is summed in; a shingle is frequent beyond this many times the mean count plus a constant.
CELLS, PARTS, FREQUENT, AT_LEAST = 1 << 20, 16, 4, 64
#: Segments of a band for each shingle that may differ.
SPARE = 1.15
#: Signatures and sets that a task holds before it sends them.
ROWS, SETS = 4_000_000, 60_000
#: Logical partitions of signatures for each shuffle partition; one is held in memory at a time.
FINER = 2
#: Bytes at most of the sketches that sets have while they are compared within groups.
SMALL = 2048
#: Members of a group that are compared in one piece, and pairs that a component asks for in the first round (in each later one, MORE times as many).
TOGETHER, TRIES, MORE = 4096, 16, 64
#: The largest size of which a set is one segment.
TINY = 6


def _starts(largest: int = 1 << 40) -> list[int]:
    starts = [1, TINY + 1]
    while starts[-1] < largest:
        starts.append(-(-starts[-1] * 4 // 3))
    return starts


STARTS = _starts()


def shingles(block: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text of a block; fewer than k words are one shingle."""
    words = words_of(block.column("text"), lower=True)
    hashed = words.hashes()
    grams, _ = words.grams(hashed, k)
    for i in range(block.num_rows):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= k:
            h = np.sort(grams[a : b - k + 1])
            yield i, h[np.r_[True, h[1:] != h[:-1]]]
        elif b > a:
            one = np.zeros(1, np.uint64)
            for j in range(a, b):
                one = one * np.uint64(0xFF51AFD7ED558CCD) + hashed[j : j + 1]
            yield i, mix(one + np.uint64(b - a))
        else:
            yield i, np.zeros(0, np.uint64)


def key_of(h: np.ndarray) -> int:
    """A 64-bit key of a set."""
    return int(mix(np.array([mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def sketch_of(h: np.ndarray) -> bytes:
    """For each of 2^b buckets of hashes, whether their number is odd; 4 to 8 bits a shingle."""
    bits = 1 << max(6, int(4 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch (as bytes) of at most `size` bytes: what it says stays true."""
    return sketch if len(sketch) <= size else np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles in which two sets differ at least, by their sketches as bytes."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _sets(k: int):
    """A row for each document (id, key, n, sketch, small), and the parts of the task's count sketch (part, counts).

    small: the sketch folded to SMALL bytes, null if it has no more.
    """
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("small", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(CELLS, np.int32), set()
        for batch in batches:
            for block in blocks(batch, "text"):
                keys, sizes, sketches, held = [], [], [], []
                for _, h in shingles(block, k):
                    keys.append(key := key_of(h) if len(h) else None)
                    sizes.append(len(h))
                    sketches.append(sketch_of(h) if len(h) else None)
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        held.append(h)
                if held:
                    counts += np.bincount((np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int32)
                n = len(keys)
                small = [folded(np.frombuffer(x, np.uint8), SMALL).tobytes() if x and len(x) > SMALL else None for x in sketches]
                yield pa.record_batch([block.column("id"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(small, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if seen:
            parts = counts.reshape(PARTS, -1)
            none = [*[pa.nulls(PARTS, pa.int64())] * 3, *[pa.nulls(PARTS, pa.binary())] * 2]
            yield pa.record_batch([*none, pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)

    return run


@frugal
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of the sketch, as 64-bit counts."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total.setdefault(part, np.zeros(CELLS // PARTS, np.int64))
            total[part] += np.frombuffer(raw, np.int32)
    for part, counts in total.items():
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([counts.astype(np.float32).tobytes()], pa.binary())], ["part", "counts"])


def frequent(parts: DataFrame) -> np.ndarray:
    """Which cells of the sketch are frequent. Of fixed size, whatever the input."""
    counts = np.zeros((PARTS, CELLS // PARTS), np.float32)
    for row in parts.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(_summed, "part int, counts binary").collect():
        counts[row.part] = np.frombuffer(row.counts, np.float32)
    counts = counts.reshape(-1)
    return counts > AT_LEAST + FREQUENT * counts.mean()


def signatures(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Signatures of a set (its sorted shingle hashes); hot: which of them are frequent."""
    s, out, short = len(h), [], False
    token = mix(h)
    cold = ~hot
    h_cold, token_cold = h[cold], token[cold]
    for k in range(int(np.searchsorted(STARTS, s, "right")) - 1, len(STARTS) - 1):
        if 3 * STARTS[k] > 4 * s:
            break
        top = STARTS[k + 1] - 1
        if top <= TINY:
            out.append(np.r_[token.sum(keepdims=True), token.sum(keepdims=True) - token] ^ np.uint64(k))
            continue
        m = int(SPARE * (2 * top // 7 + 1)) + 1
        segment = ((h_cold >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # grows with h
        if not len(segment):
            short = True
            continue
        at = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        content = np.add.reduceat(token_cold, at)
        out.append(content + (segment[at] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64))
        short |= len(at) < (s + min(top, 4 * s // 3)) // 7 + 1
    if short:
        first = np.r_[h_cold, h[hot]][: s // 4 + 1]
        out.append(first ^ np.uint64(0xA0761D6478BD642F))
    return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _signed(k: int, cells, parts: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = cells.value, set()
        keys: list[int] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            sig = np.concatenate(held)
            own = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(x) for x in held])
            p = (sig % np.uint64(parts)).astype(np.uint16)
            order = np.argsort(p, kind="stable")
            sig, own = (sig // np.uint64(parts))[order], own[order]
            ends = np.cumsum(np.bincount(p, minlength=parts))
            key, size = np.array(keys, np.int64), np.array(sizes, np.int32)
            some, blobs = [], []
            for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
                if a < b:
                    low, high = sig[a:b].astype(np.uint32), (sig[a:b] >> np.uint64(32)).astype(np.uint8)
                    used, place = np.unique(own[a:b], return_inverse=True)  # only sets that this blob refers to
                    head = np.array([len(used), b - a], np.uint32).tobytes() + key[used].tobytes() + size[used].tobytes()
                    some.append(i)
                    blobs.append(head + low.tobytes() + high.tobytes() + place.astype(np.uint16).tobytes())
            for x in (keys, sizes, held):
                x.clear()
            return pa.record_batch([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["p", "blob"])

        for batch in batches:
            for block in blocks(batch, "text"):
                for _, h in shingles(block, k):
                    if len(h) and (key := key_of(h)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        keys.append(key)
                        sizes.append(len(h))
                        held.append(signatures(h, hot[(h & np.uint64(CELLS - 1)).astype(np.int64)]))
                        count += len(held[-1])
                        if count >= ROWS or len(keys) >= SETS:
                            yield flush()
                            count = 0
        if count:
            yield flush()

    return run


def _groups_of(blobs: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
    """Keys and sizes of sets that share a signature and may be similar by their sizes, each such group once, one of middle size first."""
    keys, sizes, sigs, own, base = [], [], [], [], 0
    for raw in blobs:
        n, rows = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
        at = 8
        keys.append(np.frombuffer(raw, np.int64, n, at))
        sizes.append(np.frombuffer(raw, np.int32, n, at + 8 * n))
        at += 12 * n
        low, high = np.frombuffer(raw, np.uint32, rows, at), np.frombuffer(raw, np.uint8, rows, at + 4 * rows)
        sigs.append(low | (high.astype(np.uint64) << np.uint64(32)))
        own.append(np.frombuffer(raw, np.uint16, rows, at + 5 * rows).astype(np.int64) + base)
        base += n
    blobs.clear()
    key, place, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)[place]
    order = np.argsort(size, kind="stable")  # members of a group then go by size
    key, size, rank = key[order], size[order].astype(np.int64), np.argsort(order)
    member, sig = rank[number[np.concatenate(own)]], np.concatenate(sigs)
    del sigs, own
    if len(key) < 1 << 24:
        both = np.sort((sig << np.uint64(24)) | member.astype(np.uint64))
        both = both[np.r_[True, both[1:] != both[:-1]]]
        sig, member = both >> np.uint64(24), (both & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.lexsort((member, sig))
        sig, member = sig[order], member[order]
        keep = np.r_[True, (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])]
        sig, member = sig[keep], member[keep]
    at = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (3 * size[member[1:]] > 4 * size[member[:-1]])])
    n = np.diff(np.r_[at, len(sig)])
    two = at[n == 2]
    pairs = np.unique(member[two] * len(key) + member[two + 1])
    for a, b in zip((pairs // len(key)).tolist(), (pairs % len(key)).tolist(), strict=True):
        yield key[[a, b]].tolist(), size[[a, b]].tolist()
    seen = set()
    for a, c in zip(at[n > 2].tolist(), n[n > 2].tolist(), strict=True):
        m = member[a : a + c]
        if (raw := m.tobytes()) not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(raw)
            m = np.r_[m[c // 2], m[: c // 2], m[c // 2 + 1 :]]
            yield key[m].tolist(), size[m].tolist()


@frugal
def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in _groups_of(blobs):
            rows.append(row)
            held += len(row[0])
            if held > 200_000:
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["keys", "sizes"])
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["keys", "sizes"])

    now, held = None, []
    for batch in batches:
        for p, blob in zip(batch.column("p").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if p != now and held:
                yield from made(held)
                held = []
            now = p
            held.append(blob)
    if held:
        yield from made(held)


def _set_rows(k: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                found = [(key_of(h), h.tobytes()) for _, h in shingles(block, k) if len(h)]
                if found:
                    yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["key", "shingles"])

    return run


@frugal
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        similar = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            similar.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(similar, pa.bool_())], ["a", "b", "similar"])


@frugal
def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y, n, m in zip(batch.column("x"), batch.column("y"), batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True):
            keep.append(7 * least_difference(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= n + m)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Verifier:
    """Verifies pairs on whole sets, which it keeps in the shared folder for later rounds."""

    def __init__(self, known: DataFrame, plain: DataFrame, k: int):
        self.known, self.plain, self.k = known, plain, k
        self.sets: DataFrame | None = None

    def check(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similar) of those pairs (a, b) that sketches don't rule out. known: (key, id, n, sketch); plain: documents (id, text)."""
        x = self.known.select(F.col("key").alias("a"), "n", F.col("sketch").alias("x"))
        y = self.known.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
        close = written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(_close, "a long, b long"), "close", narrow=True)
        # whole sets that weren't needed before, each from one document
        keys = close.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        if self.sets is not None:
            keys = written(keys.join(self.sets.select("key"), "key", "left_anti"), "keys", narrow=True)
        if self.sets is None or not keys.isEmpty():
            holders = self.known.join(keys, "key").select("id").distinct()
            sets = self.plain.join(holders, "id", "left_semi").mapInArrow(_set_rows(self.k), "key long, shingles binary")
            sets = written(sets.join(keys, "key", "left_semi").dropDuplicates(["key"]), "members")
            self.sets = sets if self.sets is None else self.sets.union(sets)
        x, y = (self.sets.select(F.col("key").alias(c), F.col("shingles").alias(s)) for c, s in ("ax", "by"))
        return written(close.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long, similar boolean"), "links", narrow=True)


def likely_pairs(key: np.ndarray, size: np.ndarray, own: np.ndarray, sketches: list[bytes], asks: np.ndarray, answers: np.ndarray, apart: list, tries: int) -> tuple[np.ndarray, bool]:
    """Of each component (own) that asks, the `tries` pairs of the most alike sketches with members of others that answer and may be similar,
    as rows (smaller key, larger key); and whether there are more."""
    bits = [np.frombuffer(s, np.uint8) for s in sketches]
    width = np.array([len(b) for b in bits])
    stacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of_width(w: int) -> tuple[np.ndarray, np.ndarray]:
        if w not in stacked:
            members = np.flatnonzero(answers & (width >= w))
            stacked[w] = members, np.stack([folded(bits[j], w) for j in members]) if len(members) else np.zeros((0, w), np.uint8)
        return stacked[w]

    def asked(i: int) -> tuple[np.ndarray, int]:
        """Rows (less its slack, other key, own key) of member i, at most `tries`, the most alike first; and how many there are in all."""
        found = [np.zeros((0, 2), np.int64)]
        for w in (int(width[i]), int(width[i]) // 2):  # sizes of similar sets differ by a third, their widths by half at most
            if w < 8:
                continue
            members, folds = of_width(w)
            fits = (own[members] != own[i]) & (3 * np.maximum(size[i], size[members]) <= 4 * np.minimum(size[i], size[members]))
            if w < width[i]:
                fits &= width[members] == w
            fits = np.flatnonzero(fits)
            slack = size[i] + size[members[fits]] - 7 * np.bitwise_count(folds[fits] ^ folded(bits[i], w)).sum(axis=1, dtype=np.int64)
            keep = slack >= 0
            slack, other = slack[keep], key[members[fits[keep]]]
            if apart[i]:
                keep = ~np.isin(other, apart[i])
                slack, other = slack[keep], other[keep]
            found.append(np.stack([-slack, other], axis=1))
        rows = np.concatenate(found)
        return np.c_[rows[np.lexsort((rows[:, 1], rows[:, 0]))[:tries]], np.full(min(len(rows), tries), key[i])], len(rows)

    pairs, cut = [np.zeros((0, 2), np.int64)], False
    ask = np.flatnonzero(asks)
    ask = ask[np.argsort(own[ask], kind="stable")]
    for members in np.split(ask, np.flatnonzero(np.diff(own[ask])) + 1) if len(ask) else []:
        best, count = np.zeros((0, 3), np.int64), 0
        for i in members.tolist():
            rows, n = asked(i)
            best, count = np.concatenate([best, rows]), count + n
            if len(best) > 2 * tries or i == members[-1]:
                best = best[np.lexsort((best[:, 2], best[:, 1], best[:, 0]))[:tries]]
        pairs.append(np.sort(best[:, 1:], axis=1))
        cut |= count > tries
    return np.concatenate(pairs), cut


def _searched(tries: int):
    """(group, a, b, cut): pairs to verify, and whether their group has more of them."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def made() -> pa.RecordBatch:
            columns = [np.concatenate([h[c] for h in held]) for c in range(4)]
            return pa.record_batch([pa.array(c) for c in columns], ["group", "a", "b", "cut"])

        for rows in runs(batches, ["group", "asking", "answering"]):
            key, size, own, asks, answers = (rows.column(c).to_numpy() for c in ("key", "size", "component", "asks", "answers"))
            pairs, cut = likely_pairs(key, size.astype(np.int64), own, rows.column("small").to_pylist(), asks, answers, rows.column("apart").to_pylist(), tries)
            if len(pairs):
                held.append((np.full(len(pairs), rows.column("group")[0].as_py()), pairs[:, 0], pairs[:, 1], np.full(len(pairs), cut)))
                count += len(pairs)
            if count > 100_000:
                yield made()
                held, count = [], 0
        if held:
            yield made()

    return run


def _open_groups(wide: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wide (group, key, ...) with components, and of each group with several: its members n, the largest component, and members outside it."""
    wide = wide.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    sizes = wide.groupBy("group", "component").agg(F.count("*").alias("c")).groupBy("group")
    sizes = sizes.agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("main"))
    return wide, sizes.where("n > main.c").select("group", "n", F.col("main.component").alias("main"), F.expr("n - main.c").alias("rest"))


def _likely(wide: DataFrame, known: DataFrame, found: DataFrame, apart: DataFrame, tries: int) -> DataFrame:
    """(group, a, b, cut): pairs to verify next. A large group is compared in pieces of its asking by pieces of all its members.

    wide: (group, key, size); sketches join last, and travel once.
    """
    wide, opened = _open_groups(wide, found)
    asks = "component != main"
    rows = wide.join(opened, "group").withColumns({"t": F.ceil(F.col("n") / TOGETHER), "q": F.ceil(F.col("rest") / TOGETHER)})
    rows = rows.withColumns({"t_own": F.expr("pmod(key, t)"), "q_own": F.expr("pmod(key, q)")})
    answer = f"transform(sequence(0L, q - 1), i -> struct(i as asking, t_own as answering, {asks} and i = q_own as asks, true as answers))"
    ask = f"if({asks}, transform(filter(sequence(0L, t - 1), i -> i != t_own), i -> struct(q_own as asking, i as answering, true as asks, false as answers)), array())"
    rows = rows.select("group", "key", "size", "component", F.explode(F.expr(f"concat({answer}, {ask})")).alias("x")).select("*", "x.*").drop("x")
    both = apart.union(apart.select("b", "a")).groupBy(F.col("a").alias("key")).agg(F.collect_list("b").alias("apart"))
    sketches = known.select("key", F.coalesce("small", "sketch").alias("small")).join(both, "key", "left")
    rows = rows.join(sketches, "key").withColumn("apart", F.expr("if(asks, apart, null)"))
    at = ["group", "asking", "answering"]
    return rows.repartition(*at).sortWithinPartitions(*at).mapInArrow(_searched(tries), "group long, a long, b long, cut boolean")


def jaccard_components(docs: DataFrame, k: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs: components of documents whose shingle sets have a Jaccard of 0.75 or more.

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`. A set is the distinct shingles of k words; 1 to k - 1 words are one shingle. A
    text that is null or has no words has an empty set, linked with nothing. component_id is the smallest doc_id that links reach, the
    row's own at least. Null doc_ids rank last and stay null (so does component_id if all of a component are null). Rows that repeat
    give a row each. Other columns aren't read. An empty table gives an empty one. Shingles and sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    plain = docs.select(id_of(doc_id).alias("id"), text_of(text).alias("text"))
    rows = written(plain.mapInArrow(_sets(k), "id long, key long, n long, sketch binary, small binary, part int, counts binary"), "sets")
    cells = spark.sparkContext.broadcast(frequent(rows))  # CELLS flags
    owned = rows.where("part is null").drop("part", "counts")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = plain.select("text").mapInArrow(_signed(k, cells, min(FINER * tasks, 1 << 15)), "p int, blob binary")
    groups = written(blobs.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(_grouped, "keys array<long>, sizes array<int>"), "groups", narrow=True)
    fits = F.expr("3 * greatest(sizes[0], x.s) <= 4 * least(sizes[0], x.s)")
    pairs = groups.select("keys", "sizes", F.explode(F.expr("slice(transform(keys, (k, i) -> struct(k as k, sizes[i] as s)), 2, size(keys) - 1)")).alias("x")).where(fits)
    pairs = written(pairs.select(F.expr("keys[0]").alias("a"), F.col("x.k").alias("b")).distinct(), "pairs", narrow=True)
    known = owned.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("small").alias("small"))
    known = written(known, "known", narrow=True)
    verifier = Verifier(known, plain, k)
    checked = verifier.check(pairs)
    found = components(checked.where("similar").select("a", "b"))
    wide = groups.where("size(keys) > 2").select(F.xxhash64("keys").alias("group"), "keys", "sizes").dropDuplicates(["group"])
    wide = wide.select("group", F.explode(F.expr("transform(keys, (k, i) -> struct(k as key, sizes[i] as size))")).alias("m")).select("group", "m.key", "m.size")
    wide = written(wide, "wide", narrow=True)
    tries, apart = TRIES, checked.where("not similar").select("a", "b")
    while not (likely := written(_likely(wide, known, found, apart, tries), "likely", narrow=True)).isEmpty():
        pairs = likely.select("a", "b").distinct()
        checked = checked.union(verifier.check(pairs))
        found = components(checked.where("similar").select("a", "b"))
        cut = likely.where("cut").select("group").distinct()
        if cut.isEmpty():
            break
        wide = wide.join(cut, "group", "left_semi")  # the others have asked for all their pairs
        apart, tries = apart.union(pairs), MORE * tries
    keyed = known.select("key", F.col("id").alias("least")).join(found.withColumnRenamed("node", "key"), "key", "left")
    keyed = keyed.withColumn("component", F.coalesce("component", "key"))
    smallest = keyed.groupBy("component").agg(F.min("least").alias("smallest"))
    answer = owned.select("id", "key", "n").join(keyed.join(smallest, "component").select("key", "smallest"), "key", "left")
    return answer.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("smallest", "id"), F.lit(NO_ID)).alias("component_id"))
