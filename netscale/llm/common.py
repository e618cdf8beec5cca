"""Helpers shared by the operators: shared storage, document keys and vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A null doc_id ranks after every other one.
NO_ID = 2**63 - 1
#: The bytes of [\x20\x09-\x0D].
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Keys that a task remembers so as not to send them twice.
SEEN = 1_000_000
#: At most this many bytes of text are hashed at a time (a longer single text is one block).
BLOCK = 2_000_000

#: Files of a narrow table for each core of the cluster, and how many partitions of a shuffle become one if that makes more.
FILES, TOGETHER = 2, 8

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local session that names none gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="netscale-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd", narrow: bool = False) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and survives lost executors. Its shuffle files go once it's written.

    narrow: of ids and hashes, without texts, so TOGETHER partitions are one file, as creating a file costs more than its rows.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if narrow:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(FILES * spark.sparkContext.defaultParallelism, tasks // TOGETHER, 1))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(clean, was)
    return spark.read.schema(df.schema).parquet(path)


def frugal(run):
    """A function of batches that gives memory back when its task ends: workers live on for other tasks, and what they hold adds up."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """What the allocators hold without need goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_of(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def extended(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    """schema with more columns; one that is there already is replaced."""
    names = {n for n, _ in more}
    return T.StructType([*(f for f in schema.fields if f.name not in names), *(T.StructField(n, t) for n, t in more)])


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if base not in kept or len(kept[base]) < n:
        p = np.full(max(n, BLOCK + 65536), base, np.uint64)
        p[0] = 1
        kept[base] = np.multiply.accumulate(p)
    return kept[base][:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offset of each, with the end as the last one."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, name: str, size: int = BLOCK):
    """Slices of a batch that hold about `size` bytes of text each."""
    _, at = utf8(batch.column(batch.schema.get_field_index(name)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """A table for each run of rows that agree on the columns `names` (without nulls), whatever batches it spans."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        for a, b in itertools.pairwise([0, *np.flatnonzero(new).tolist(), batch.num_rows]):
            head = tuple(c[a] for c in columns)
            if head != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = head
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Words:
    """Words of a block of texts: where each starts and ends, whose it is, and a 64-bit hash of it.

    gap: of each byte, whether it lies between words; or its kind, where words are runs of one kind and 0 lies between words.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE):
        self.data, self.at, n = data, at, len(data)
        inside = np.zeros(n + 2, np.int8)
        inside[1 : n + 1] = ~gap[data] if gap.dtype == bool else gap[data]
        edge = np.zeros(n + 1, bool)  # between bytes i-1 and i, a text ends
        edge[at] = True
        now, before = inside[1 : n + 2], inside[: n + 1]
        self.start = np.flatnonzero((now > 0) & ((before != now) | edge))
        self.end = np.flatnonzero((before > 0) & ((now != before) | edge))
        self.doc = np.searchsorted(at, self.start, "right") - 1
        self.first = np.searchsorted(self.start, at, "left")  # of each text's words; texts without any share it

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * _powers(_BASE_INV, n + 1)[self.start])

    def grams(self, hashed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text. Shorter by k - 1 than hashed."""
        n = max(0, len(hashed) - k + 1)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xFF51AFD7ED558CCD) + hashed[j : n + j]
        return mix(out), self.doc[:n] == self.doc[k - 1 :]


def words_of(texts: pa.Array, gap: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, at = utf8(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return Words(data, at, gap)
