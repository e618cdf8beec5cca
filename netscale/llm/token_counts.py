"""Token counts through a cache keyed by digests of content and tokenizer version.

Documents join stored counts by digest. Only distinct misses travel with their text and are encoded; their counts are appended. Content is
normalised as the tokenizer does before its digest is taken, where that is nothing to do; for any other tokenizer the digest is of the text
itself, a finer key that never mixes texts up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netscale.llm.common import SEEN, blocks, frugal, text_of

#: Words whose counts a worker remembers.
CACHED = 200_000


class Counter:
    """Tokens of a text as the library gives them: sentencepiece for .model files, tokenizers for .json files."""

    def __init__(self, path: str):
        self.kept: dict[str, int] = {}
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_word = self._words_apart()
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()

    def _words_apart(self) -> bool:
        """Whether no piece has a space after anything else and texts aren't changed first, so that words are coded apart."""
        p = self.pieces
        apart = all("▁" not in p.id_to_piece(i).lstrip("▁") for i in range(p.get_piece_size()))
        probe = "  á Ａ é  ﬁ\té\n ① "
        return apart and p.decode(p.encode(probe)) == probe and p.encode(" a", out_type=str)[:1] == ["▁"]

    def of_pieces(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.pieces.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if not hasattr(self, "pieces"):
            return [len(self.library.encode(t, add_special_tokens=False).ids) for t in texts]
        if not self.by_word:
            return self.of_pieces(texts)
        if len(self.kept) > CACHED:
            self.kept.clear()
        kept = self.kept
        split = [t.split(" ") for t in texts]
        # a run of spaces belongs to the word after it; such texts are coded as a whole
        plain = ["" not in words and "▁" not in t and "\0" not in t for words, t in zip(split, texts, strict=True)]
        new = list({w for words, p in zip(split, plain, strict=True) if p for w in words if w not in kept})
        kept.update(zip(new, self.of_pieces(new), strict=True))
        rest = iter(self.of_pieces([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [sum([kept[w] for w in words]) if p else next(rest) for words, p in zip(split, plain, strict=True)]


@lru_cache(2)
def counter_of(path: str) -> Counter:
    """One for all tasks of a worker."""
    return Counter(path)


@frugal
def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each digest of this task once, so that a text of very many documents doesn't meet in one task."""
    seen: set[str] = set()
    for batch in batches:
        keep = []
        for d in batch.column("digest").to_pylist():
            keep.append(d not in seen)
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(d)
        yield batch.filter(pa.array(keep))


def _encode(path: str, version: str):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in _once(batches):
            for block in blocks(batch, "text"):
                n = counter.counts(block.column("text").to_pylist())
                yield pa.record_batch([block.column("digest"), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return run


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(p)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), each replacing a column of its name.

    tokenizer: a file that driver and executors have; no begin, end or added special tokens, truncation or padding. cache: a folder
    (of any store Spark reads) with the counts by content and tokenizer digest; distinct texts that it lacks are encoded whole and
    appended. A null text counts as empty: 0 bytes, and the tokens of the empty text. Repeated rows and all other columns stay as they
    are, and an empty table gives an empty one. Two calls that append at once may store a count twice; reading takes each digest once.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    schema = "digest string, tokenizer string, n_tokens long"
    names = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    content = docs.select(F.sha2(text_of(text).cast("binary"), 256).alias("digest"), text_of(text).alias("text"))
    if _exists(docs, cache):
        stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version)
        content = content.join(stored, "digest", "left_anti")
    missed = content.mapInArrow(_once, content.schema).repartition("digest").mapInArrow(_encode(tokenizer, version), schema)
    missed.write.mode("append").parquet(cache)
    stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("__n"))
    rows = docs.select(*names, F.octet_length(text_of(text)).cast("long").alias("n_bytes"), F.sha2(text_of(text).cast("binary"), 256).alias("__digest"))
    joined = rows.join(stored.withColumnRenamed("digest", "__digest"), "__digest", "left")
    return joined.select(*names, "n_bytes", F.col("__n").alias("n_tokens"), (F.col("__n") > limit).alias("over_limit"))
