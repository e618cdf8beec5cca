"""The corpus pipeline: language ID, n-gram Jaccard join, substring dedup, benchmark decontamination and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netscale.llm import language_id
from netscale.llm.common import id_of, table, text_of, written
from netscale.llm.decontamination import contaminated
from netscale.llm.jaccard_join import jaccard_components
from netscale.llm.packing import harmonic_pack
from netscale.llm.substring_dedup import substring_dedup

#: A document stays if the language it is taken for is at least this certain.
SURE = 0.5


def _by_text(docs: DataFrame) -> DataFrame:
    """docs with __key, by which rows of one text are known, whatever their doc_id is."""
    return docs.withColumn("__key", F.xxhash64(text_of()))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those whose language is in doubt: as like another one, or atypical of
    all. All labelled rows may be learnt from; without any, all documents go. Rows that repeat are judged alike; an empty table stays empty."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    judged = language_id.identify(docs, path, language_id.fit(docs, path, F.lit(True)))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the smallest doc_id, a null one last, of equal ones the smallest hash of text.

    Of rows that repeat one stays. Documents without words (null and empty texts too) are like nothing and stay. An empty table stays empty.
    """
    # texts are joined, not ids, which may be null or repeated
    docs = _by_text(docs)
    groups = jaccard_components(docs.select(F.col("__key").alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group")).distinct()
    rows = docs.select(id_of().alias("id"), "__key").join(groups, "__key", "left")
    best = rows.where("__group is not null").groupBy("__group").agg(F.min(F.struct("id", "__key")).alias("at")).select("at.*", F.lit(True).alias("words"))
    wordless = rows.where("__group is null").select("id", "__key").distinct().withColumn("words", F.lit(False))
    winners = written(best.unionByName(wordless), "winners", narrow=True)  # no texts
    kept = docs.join(winners, (id_of() == winners["id"]) & (docs["__key"] == winners["__key"]), "left_semi")
    # of rows that repeat, which are few if any, one stays
    counts = rows.join(winners.where("words"), ["id", "__key"], "left_semi").groupBy("id", "__key").count()
    repeated = written(counts.where("count > 1").select(F.col("id").alias("__id"), F.col("__key").alias("__same")), "repeated", narrow=True)
    if not repeated.isEmpty():
        twice = (id_of() == repeated["__id"]) & (kept["__key"] == repeated["__same"])
        kept = kept.join(repeated, twice, "left_anti").unionByName(kept.join(repeated, twice, "left_semi").dropDuplicates(["doc_id", "__key"]))
    return kept.drop("__key")


def recurring_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the words of windows that an earlier document has, and the documents that lose all their words.

    Null and empty texts stay as they are. Rows of one id, and those without, are treated as substring_dedup says; an empty table stays empty.
    """
    out = substring_dedup(docs).where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whatever their doc_id is: rows of one text go or stay together. Null texts stay."""
    docs = _by_text(docs)
    held = contaminated(docs.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__key")).distinct()
    return docs.join(held, "__key", "left_anti").drop("__key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 2048 tokens. Null texts have their end only; rows that repeat are packed each."""
    pieces = harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", recurring_passages),
    ("decontamination", no_benchmark),
    ("packing", packed),
]

#: SQL can't express language ID and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
