"""Document fingerprints of closed syncmers, matched by their positions.

A k-mer of words is an anchor if its smallest inner word hash is its first or its last. Whether it is depends on the k-mer alone, so the
same passage has the same anchors in any context. A fingerprint holds all anchors and their places. Two fingerprints are matched by equal
anchors, and a match counts if the next match before or after it has nearly the same offset: so shared passages count, wherever they stand,
and anchors that agree by chance don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.llm.common import NO_ID, id_of, text_of

#: Words of a k-mer, bits of an anchor's number that hold its place (modulo these; one bit more tells sides apart), and words by which the
#: offsets of neighbouring matches may differ.
K, PLACE, STEP = 5, 20, 4
#: Rows of a bucket while rows are put in order, and buckets at most (one more pass over a longer list of cuts for each row beyond).
ROWS, MOST_BUCKETS = 20_000, 4096

_PLACES = (1 << PLACE) - 1


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array `out`: the anchors of a text, hash (43 bits) and place in one number each, sorted.

    A text without an anchor (of less than K words, and some of a few more) has one of all its words; one without words has none.
    """
    words, hashes, found = f"__words_{out}", f"__hashes_{out}", f"__found_{out}"
    df = df.withColumn(words, F.expr(rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w != '')"))
    df = df.withColumn(hashes, F.expr(f"transform({words}, w -> xxhash64(w))"))
    at = lambda i: f"get({hashes}, i + {i})"
    inner, whole = ", ".join(at(i) for i in range(1, K - 1)), ", ".join(at(i) for i in range(K))
    edge = f"least({at(0)}, {at(K - 1)}) <= least({inner})"
    number = lambda h, place: f"(shiftleft(shiftright({h}, {PLACE + 1}), {PLACE + 1}) | {place})"
    some = f"transform(filter(sequence(0, size({hashes}) - {K}), i -> {edge}), i -> {number(f'xxhash64({whole})', f'(i & {_PLACES}L)')})"
    df = df.withColumn(found, F.expr(f"if(size({hashes}) >= {K}, sort_array({some}), cast(array() as array<bigint>))"))
    all_words = number(f"xxhash64(array_join({words}, ' '))", "0L")
    df = df.withColumn(out, F.expr(f"if(size({found}) = 0 and size({words}) > 0, array({all_words}), {found})"))
    return df.drop(words, hashes, found)


def fingerprint_of(anchors: str) -> Column:
    """Anchors as text: hash (hex) and place of each."""
    return F.expr(f"array_join(transform({anchors}, x -> concat(hex(shiftrightunsigned(x, {PLACE + 1})), ':', x & {_PLACES}L)), ',')")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with `out`: of the distinct anchors of either array, the share that both have at offsets which a neighbouring match has too.

    Offsets are those of an anchor's first places, and may differ by STEP words. The only anchor of a text needs no neighbour. 1.0 if
    neither has any, 0.0 if one has.
    """
    first = lambda x: F.expr(f"filter({x}, (x, i) -> i = 0 or shiftright(x, {PLACE + 1}) != shiftright(get({x}, i - 1), {PLACE + 1}))")
    of_a, of_b, both, matches = (f"__{out}_{i}" for i in range(4))
    df = df.withColumns({of_a: first(a), of_b: first(b)})
    df = df.withColumn(both, F.expr(f"sort_array(concat({of_a}, transform({of_b}, x -> x | {1 << PLACE}L)))"))
    pair = f"if(shiftright(x, {PLACE + 1}) = shiftright(y, {PLACE + 1}), shiftleft(x & {_PLACES}L, {PLACE}) | (y & {_PLACES}L), null)"
    df = df.withColumn(matches, F.expr(f"sort_array(filter(zip_with({both}, slice({both}, 2, size({both})), (x, y) -> {pair}), m -> m is not null))"))
    offset = lambda m: f"(({m} & {_PLACES}L) - shiftright({m}, {PLACE}))"
    near = lambda i: f"coalesce(abs({offset('m')} - {offset(f'get({matches}, {i})')}) <= {STEP}, false)"
    agree = F.expr(f"if(least(size({of_a}), size({of_b})) = 1, size({matches}), size(filter({matches}, (m, i) -> {near('i - 1')} or {near('i + 1')})))")
    either = F.size(of_a) + F.size(of_b) - agree
    share = F.when(either == 0, F.lit(1.0)).otherwise(agree / F.greatest(either, F.lit(1)))
    return df.withColumn(out, share).drop(of_a, of_b, both, matches)


def with_next(rows: DataFrame, buckets: int, prepare, columns: list[str]) -> DataFrame:
    """prepare(rows) (id, text, ...) with next_<column> of the row that follows by id and text; the first follows the last.

    Rows are dealt by quantiles of id (at most `buckets` of them, found in one pass); each bucket also gets a copy of the row that the next
    one begins with, so that no order over all rows is needed. What prepare() adds doesn't travel.
    """
    quantiles = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(rows.agg(F.percentile_approx("id", quantiles, 10_000).alias("q")).first().q or [])) if quantiles else []
    bucket = F.expr(f"size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c <= id))") if cuts else F.lit(0)
    dealt = rows.withColumn("bucket", bucket)
    firsts = sorted((r.bucket, r.id) for r in dealt.groupBy("bucket").agg(F.min("id").alias("id")).collect())  # of each bucket one
    copies = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # the first row of all goes to the last bucket
    dealt = dealt.withColumn("late", F.lit(0))
    if copies:
        to = F.element_at(F.create_map(*[F.lit(x) for pair in copies.items() for x in pair]), F.col("id"))
        dealt = dealt.unionByName(rows.where(F.col("id").isin(*copies)).withColumn("bucket", to).withColumn("late", F.lit(1)))
    dealt = prepare(dealt.repartition(max(buckets, 1), "bucket"))
    w = Window.partitionBy("bucket").orderBy("late", "id", "text")
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return dealt.where("late = 0").drop("bucket", "late")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's,
    by ascending doc_id (repeated ids by text); after the last comes the first. near_* is the likeness to the edited text and to the next
    document. A null text is empty; a text without words has an empty fingerprint, which is like (1.0) another empty one only. Null
    doc_ids rank last and stay null. Rows that repeat follow each other. Other columns aren't read. An empty table gives no rows.
    """
    rows = docs.select(id_of(doc_id).alias("id"), text_of(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or min(MOST_BUCKETS, max(2 * parts, rows.count() // ROWS))
    rows = with_next(rows, n, lambda df: with_anchors(df, "text", "anchors"), ["text", "anchors"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_anchors(rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited).drop("text", "next_text"), "edited", "edited_anchors")
    rows = with_likeness(with_likeness(rows, "anchors", "edited_anchors", "near_edited"), "anchors", "next_anchors", "near_next")
    return rows.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint_of("anchors").alias("fingerprint"),
        fingerprint_of("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next",
    )
