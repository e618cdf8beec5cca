"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netscale.llm import decontamination, jaccard_join, language_id, license_scan, packing, substring_dedup, syncmers, token_counts
from netscale.llm.components import components
from netscale.llm.decontamination import contaminated

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def order(i):
    return 2**63 - 1 if i is None else i


# --- packing -------------------------------------------------------------------------------------------------------------------


def test_packing(docs, rows):
    library = Tokenizer.from_file(BPE)
    got = packing.harmonic_pack(docs.repartition(3), BPE).toPandas()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids)] += 1
    assert sum(want.values()) == len(rows) and got["length"].sum() == sum(n * k for (_, n), k in want.items())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.r_[0, np.cumsum(own["length"])[:-1]]).all() and own["length"].sum() <= 2048
    once = {i: t for i, t in rows if i is not None and sum(i == j for j, _ in rows) == 1}
    for i, t in once.items():
        own = got[got["doc_id"] == i].sort_values("start")
        raw = b"".join(own["ids"])
        assert list(np.frombuffer(raw, "<u4")) == [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (own["start"].to_numpy() == np.r_[0, np.cumsum(own["length"])[:-1]]).all() and set(own["doc_tokens"]) == {len(raw) // 4}
    assert packing.harmonic_pack(docs.limit(0), BPE).count() == 0


def test_packing_pads_little():
    rng, bins = random.Random(1), packing.Bins(2048, 0)
    rows = [r for d in range(3000) for r in bins.add(d, np.zeros(int(rng.lognormvariate(6, 1.2)) + 1, "<u4"))]
    rows += bins.close()
    size = Counter()
    for _, _, n, _, _, s, _ in rows:
        size[s] += n
    padding = sum(2048 - n for n in size.values() if n & (n - 1))
    assert padding < 0.01 * sum(size.values()) and len(rows) < 4 * 3000


@pytest.mark.parametrize("n", [1, 5, 63, 64, 65, 300, 1000, 1024, 2047, 2048, 2049, 10_000])
def test_cuts(n):
    parts = list(packing.cuts(n, 2048))
    assert sum(parts) == n and all(p > 0 for p in parts)


def test_coders_equal_the_libraries():
    rng = random.Random(2)
    letters = [chr(i) for i in range(0x20, 0x180)] + list("\n\t 　ſİΣς①ﬁ日本́\x1c\x85ßK") + ["'ll", "<|endoftext|>", "</s>", "▁", "  "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    coder, library = packing.Encoder(BPE), Tokenizer.from_file(BPE)
    assert coder.fast and all(list(np.frombuffer(coder.ids(t), np.uint32)) == library.encode(t, add_special_tokens=False).ids for t in texts)
    counter, pieces = token_counts.Counter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert counter.by_word and counter.counts(texts) == [len(x) for x in pieces.encode(texts, num_threads=1)]


# --- token counts --------------------------------------------------------------------------------------------------------------


def test_token_counts_and_cache(spark, docs, rows, tmp_path):
    pieces, cache = sentencepiece.SentencePieceProcessor(model_file=PIECES), f"{tmp_path}/cache"
    some = token_counts.token_counts(docs.where("doc_id < 20"), PIECES, cache, limit=50)
    assert some.columns == [*docs.columns, "n_bytes", "n_tokens", "over_limit"]
    stored = spark.read.parquet(cache).count()
    out = token_counts.token_counts(docs, PIECES, cache, limit=50).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = Counter((i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 50) for i, t in rows)
    assert Counter(map(tuple, out)) == want
    assert stored < spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    token_counts.token_counts(docs, PIECES, cache)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert token_counts.token_counts(docs.limit(0), PIECES, f"{tmp_path}/none").count() == 0


# --- substring dedup -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [2, 1000])
def test_substring_dedup(docs, rows, hot):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(order(i), first.get(tuple(w[k : k + 13]), 2**63))
    want = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order(i):
                gone.update(range(k, k + 13))
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone) if t is not None else None] += 1
    out = substring_dedup.substring_dedup(docs, hot_docs=hot)
    assert set(out.columns) == {*docs.columns, "n_removed"}
    got = Counter((r.doc_id, r.n_words, r.n_removed, None if r.text is None else " ".join(words(r.text))) for r in out.collect())
    assert got == want
    whole = {(i, t) for i, t in rows}
    assert all((r.doc_id, r.text) in whole for r in out.where("n_removed = 0").collect())
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_passages_are_found_by_the_automaton_alone(monkeypatch):
    texts = ["a b c d e f", "x b c d e f", "b c d e y z", "q q b c d", "p a b c d e f"]
    table = pa.table([pa.array([1] * 5), pa.array(range(5)), pa.array(texts), pa.array([5, 6, 7, 8, 9]), pa.array([5, 6, 7, 8, 9])], ["shard", "seg", "text", "least", "most"])
    got = substring_dedup._located(table, 3).to_pydict()
    covered = {s: {k for a, b, low in zip(o, e, w, strict=True) for k in range(a, b - 2) if low < 5 + s} for s, o, e, w in zip(got["seg"], got["offs"], got["ends"], got["lows"], strict=True)}
    first, want = {}, defaultdict(set)
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 2):
            if first.setdefault(tuple(w[k : k + 3]), i) < i:
                want[i].add(k)
    assert {s: c for s, c in covered.items() if c} == want
    # windows that always stand together are one passage
    words_ = pc.split_pattern(table["text"].combine_chunks(), " ")
    code, at = words_.flatten().dictionary_encode().indices.to_numpy().astype(np.int64), words_.offsets.to_numpy().astype(np.int64)
    a, b, _ = substring_dedup.passages_of(code, at, np.arange(5), np.arange(5), 3)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 2), (1, 3), (2, 4), (3, 5)]

    blind = SimpleNamespace(add_word=lambda *_: True, make_automaton=lambda: None, iter=lambda _: [(2, 0)])
    monkeypatch.setattr(substring_dedup, "ahocorasick", SimpleNamespace(Automaton=lambda *_: blind, STORE_INTS=0, KEY_SEQUENCE=0))
    assert substring_dedup._located(table, 3).to_pydict() != got


# --- Jaccard join --------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets, top = [], list(range(len(rows)))
    for _, t in rows:
        w = words((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                top[find(a)] = find(b)
    low = defaultdict(lambda: 2**63)
    for a, (i, _) in enumerate(rows):
        low[find(a)] = min(low[find(a)], order(i))
    return Counter((i, len(sets[a]), None if low[find(a)] == 2**63 - 1 else low[find(a)]) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("frequent", [4, 0])
def test_jaccard_components(docs, rows, frequent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "AT_LEAST", 3 if not frequent else 64)
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs).collect())) == brute_components(rows)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_signatures_find_every_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        s = int(rng.integers(1, 90))
        a = np.unique(rng.integers(0, 2**64 - 1, s, dtype=np.uint64))
        most = len(a) // 4
        gone, new = rng.integers(0, most + 1), rng.integers(0, most + 1)
        b = np.unique(np.r_[a[gone:], rng.integers(0, 2**64 - 1, new, dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        hot = rng.random() < 0.5
        flags = lambda x: (x % np.uint64(3) == 0) if hot else np.zeros(len(x), bool)  # noqa: E731, B023
        assert len(np.intersect1d(jaccard_join.signatures(a, flags(a)), jaccard_join.signatures(b, flags(b))))
        x, y = (np.frombuffer(jaccard_join.sketch_of(v), np.uint8) for v in (a, b))
        assert jaccard_join.least_difference(x, y) <= len(a) + len(b) - 2 * both


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(3, 3), (1, 0)], "a long, b long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, i // 10 * 10) for i in range(40)}


# --- language ID ---------------------------------------------------------------------------------------------------------------


def brute_word(pieces, p, word):
    """Log of the sum over all segmentations of a marked word, by logarithms."""
    number, word = {s: i for i, s in enumerate(pieces.names)}, f"▁{word}"
    upto = [0.0] + [-np.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - pieces.longest), j):
            q = p[number[word[i:j]]] if word[i:j] in number else 0.0
            if q := max(q, language_id.UNKNOWN) if j - i == 1 else q:
                upto[j] = np.logaddexp(upto[j], upto[i] + np.log(q))
    return upto[-1]


def test_forward_sums_all_segmentations():
    pieces = language_id.pieces_of(PIECES)
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert pieces.longest == max(len(vocabulary.id_to_piece(i)) for i in range(vocabulary.get_piece_size()) if not vocabulary.is_control(i) and not vocabulary.is_byte(i))
    rng = np.random.default_rng(0)
    p = np.c_[np.r_[rng.random(pieces.size) / pieces.size, 0], np.r_[rng.random(pieces.size) ** 9 / pieces.size, 0]]
    words_ = ["the", "maison", "Straße", "日x", "International", "x", "responsibility" * 9, "日本語の文字" * 40, "é" * 3000, "internationalrepresentation", "", "\ud800"]
    got = pieces.spots(words_).likelihoods(p)
    for word, row in zip(words_, got, strict=True):
        assert np.allclose(row, [brute_word(pieces, p[:, k], word) for k in range(2)], rtol=1e-9)
    assert pieces.spots([]).likelihoods(p).shape == (0, 2)
    for s in rng.choice(pieces.names, 300):
        assert pieces.names[pieces.piece[pieces._find(np.array([pieces._hash(s)], np.uint64))[0]]] == s


def test_expected_counts_of_words_of_any_length():
    """Against sums over all segmentations by logarithms, forwards and backwards."""
    pieces = language_id.pieces_of(PIECES)
    number = {s: i for i, s in enumerate(pieces.names)}
    rng = np.random.default_rng(1)
    p = np.r_[rng.random(pieces.size) ** 9 / pieces.size, 0][:, None]
    words_ = ["the", "Straße", "responsibilities", "x" * 15, "x" * 16, "x" * 17, "internationalrepresentation", "日本語の文字列" * 20, "naïveté" * 43, "\ud800", "é" * 300]
    counts = np.arange(1, len(words_) + 1)
    want = np.zeros(len(p))
    for w, n in zip(words_, counts, strict=True):
        w = f"▁{w}"
        steps = []
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + pieces.longest) + 1):
                k = number.get(w[i:j], pieces.size)
                q = max(p[k, 0], language_id.UNKNOWN) if j == i + 1 else p[k, 0]
                if q:
                    steps.append((i, j, k, np.log(q), p[k, 0] / q))
        upto, after = np.full(len(w) + 1, -np.inf), np.full(len(w) + 1, -np.inf)
        upto[0] = after[-1] = 0
        for i, j, _, q, _ in sorted(steps, key=lambda s: s[1]):
            upto[j] = np.logaddexp(upto[j], upto[i] + q)
        for i, j, _, q, _ in sorted(steps, key=lambda s: -s[0]):
            after[i] = np.logaddexp(after[i], after[j] + q)
        for i, j, k, q, known in steps:
            want[k] += n * np.exp(upto[i] + q + after[j] - upto[-1]) * known
    got = pieces.spots(words_).expected(p, counts)
    assert np.allclose(got, want, rtol=1e-8, atol=1e-12)
    # one character after another: all pieces of a word add up to its characters and mark
    size = np.array([len(s) for s in [*pieces.names, ""]])
    uniform = np.r_[np.full(pieces.size, 1 / pieces.size), 0.0][:, None]
    ascii_ = [(w, n) for w, n in zip(words_, counts, strict=True) if w.isascii()]
    seen = pieces.spots([w for w, _ in ascii_]).expected(uniform, np.array([n for _, n in ascii_]))
    assert np.isclose((seen * size).sum(), sum(n * (len(w) + 1) for w, n in ascii_))


def test_language_id(spark):
    rng = random.Random(4)
    vocabulary = {"en": "the of and thing there water other about".split(), "fr": "le la eau être où très chez depuis".split(), "de": "der die und nicht straße über schön".split()}
    data = [(i, " ".join(rng.choices(vocabulary[k], k=20)), k) for i, k in enumerate(list(vocabulary) * 40)]
    data += [(900, None, "en"), (901, "", None), (902, "123 !?", "fr"), (903, "x" * 5000, None), (904, "the water", None), (905, "日本語" * 50, None), (906, "a\u0301b" * 9, None), (None, "der die", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = language_id.fit(df, PIECES, F.col("doc_id") % 4 != 2, rows=20)
    assert model.languages == ["de", "en", "fr"] and np.allclose(model.p.sum(axis=0), 1)
    got = {r.doc_id: r for r in language_id.identify(df, PIECES, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in data[:120]) and all(0.5 < got[i].score <= 1 for i in range(120))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred == "en" and got[904].score > 0.5
    assert max(got[i].score for i in (900, 901, 902, 903, 905, 906)) < 0.5
    # as by brute force
    pieces = language_id.pieces_of(PIECES)
    for i, t, _ in [*data[:9], *data[-5:]]:
        each = [sum(brute_word(pieces, model.p[:, k], w) for w in t.split()) for k in range(3)]
        n = sum(len(w) + 1 for w in t.split())
        k = int(np.argmax(each))
        none = n * (model.mean[k] - language_id.ATYPICAL * np.sqrt(model.between[k] + model.within[k] / n))
        sure = 1 / sum(np.exp(min((x - each[k]) * min(1, language_id.STRETCH / n), 700)) for x in [*each, none])
        assert got[i].lang_pred == model.languages[k] and np.isclose(got[i].score, sure, rtol=1e-6)
    none = language_id.fit(df.limit(0), PIECES, F.lit(True))
    assert none.languages == [] and {r.lang_pred for r in language_id.identify(df, PIECES, none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), PIECES, model).count() == 0


def test_stretches_have_all_words():
    rng = random.Random(6)
    for most in (1, 7, 30, 1000):
        text = " \n".join("é" * rng.randint(1, 9) for _ in range(50))
        found = list(language_id.stretches(text, most))
        assert " ".join(found).split() == text.split() and all(len(x.encode()) <= most or " " not in x for x in found)
    assert list(language_id.stretches(" \t", 5)) == []


def test_pipeline_keeps_languages_of_long_texts(spark, tmp_path):
    """A language whose labelled texts are all longer than what is learnt from at once is learnt, and its texts stay."""
    import corpus_pipeline

    rng = random.Random(14)
    english, french = "the of and thing there water other about".split(), "le la eau être où très chez depuis".split()
    say = lambda some, n: " ".join(rng.choices(some, k=n))
    rows = [(i, say(english, 20), "en") for i in range(30)] + [(100 + i, say(french, 45_000), "fr") for i in range(2)] + [(200 + i, say(french, 20), None) for i in range(10)]
    assert len(rows[30][1].encode()) > 200_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, str(tmp_path)).select("doc_id").collect()} == {r[0] for r in rows}
    model = language_id.fit(docs, PIECES, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs.where("doc_id >= 100"), PIECES, model).collect()} == {"fr"}


def test_pipeline_keeps_others_beside_copies(spark, tmp_path):
    """Copies of one text, however many, leave room for the other texts of its language."""
    import corpus_pipeline

    rng = random.Random(15)
    english, german = "the of and thing there water other about".split(), "der die und nicht straße über schön".split()
    say = lambda some: " ".join(rng.choices(some, k=20))
    texts = [say(english) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, say(german), "de") for i in range(30)]
    least = spark.createDataFrame([(f"{i} {7 * i} {11 * i} {13 * i} x",) for i in range(3000)], "text string").orderBy(F.xxhash64("text")).first().text
    rows += [(1000 + i, least, "de") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, str(tmp_path)).select("doc_id").collect()} == {r[0] for r in rows}
    model = language_id.fit(docs, PIECES, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, PIECES, model).collect()}
    assert all(got[i] == ("en" if i < 100 else "de") for i in got)


# --- syncmers ------------------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, rows):
    ranked = sorted(rows, key=lambda r: (order(r[0]), r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(ranked):
        t, after = t or "", ranked[(k + 1) % len(ranked)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    out = syncmers.fingerprints(docs, buckets=5).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    prints = defaultdict(set)
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for i, t in rows:
            if i == r.doc_id:
                prints[t or ""].add(r.fingerprint) if i is not None else None
    assert all(len(v) == 1 for t, v in prints.items())
    assert syncmers.fingerprints(docs.limit(0)).count() == 0
    one = syncmers.fingerprints(docs.where("doc_id = 301")).first()
    assert one.near_next == 1.0 and one.near_edited > 0.2


def read_print(text):
    """(hash, place) of a fingerprint, and the first place of each hash."""
    pairs = [(h, int(i)) for h, i in (x.split(":") for x in text.split(",") if x)]
    first = {}
    for h, i in pairs:
        first[h] = min(i, first.get(h, i))
    return pairs, first


def brute_likeness(a, b, positions=True):
    a, b = read_print(a)[1], read_print(b)[1]
    shared = sorted((a[h], b[h]) for h in a.keys() & b.keys())
    offset = [y - x for x, y in shared]
    agree = [any(0 <= j < len(offset) and abs(offset[i] - offset[j]) <= syncmers.STEP for j in (i - 1, i + 1)) for i in range(len(offset))]
    n = sum(agree) if positions and min(len(a), len(b)) != 1 else len(shared)
    return n / (len(a) + len(b) - n) if a or b else 1.0


def test_likeness_is_positional(spark):
    rng = random.Random(8)
    base = [f"v{rng.randrange(500)}" for _ in range(400)]
    shuffled = [base[i : i + 5] for i in range(0, 400, 5)]
    rng.shuffle(shuffled)
    texts = [" ".join(base), " ".join(["new"] * 50 + base[100:200] + ["old"] * 30), " ".join(w for x in shuffled for w in x), "", "one two", "one two", " ".join(base[:5]), "one two three four five", " ".join(base[:6] * 9)]
    pairs = [(x, y) for x in texts for y in texts]
    df = spark.createDataFrame(pairs, "x string, y string")
    df = syncmers.with_likeness(syncmers.with_anchors(syncmers.with_anchors(df, "x", "a"), "y", "b"), "a", "b", "near")
    rows = df.select("x", "y", "near", syncmers.fingerprint_of("a").alias("fa"), syncmers.fingerprint_of("b").alias("fb")).collect()
    for r in rows:
        assert abs(r.near - brute_likeness(r.fa, r.fb)) < 1e-12 and (r.x != r.y or r.near == 1.0)
    by = {(r.x, r.y): r for r in rows}
    inside = by[texts[0], texts[1]]
    assert 0.15 < inside.near < 0.35 and abs(inside.near - by[texts[1], texts[0]].near) < 1e-12
    # equal anchors at other places don't count: without positions the answer is another
    loose = by[texts[0], texts[2]]
    assert loose.near < brute_likeness(loose.fa, loose.fb, positions=False)
    assert by[texts[0], ""].near == 0.0 and by["", ""].near == 1.0


def test_texts_of_few_words_have_anchors(spark):
    rng = random.Random(3)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(n)) for n in (1, 4, 5, 6, 7) for _ in range(40)]
    out = syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), buckets=3).collect()
    assert len(out) == 200 and all(r.fingerprint for r in out) and all(r.near_next == 0.0 for r in out)


def test_near_columns(docs, rows):
    out = syncmers.fingerprints(docs, buckets=5).collect()
    ranked = sorted(rows, key=lambda r: (order(r[0]), r[1] or ""))
    print_of = {(r.doc_id, r.n_chars): r.fingerprint for r in out if r.doc_id is not None}
    for r in out:
        assert abs(r.near_edited - brute_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
    once = [k for k, (i, _) in enumerate(ranked[:-1]) if i is not None and ranked[k + 1][0] is not None and sum(i == j for j, _ in ranked) == 1]
    by = {r.doc_id: r for r in out}
    for k in once:
        (i, _), (j, t) = ranked[k], ranked[k + 1]
        assert abs(by[i].near_next - brute_likeness(by[i].fingerprint, print_of[j, len(t or "")])) < 1e-12


def test_anchors_are_closed_syncmers_and_context_free(spark):
    rng = random.Random(6)
    text = " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))
    df = spark.createDataFrame([("a b c " + text,), (text + " z y",)], "text string")
    rows = syncmers.with_anchors(df, "text", "anchors").withColumn("h", F.expr("transform(filter(split(text, ' '), w -> w != ''), w -> xxhash64(w))")).collect()
    found = []
    for r in rows:
        at = [i for i in range(len(r.h) - 4) if min(r.h[i : i + 5]) in (r.h[i], r.h[i + 4])]
        assert sorted(x & (2**20 - 1) for x in r.anchors) == at and len(r.anchors) > 64  # all of them
        found.append({x >> 21 for x in r.anchors})
    assert len(found[0] & found[1]) >= len(found[1]) - 3


# --- license scan --------------------------------------------------------------------------------------------------------------

LICENSES = [
    (1, "Under the MIT License, or the Apache-License; MIT\nlicense."), (2, "GNU General Public LICENSE v3"), (3, "mit licenses; apache; general public"), (4, None), (5, ""),
    (6, "Licensed under the Apache License, Version 2.0."), (7, "x " * 5000 + "mit license"), (1, "Under the MIT License, or the Apache-License; MIT\nlicense."),
    (8, "éMIT license K mit lıcense"), (9, "Redistribution and use in source or binary forms, with or without modification, are permitted provided that the conditions are met"), (None, "mit license"),
]


def test_license_scan(spark):
    want = []
    for i, t in LICENSES:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
        at = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    df = spark.createDataFrame([(i, t, "mit", 3) for i, t in LICENSES], "doc_id long, text string, label string, words int")
    out = license_scan.scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == Counter(want)
    for r in out:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in out}
    assert by[9].labels == "bsd" and by[9].n_base == 0 and by[3].labels == "" and by[6].labels == "apache"
    assert license_scan.scan(df.limit(0)).count() == 0


def test_spans_are_verified_and_null_ids_kept_apart(spark):
    wanted = next(t for t, label in license_scan.TEMPLATES if label == "bsd")
    words_ = wanted.split()
    scattered = " ".join(w + (" x y" if i % 4 == 3 else "") for i, w in enumerate(words_))  # votes on few diagonals, but with foreign words between
    rows = [(1, wanted), (2, wanted.replace("source and", "source code and")), (3, scattered), (4, " ".join(reversed(words_))), (None, "mit license"), (0, "mit license"), (None, "mit license"), (5, " ".join(words_[:9]))]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    by = {r.doc_id: r for r in out}
    assert by[1].labels == by[2].labels == "bsd" and by[1].score == 1.0 and by[0].labels == by[None].labels == "mit" and by[0].n_base == 1
    assert by[3].score >= license_scan.SHARE and by[3].labels == "" and by[4].labels == "" and by[5].labels == ""


def brute_spans(text):
    """Labels and score of templates, word by word."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOW))
    labels, score = set(), 0.0
    for phrase, label in license_scan.PHRASES:
        n = len(phrase.split())
        if any(w[k : k + n] == phrase.split() for k in range(len(w))):
            labels.add(label)
            score = 1.0
    at = defaultdict(list)
    for k in range(len(w) - 1):
        at[w[k], w[k + 1]].append(k)
    for text_, label in license_scan.TEMPLATES:
        t = text_.split()
        grams = [p for p in range(len(t) - 1) if not license_scan.COMMON.issuperset(t[p : p + 2])]
        hits = [(k - p, p) for p in grams for k in at[t[p], t[p + 1]]]
        for middle in {d for d, _ in hits}:
            best = {}
            for d, p in hits:
                if abs(d - middle) <= license_scan.WIDE:
                    best[p] = min(best.get(p, (99, 0)), (abs(d - middle), d))
            share = len(best) / len(grams)
            here = {d + p + k for p, (_, d) in best.items() for k in range(2)}
            there = {p + k for p in best for k in range(2)}
            alike = min(len(here), len(there)) / max(max(here) - min(here) + 1, max(there) - min(there) + 1)
            score = max(score, share)
            if share >= license_scan.SHARE and alike >= license_scan.ALIKE:
                labels.add(label)
    return ",".join(sorted(labels)), score


def test_templates_among_repeats_and_edits(spark):
    """A verbatim template is found whatever repeats stand around it, whole licenses too; all as by brute force."""
    rng = random.Random(12)
    rows, own = [], {}
    for i, (text, label) in enumerate(license_scan.TEMPLATES):
        w = text.split()
        part = " ".join(w[:2])
        for j, (before, after) in enumerate([(f"{part} " * 12, ""), (f"{part} " * 2, ""), ("", f" {' '.join(w[-3:])}" * 9), (f"{' '.join(w[:3])} x " * 5, f" {part}" * 7)]):
            own[10 * i + j] = label
            rows.append((10 * i + j, f"{before}{text}{after}"))
        edited = list(w)
        for _ in range(max(1, len(w) // 25)):  # a word more, fewer, or another
            k = rng.randrange(1, len(edited) - 1)
            edited[k : k + rng.choice([0, 1])] = rng.choice([["other"], []])
        rows.append((10 * i + 5, " ".join(edited)))
        shuffled = list(w)
        rng.shuffle(shuffled)
        rows.append((10 * i + 6, " ".join(shuffled)))
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert (out[i].labels, round(out[i].score, 12)) == (lambda x: (x[0], round(x[1], 12)))(brute_spans(text))
    assert all(label in out[i].labels.split(",") and out[i].score == 1.0 for i, label in own.items())
    assert max(len(t.split()) for t, _ in license_scan.TEMPLATES) > 150


# --- decontamination -----------------------------------------------------------------------------------------------------------

ITEM = "A train leaves Boston at 60 km and meets Alice after she has walked for 3 hours along the river, so how many km are left between Boston and them?"
OTHER = "a train leaves Denver at 75 km and meets Robert after she has walked for 8 hours along the river, so how many km are left between Denver and them?"
MIXED = "A train leaves Denver at 75 km and meets Robert after she has walked for 8 hours along the river, so how many km are left between Paris and them?"


def test_contaminated(spark):
    bench = spark.createDataFrame([(1, ITEM, 0), (2, "Too short", 0), (3, None, 0), (4, "the cat sat on the mat and looked at the dog for a while", 0), (1, ITEM, 1)], "item_id long, text string, n int")
    rows = [(10, f"Some text. {ITEM} More."), (11, f"Before it\n{OTHER}"), (12, "nothing of the kind " * 20), (13, None), (14, ""), (15, ITEM.upper()), (16, "the cat sat on the mat and looked at the dog for a while"), (10, f"Some text. {ITEM} More.")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, h int")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert set(got) >= {(10, 1), (11, 1), (16, 4)} and {i for i, _ in got} <= {10, 11, 15, 16}
    assert got[10, 1].n_changed == 0 and got[11, 1].n_changed >= 3 and got[16, 4].coverage == 1
    # windows whose slots contradict the others don't count: Boston is Denver in more windows than it is Paris
    mixed = contaminated(spark.createDataFrame([(20, MIXED)], "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.item_id) for r in mixed] == [(20, 1)] and mixed[0].coverage < got[11, 1].coverage == 1
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_contaminated_by_items_without_template_windows(spark):
    items = [(1, "What is 3 plus 4?"), (2, "12 34 Paris 56 Rome 7 Oslo 89 10 Bern"), (3, ITEM), (4, "Too short"), (5, "?!"), (6, "7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(10, "They asked: what is 3 plus 4?"), (11, "see 12 34 paris 56 ROME 7 oslo 89 10 BERN."), (12, ITEM.upper()), (13, ITEM.lower()), (14, "this is TOO SHORT now")]
    rows += [(15, "what is 6 plus 9, then"), (16, "too long and short of it, 12 of 70"), (17, None), (18, "12 35 Paris 57 Rome 6 Oslo 88 11 Bern"), (19, "Is it 7?")]
    got = {(r.doc_id, r.item_id): r for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(10, 1), (11, 2), (11, 6), (12, 3), (13, 3), (14, 4), (15, 1), (19, 6)}
    assert got[15, 1].n_changed == 2 and got[12, 3].n_changed == got[11, 2].n_changed == 0
    assert all(got[k].coverage == 1 for k in [(10, 1), (11, 2), (12, 3), (13, 3), (14, 4)])


def test_a_full_filter_gives_the_same(spark, monkeypatch):
    bench, docs = spark.createDataFrame([(1, ITEM)], "item_id long, text string"), spark.createDataFrame([(10, ITEM), (11, "the river " * 30)], "doc_id long, text string")
    once = contaminated(docs, bench).collect()
    monkeypatch.setattr(decontamination, "MOST_BITS", 128)
    assert contaminated(docs, bench).collect() == once and len(once) == 1


def slot_kinds(text):
    """(kind, word, words) of the ASCII template words of a text without operators: a name of several words is one, and so is a number with decimals."""
    out, last = [], 0
    for m in re.finditer(r"[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*", text):
        w = m.group()
        before = text[: m.start()].rstrip(" \t")
        if w[0].isdigit():
            kind = decontamination.NUMBER
        elif out and out[-1][0] == decontamination.NUMBER and w.lower() in decontamination.UNITS:
            kind = decontamination.UNIT
        elif w[0].isupper() and w[1:2].islower() and before and before[-1] not in ".!?:;\n\r":
            kind = decontamination.NAME
        else:
            kind = 0
        if kind == decontamination.NAME and out and out[-1][0] == kind and not text[last : m.start()].strip(" \t"):
            out[-1] = (kind, out[-1][1] + " " + w.lower(), out[-1][2] + [w.lower()])
        else:
            out.append((kind, w.lower(), re.findall("[a-z]+|[0-9]+", w.lower())))
        last = m.end()
    return out


def brute_coverage(text, item, width=8):
    """The largest share of the item that windows cover, of its template or plain words."""
    best = 0.0
    a, b = slot_kinds(item), slot_kinds(text)
    for plain in (False, True):
        x, y = ([(0, w) for t in s for w in t[2]] if plain else [(t[0], t[1]) for t in s] for s in (a, b))
        n = min(width, len(x))
        key = lambda t: t[1] if t[0] == 0 else t[0]
        lines = defaultdict(list)
        for i in range(len(x) - n + 1 if n else 0):
            own = sum(t[0] == 0 for t in x[i : i + n])
            if plain or (own == n or own >= decontamination.OWN_OF_SHORT if n < width else own >= decontamination.OWN):
                for j in range(len(y) - n + 1):
                    if all(key(p) == key(q) and bool(p[0]) == bool(q[0]) for p, q in zip(x[i : i + n], y[j : j + n], strict=True)):
                        lines[j - i].append((i, {(p[1], q[1]) for p, q in zip(x[i : i + n], y[j : j + n], strict=True) if p[0]}))
        covered = set()
        for windows in lines.values():
            votes = Counter(p for _, own in windows for p in own)
            top = lambda of: max(of, key=lambda p: (votes[p], p[0] == p[1]))  # noqa: E731, B023
            for i, own in windows:
                if all(p[0] == p[1] or (top([q for q in votes if q[0] == p[0]]) == p and top([q for q in votes if q[1] == p[1]]) == p) for p in own):
                    covered.update(range(i, i + n))
        best = max(best, len(covered) / len(x)) if x else best
    return best


def test_contaminated_as_by_brute_force(spark):
    rng = random.Random(11)
    fill = "the cow has a tree and so it runs to see what we know of rivers near home".split()
    slots = [lambda: str(rng.randint(1, 99)), lambda: rng.choice(["Anna", "Bert", "Carl", "Dora"]), lambda: f"{rng.randint(1, 99)} {rng.choice(['km', 'kg', 'days'])}"]
    say = lambda n: ["so", *(rng.choice(fill) if rng.random() < 0.75 else rng.choice(slots)() for _ in range(n))]
    items = [(i, " ".join(say(rng.choice([2, 5, 9, 20, 30])))) for i in range(12)]
    rows = []
    for i in range(60):
        words_ = rng.choice(items)[1].split()
        swap = {w: rng.choice([w, w, str(rng.randint(100, 120)) if w.isdigit() else rng.choice(["Emil", "Fritz"])]) for w in words_ if w.isdigit() or w[0].isupper()}
        new = [swap.get(w, w) for w in words_]
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(new))
            new[k] = rng.choice(slots)() if new[k] in swap.values() else rng.choice([new[k], "other"])
        rows.append((i, " ".join([*say(rng.randint(0, 12)), *new, *say(rng.randint(0, 12))])))
    got = {(r.doc_id, r.item_id): r.coverage for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    every = {(i, j): brute_coverage(t, u) for i, t in rows for j, u in items}
    # votes may tie, which either side breaks its own way
    assert {k for k, c in every.items() if c >= 0.5} ^ set(got) == set() and sum(abs(every[k] - c) > 1e-9 for k, c in got.items()) <= 0.05 * len(got)


RUSSIAN = "В магазине у Марии было 12 яблок и 7 груш, потом Иван купил 5 яблок, а Ольга взяла 3 груши; сколько яблок осталось у Марии?"
CHANGED = [  # item, and a text that asks the same otherwise
    ("Anna Bell has 12 apples, Carl Dorn 30 pears, Eva Finn 7 plums and Gus Hale 9 figs; who has most?", "Rita Moss has 44 apples, Tom Vane 3 pears, Ulla Ross 15 plums and Max Zorn 2 figs; who has most?"),
    ("Compute 17 km + 4 kg 3 h - 9 mi * 2 s and 5 lbs.", "Compute 3 km + 88 kg 41 h - 6 mi * 7 s and 12 lbs."),
    ("What is 12 + 30 * 7 - 4 / 2 + 9 % 5", "Tell me: what is 5 + 77 * 3 - 14 / 6 + 21 % 4"),
    (RUSSIAN, RUSSIAN.replace("Марии", "Елены").replace("12", "40").replace("7", "9").replace("Иван", "Пётр").replace("5", "8").replace("Ольга", "Анна").replace("3", "2")),
    ("A shop sold 1,250.50 kg of rice to Peter and 300 kg to Mary Ann, so how much rice did both buy?", "A shop sold 75 kg of rice to Quentin and 1,020.25 kg to Rosa, so how much rice did both buy?"),
]
CLEAN = ["Nobody knows what is 42 in this novel, and nobody asks.", "She asked who is Bob and left.", "We compute 7 averages over all rows."]


def test_reparameterised_items_are_found_and_clean_texts_kept(spark):
    items = [(i, t) for i, (t, _) in enumerate(CHANGED)] + [(10, "Who is Ada Lovelace?"), (11, "Compute 3 + 4")]
    rows = [(i, f"Some words before. {t} And some after.") for i, (_, t) in enumerate(CHANGED)] + [(100 + i, t) for i, t in enumerate(CLEAN)]
    out = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(i, i) for i in range(5)] and all(r.n_changed >= 3 for r in out)


def test_recall_and_false_finds(spark):
    """Items of each kind with all slots drawn anew are found; texts that are made of the same words in another order aren't."""
    rng = random.Random(8)
    names = "Anna Boris Clara David Elena Fritz Greta Hugo Irene Jonas".split()
    frames = [
        "{N} has {#} apples and {N} has {#} pears, so how many more has {N}?", "If {#} + {#} is the price of {#} tickets for {N}, what does one cost?", "The train from {N} to {N} takes {#} hours at {#} km and stops {#} times on its way",
        "Compute {#} * {#} - {#} + {#} and then divide by {#}", "{N}, {N} and {N} share {#} euros so that {N} gets {#} more than {N} and {#} less than {N}", "A farmer sells {#} kg of corn, {#} kg of wheat and {#} kg of rye to {N}",
    ]
    say = lambda f: re.sub("{.}", lambda m: rng.choice(names) if m.group() == "{N}" else str(rng.randint(2, 999)), f)
    fill = "so the old house by a river was sold and nobody in town could say why".split()
    some = lambda n: " ".join(rng.choices(fill, k=n))
    items = [(k, say(f)) for k, f in enumerate(frames)]
    rows, want = [], set()
    for i in range(300):
        k = i % len(frames)
        if i % 3:
            rows.append((i, f"{some(rng.randint(3, 30))}: {say(frames[k])} {some(20)}"))
            want.add((i, k))
        else:
            words_ = say(frames[k]).split()
            rng.shuffle(words_)
            rows.append((i, f"{some(20)} {' '.join(words_)} {some(20)}"))
    out = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(out & want) >= 0.9 * len(want) and len(out - want) <= 0.01 * len(rows)


def test_common_slot_tables_are_no_finds(spark, monkeypatch):
    """A window of mostly slots that many documents fill differently is no find, unless the words agree."""
    monkeypatch.setattr(decontamination, "COMMON_LEAST", 20)
    rng = random.Random(9)
    table = lambda: " ".join(f"{rng.randint(1, 999)} kg {rng.choice(['Oslo', 'Rome', 'Bern'])} at {rng.randint(1, 99)} km and" for _ in range(3))
    item, rows = table(), [(i, "see " + table()) for i in range(200)]
    out = contaminated(spark.createDataFrame([*rows, (900, "see " + item)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in out] == [900]


def common_tables():
    """Clean tables of one form, an item that ends with a story, and texts that hold it with other or with the same slots."""
    rng = random.Random(12)
    table = lambda: " ".join(f"{rng.randint(1, 999)} kg {rng.choice(['Oslo', 'Rome', 'Bern'])} at {rng.randint(1, 99)} km and" for _ in range(3))
    item = "11 kg Oslo at 12 km and 13 kg Rome at 14 km and 15 kg Bern at 16 km and then he walked home"
    other = "21 kg Riga at 22 km and 23 kg Bonn at 24 km and 25 kg Lima at 26 km and then he walked home"
    half = item.replace("he walked home", "she took another road")
    return [(i, "see " + table()) for i in range(200)], item, [(900, "see " + other), (901, "see " + half)]


def test_common_windows_count_beside_others(spark, monkeypatch):
    """Windows that many documents fill differently aren't left out of a text that holds the item's other windows too, or fills them the same."""
    monkeypatch.setattr(decontamination, "COMMON_LEAST", 20)
    rows, item, held = common_tables()
    out = contaminated(spark.createDataFrame(rows + held, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    got = {r.doc_id: r for r in out}
    assert set(got) == {900, 901} and got[900].coverage == 1 and got[900].n_changed == 9 and got[901].n_changed == 0


def test_pipeline_drops_items_with_common_windows(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    monkeypatch.setattr(decontamination, "COMMON_LEAST", 20)
    rows, item, held = common_tables()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows + held, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.no_benchmark(spark, docs, str(tmp_path)).collect()) == [i for i, _ in rows]


def test_common_windows_count_beside_others_elsewhere(spark, monkeypatch, tmp_path):
    """A text with a word more inside has the item's other windows on another diagonal than its common ones, which count as well."""
    import corpus_pipeline

    monkeypatch.setattr(decontamination, "COMMON_LEAST", 20)
    rows, item, _ = common_tables()
    item = item.replace("walked home", "walked home by the old road to see")
    held = "see 21 kg Riga at 22 km and 23 kg Bonn at 24 km and 25 kg Lima at 26 km and, as they say, then he walked home by the old road to see"
    docs, bench = spark.createDataFrame([*rows, (900, held)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    out = contaminated(docs, bench).collect()
    assert [r.doc_id for r in out] == [900] and out[0].coverage == 1 and out[0].n_changed == 9
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.no_benchmark(spark, docs, str(tmp_path)).collect()) == [i for i, _ in rows]


def test_common_openings(spark):
    """Items of one opening cost no row for each document that has it, and are found where the rest is."""
    opening = "read the text below with care and then answer the question that comes after it in your own words please"
    rng = random.Random(10)
    items = [(i, f"{opening} " + " ".join(f"k{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x" for _ in range(30))) for i in range(60)]
    rows = [(i, f"{opening} and nothing else") for i in range(300)] + [(1000 + i, t) for i, t in items]
    out = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(1000 + i, i) for i, _ in items}


def test_hash_twins_without_ids(spark):
    """Two texts whose 32-bit hashes are the same, without ids."""
    one, two = " ".join(f"w{i}" for i in range(13)) + " a12329", "b136003 q1 q2 q3 q4 " + " ".join(f"w{i}" for i in range(13))
    data = [(1, " ".join(f"w{i}" for i in range(13))), (None, one), (None, two), *((None, f"n{i} " + (one if i % 2 else "q r s")) for i in range(48))]
    out = substring_dedup.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    removed = {r.text: r.n_removed for r in out}
    assert len(out) == len(data) and removed["a12329"] == 13 and removed["b136003 q1 q2 q3 q4"] == 13
    assert Counter(r.n_removed for r in out) == {0: 25, 13: 26}
    found = contaminated(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(13)))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (None, 7)}


def test_contaminated_without_ids(spark):
    bench = spark.createDataFrame([(1, ITEM), (None, "the cat sat on the mat and looked at the dog for a while")], "item_id long, text string")
    docs = spark.createDataFrame([(None, ITEM), (None, "the cat sat on the mat and looked at the dog for a while"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == {(None, 1), (None, None)}


def near_copies(n, rng, words=60, apart=12):
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for j in rng.sample(range(words), rng.randint(0, apart) // 4):
            w[j] = f"{i}x{j}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("together", "tries"), [(4096, 4), (16, 1)])
def test_many_near_copies(spark, monkeypatch, together, tries):
    """Of copies that differ at 0 to 3 places, many pairs aren't similar: their group is searched in rounds, in pieces if it is large."""
    rng = random.Random(9)
    rows = near_copies(120 if together == 16 else 300, rng)
    monkeypatch.setattr(jaccard_join, "TOGETHER", together)
    monkeypatch.setattr(jaccard_join, "TRIES", tries)
    monkeypatch.setattr(jaccard_join, "AT_LEAST", 10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.jaccard_components(df).collect())) == brute_components(rows)


def test_likely_pairs_grow_with_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64 - 1, 150, dtype=np.uint64)
    for n in (200, 400):
        sets = [np.unique(np.r_[rng.permutation(base)[rng.integers(0, 40) :], rng.integers(0, 2**64 - 1, 20, dtype=np.uint64)]) for _ in range(n)]
        own = np.arange(n) // 2
        args = [np.arange(n), np.array([len(s) for s in sets]), own, [jaccard_join.sketch_of(s) for s in sets]]
        pairs, cut = jaccard_join.likely_pairs(*args, np.ones(n, bool), np.ones(n, bool), [None] * n, 3)
        assert cut and 0 < len(pairs) <= 3 * (n // 2) and all(own[a] != own[b] for a, b in pairs)
        # pairs that were refuted don't come again, and all come in the end
        every = set(map(tuple, jaccard_join.likely_pairs(*args, np.ones(n, bool), np.ones(n, bool), [None] * n, n * n)[0].tolist()))
        less = jaccard_join.likely_pairs(*args, np.ones(n, bool), np.ones(n, bool), [[b for x, b in every if x == i] + [a for a, x in every if x == i] for i in range(n)], 3)
        exact = {(a, b) for a in range(n) for b in range(a) if (both := len(np.intersect1d(sets[a], sets[b]))) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and own[a] != own[b]}
        assert len(less[0]) == 0 and not less[1] and {(b, a) for a, b in exact} <= every
