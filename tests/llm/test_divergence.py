"""The divergence audit against counting by hand, and the sketch's bounds."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from netscale.llm.divergence import Terms, _cells, _hashes, divergence, document_frequencies, term_counts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(rows, least, top=50):
    docs, counts, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms_of(text)
        docs.update({(lang, t) for t in found})
        counts.update((lang, source, t) for t in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        n = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 5) // (sum(x.values()) + 5 * len(kept)) for t, c in x.items()} for s, x in n.items()}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - p[None][t], t) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["Alpha", "beta", "ÉTÉ", "été", "naïve", "日本", "x", "İ", "don't", "a1b", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20))]
    out = []
    for i in range(400):
        weight = [1 / (k + 1 + (i % 4) * 3) for k in range(len(words))]
        text = " ".join(rng.choices(words, weight, k=rng.choice([0, 3, 40, 80])))
        out.append((rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "a", "b", None, "Z", "é"]), text))
    return [*out, *out[:30], ("fr", "one", "rare words"), ("xx", "p", None), ("xx", "q", ""), ("yy", None, "word " * 50_000), ("en", "none", "12 34")]


@pytest.mark.parametrize("least", [1, 5, 30])
def test_all_groups(spark, rows, least):
    docs = spark.createDataFrame([(k, *r, 1, 2) for k, r in enumerate(rows)], "term long, lang string, source string, text string, n long, p int").repartition(5)
    for size in ((4, 1 << 18), (1, 1 << 18), (2, 64)):  # a sketch that rules out much, less, and nothing
        got = sorted(tuple(r) for r in divergence(docs, least, depth=size[0], width=size[1]).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == by_hand(rows, least)


def test_top_and_empty(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence(docs, 5, top=3, width=1 << 18).where("part = 'term'").collect()
    assert sorted(map(tuple, got)) == [r for r in by_hand(rows, 5, 3) if r[2] == "term"]
    assert divergence(docs.limit(0), width=1 << 18).count() == 0
    with pytest.raises(ValueError):
        term_counts(docs, 256)


def test_sketch_never_underestimates(spark, rows):
    docs = spark.createDataFrame([(a or "", b or "", c or "") for a, b, c in rows], "lang string, source string, text string").repartition(7)
    exact = defaultdict(int)
    for lang, _, text in rows:
        for t in set(terms_of(text)):
            exact[lang or "", t] += 1
    for depth, width in ((4, 1 << 18), (2, 256)):
        cells = document_frequencies(docs, depth, width)
        keys = list(exact)
        at = list(_cells(_hashes(pa.array([k[0] for k in keys])), _hashes(pa.array([k[1] for k in keys])), depth, width))
        found = np.min([cells[a] for a in at], axis=0)
        want = np.array([min(255, exact[k]) for k in keys])
        assert (found >= want).all()
        if width > 1000:
            assert (found == want).mean() > 0.99
    # terms that can't be in enough documents are gone before the shuffle
    assert {r.term for r in term_counts(docs, 30, 4, 1 << 18).select("term").collect()} <= {t for (_, t), n in exact.items() if n >= 20}


def test_terms():
    block = pa.record_batch([pa.array(["Ab1c É", None, "x" * 10]), pa.array(["a", "a", "b"]), pa.array(["s"] * 3)], ["text", "lang", "source"])
    t = Terms(block)
    assert [t.terms[i].as_py() for i in t.term] == ["ab", "c", "É", "x" * 10] and t.doc.tolist() == [0, 0, 0, 2]
