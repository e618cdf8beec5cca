"""Fill-in-middle against a plain version by regular expressions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from netscale.llm.fill_in_middle import cut, fill_in_middle, rebuilt, restore

ODD = ["a<P>b", "<S", "S>", "<<P", "P>", "x<M>", "<P", ">y", "é日😀a1b22  \r\n", "ß" * 3000 + "abc" * 5000, "\0", "<p>", "a", " ", "<S><", "M>z<M"]


def plainly(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_rows(spark, docs, rows):
    more = spark.createDataFrame([(1000 + i, t, "en", 7, 1, "x", -1) for i, t in enumerate(ODD * 4)], docs.schema)
    docs = docs.unionByName(more).withColumnsRenamed({"n_words": "n", "key": "output"})
    out = restore(fill_in_middle(docs)).collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
    assert got == Counter((k, *plainly(k, t)) for k, t in [*rows, *((1000 + i, t) for i, t in enumerate(ODD * 4))])
    assert {r.form for r in out} == {"plain", "psm", "spm"} and all(r.restored == (r.text or "") for r in out)
    assert out[0].lang == "en" and out[0].id == 1
    assert restore(fill_in_middle(docs.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ<>PSM é😀\n1", max_size=30), max_size=8), st.integers(0, 2**32 - 1), st.integers(0, 99), st.integers(0, 99))
def test_any_text(texts, h, a, b):
    n = len(texts)
    draw = [np.full(n, x, np.int64) for x in (h, h * 7919 % 2**32, a, b)]
    made = cut(pa.array(texts, pa.string()), *draw, 90, 20)
    assert rebuilt(made["output"], made["form"]).to_pylist() == texts
    assert made["n"].to_pylist() == [len(re.findall(r"[A-Za-z]+|[^A-Za-z]", t)) for t in texts]
    for text, form, out in zip(texts, made["form"].to_pylist(), made["output"].to_pylist(), strict=True):
        assert len(out) == len(text) + (0 if form == "plain" else 9)
