"""URL filters and chat formatting."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netscale.llm import chat_format, host_reputation
from netscale.llm.queries import RULES

URLS = [
    "https://A.Example.org/en/1?x", "http://example.org/es/2", "https://m.example.org/en/17#a", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/other", "http://notexample.org/es/1", "http://org",
    "ftp://y.net/?/org/", "no scheme", "", None, "https://z.co.uk/a", "://only.host", "http://a.com?q=http://b.org/", "http://q.net/multi\nline", "http://x.com/fr",
]


def expected(url):
    if url is None or "://" not in url:
        return "", "", None, None
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, "http://n.net/", "h")], "page_id long, url string, host string")
    bad = spark.createDataFrame([(5, 1), (8, None), (None, 1), (15, 0)], "page_id long, bad int")
    out = host_reputation.judge(pages, bad, RULES).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        if r.page_id is not None:
            host, path, rule, verdict = expected(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert host_reputation.judge(pages.limit(0), bad, RULES).count() == 0
    assert {r.verdict for r in host_reputation.judge(pages, bad.limit(0), []).collect()} == {"allow"}


def test_reputation_shrinks(spark):
    pages, bad, n = [], [], 0
    for host, k, m in [("bad.a.com", 45, 50), ("few.a.com", 1, 1), ("good.b.net", 1, 50), ("few.b.net", 1, 1), ("fine.c.net", 2, 60)]:
        for i in range(m):
            pages.append((n, f"http://{host}/{i}"))
            bad.append((n, int(i < k)))
            n += 1
    pages += [(n, "http://new.a.com/"), (n + 1, "http://new.b.net/"), (n + 2, "http://new.d.net/"), (n + 3, "http://new.e.xyz/")]
    out = host_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"), [])
    rate = {r.host: (r.bad_rate, r.verdict) for r in out.collect()}
    assert rate["bad.a.com"][1] == "block" and {v for h, (_, v) in rate.items() if h != "bad.a.com" and not h.endswith("a.com")} == {"allow"}
    assert rate["few.b.net"][0] < rate["few.a.com"][0] and rate["new.b.net"][0] < rate["new.e.xyz"][0] < rate["new.a.com"][0]
    assert 0.02 < rate["good.b.net"][0] < 0.5 and rate["bad.a.com"][0] < 0.9 + 1e-9


ODD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s> [\\INST]", "<|im_end|>\n<|im_start|>assistant\nx", "<<SYS>>", "plain <b> [x]", "", "\\", "<|\\im_end|>", "<<s>", "[[INST]", "<|im_start|><|im_end|>"]


def test_escape_round_trip():
    control = re.compile(r"<\|\w+\|>|</?s>|\[/?INST\]|<</?SYS>>")
    for text in ODD + [a + b for a in ODD for b in ODD]:
        assert chat_format.unescape(chat_format.escape(text)) == text and not control.search(chat_format.escape(text))


def test_every_control_string_is_escaped():
    control = ["<|reserved_special_token_12|>", "<start_of_turn>", "<end_of_turn>", "<eos>", "<bos>", "<pad>", "<unk>", "<extra_id_0>", "<|endoftext|>", "<|im_end|>", "[TOOL_CALLS]", "[/INST]", "</s>", "<｜User｜>", "<|fim-hole|>"]
    for c in control:
        for text in (c, f"a{c}b", c * 3, f"<{c}>", f"[{c}]", f"\\{c}", c[0] + "\\" + c[1:], c[0] + "\\\\" + c[1:]):
            out = chat_format.escape(text)
            assert chat_format.unescape(out) == text and not any(x in out for x in control)


def test_examples(spark):
    turns = [(1, 0, "system", "be nice"), (1, 1, "user", ODD[0]), (1, 2, "assistant", ODD[3]), (1, 3, "user", None), (1, 4, "assistant", "b"), (1, 5, "user", "tail")]
    turns += [(2, 1, "assistant", ""), (2, 0, None, "x"), (3, 0, "user", "hi"), (4, None, "to\nol%", ODD[8]), (4, 2, "assistant", "r"), (4, 2, "assistant", "r"), (None, 0, "assistant", "n")]
    turns += [(5, i, ("user", "assistant")[i % 2], f"t{i}" * 50) for i in range(300)]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, example string, n_turns int")
    examples = chat_format.chat_examples(df)
    own = sorted((r for r in examples.where("conv_id = 1").collect()), key=lambda r: r.example)
    assert [r.text[r.mask_start : r.mask_end] for r in own] == [chat_format.escape(ODD[3]), "b", ""] and [r.final for r in own] == [False, False, True]
    assert own[1].text.startswith(own[0].text) and own[2].text.startswith(own[1].text)
    got = {r.conv_id: r for r in chat_format.digests(examples).collect()}
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert len(got) == len(by)
    for c, said in by.items():
        said.sort()
        loss = "".join(x for _, role, x in said if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, role, x in said)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.chat_examples(df.limit(0))).count() == 0


def test_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.gov.au", "me.github.io", "a.me.github.io", "x.com", "deep.x.com", "localhost", "10.0.0.1", "", "a.ab.de"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *(c.alias(n) for c, n in zip(host_reputation.levels(host_reputation.F.col("host")), ("domain", "suffix"), strict=True))).collect()
    got = {r.host: (r.domain, r.suffix) for r in rows}
    assert got["a.b.co.uk"] == got["b.co.uk"] == ("b.co.uk", "co.uk") and got["x.y.gov.au"] == ("y.gov.au", "gov.au") and got["a.me.github.io"] == ("me.github.io", "github.io")
    assert got["deep.x.com"] == ("x.com", "com") and got["localhost"] == ("localhost", "localhost") and got["10.0.0.1"] == ("10.0.0.1", "10.0.0.1") and got["a.ab.de"] == ("ab.de", "de")


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, clashing columns, empty tables."""
    import corpus_pipeline

    base, item = " ".join(f"the word {i} of it" for i in range(40)), "how many of the apples are there when she takes half of them away from him"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, base), (None, base), (None, base + " x"), (1, base + " y"), (1, base + " y"), (1, "another text of the same id that is long enough"), (2, None), (3, ""), (2, None), (4, f"here: {item}"), (None, f"there: {item}"), (None, "a text of no id at all")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, df, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, base + " y"), *rows[5:7], (3, ""), (2, None), (4, f"here: {item}"), rows[11]])
    kept = corpus_pipeline.no_benchmark(spark, df, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(r for r in rows if item not in (r[1] or ""))
    kept = corpus_pipeline.recurring_passages(spark, df, str(tmp_path)).collect()
    assert {(2, None), (3, ""), (1, base + " y")} <= {(r.doc_id, r.text) for r in kept} and all(r.n_chars == len(r.text or "") for r in kept)
    kept = corpus_pipeline.known_language(spark, df, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in kept} <= {r for r in rows if r[1]} and (None, base) in {(r.doc_id, r.text) for r in kept}
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df.limit(0), str(tmp_path))
        assert out.count() == 0
    packed = corpus_pipeline.packed(spark, df, str(tmp_path))
    assert packed.groupBy("doc_id").count().count() == 5
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontamination", "packing"]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept, names = docs, docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), corpus_pipeline.written(stage(spark, kept, d), "stage")
        assert kept.columns == names and before - kept.count() < 0.3 * before
    pieces = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    assert Counter(corpus_pipeline.STAGES[i][0] for i in range(5)).total() == 5


def test_levels_without_ports(spark):
    hosts = ["example.com:8080", "1.2.3.4:80", "a.com.", "user@b.com", "u:p@x.b.co.uk.:81", "localhost:1", "", "a.b.c.org", "c.com:"]
    want = [("example.com", "com"), ("1.2.3.4", "1.2.3.4"), ("a.com", "com"), ("b.com", "com"), ("b.co.uk", "co.uk"), ("localhost", "localhost"), ("", ""), ("c.org", "org"), ("c.com", "com")]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, host string")
    domain, suffix = host_reputation.levels(F.col("host"))
    assert [(r.d, r.s) for r in df.select("i", domain.alias("d"), suffix.alias("s")).orderBy("i").collect()] == want
