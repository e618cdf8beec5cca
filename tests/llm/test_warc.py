"""Archives: round trips, records of other writers, and assembly of captures."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest

from netscale.llm import warc


def expected(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    rank = lambda i: (i is not None, i)
    holder = {}
    for i, p in payload:
        if p not in holder or rank(i) > rank(holder[p]):
            holder[p] = i
    out = []
    for i, p in payload:
        again = len(p) >= 1000 and i != holder[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", holder[p] if again else None))
    return Counter(out)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    big = ["é" * 500, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50, "\r\n\r\n" * 400, "x" * 300_000, "a\r\n\r\n\r\nb" * 200, "\n" * 1000]
    out = [(i, f"http://h{i % 5}.org/p/{i}?q#f", rng.choice(big)) for i in range(60)]
    out += [(100 + i, "http://same.org/", "copy " * 300) for i in range(200)]
    out += [(300, "", None), (301, None, ""), (302, "no scheme\r\nX: y", "<p>short</p>"), (303, "http://b.c", "<p>short</p>"), (304, "x://y?\x7f z", "x" * 999), (305, "x://y", "x" * 999)]
    out += [(None, "http://n.net/", "n" * 1500), (None, "http://n.net/2", "n" * 1500), (306, "u", "m" * 1500), (None, "u", "m" * 1500), (310, "u", "r" * 2000), (310, "u", "r" * 2000), (309, "u", "r" * 2000)]
    return out


def test_round_trip(spark, pages, tmp_path):
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, size int").repartition(3)
    path = str(tmp_path / "a")
    warc.write_archives(df, path, records_per_file=100)
    records = warc.read_archives(spark, path)
    assert records.count() == 3 * len(pages) and records.where("not complete").count() == 0
    found = warc.captures(records)
    rows = found.collect()
    assert len(rows) == len(pages) and all(r.request is not None and r.metadata is not None and r.other is None for r in rows)
    assert Counter(map(tuple, warc.pages_of(found).collect())) == expected(pages)
    for r in rows:
        assert r.response.record_id in r.request.concurrent_to and r.request.target_uri == r.response.target_uri
        if r.response.warc_type == "response":
            assert hashlib.sha1(r.response.payload).hexdigest() == r.response.payload_digest == r.response.declared_digest
    text = {(r.response.payload or b"").decode() for r in rows}
    assert text >= {h for _, _, h in pages if h}
    nothing = str(tmp_path / "b")
    warc.write_archives(df.limit(0), nothing)
    assert warc.pages_of(warc.captures(warc.read_archives(spark, nothing))).count() == 0


def record(kind, id_, block=b"", *more, uri="http://a/"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", *([f"WARC-Record-ID: {id_}"] if id_ else []), f"WARC-Target-URI: {uri}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"\xff\x00\r\n").digest()).decode()
    first = [
        record("warcinfo", "i", b"software: x\r\n"),
        record("response", "r1", http + b"\xff\x00\r\n", "Content-Type: application/http", f"WARC-Payload-Digest: {digest}", "WARC-Concurrent-To: q1", "WARC-Concurrent-To:", "  q9"),
        record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http"),
        record("metadata", "m1", b"page-id: 8", "WARC-Concurrent-To: q1"),  # through the request
        record("request", "q2", b"", "WARC-Concurrent-To: r1"),  # a second one
        record("metadata", "m7", b"", "WARC-Concurrent-To: m6"),
        record("metadata", "m6", b"", "WARC-Concurrent-To: m1"),  # three links away
        record("request", "lost", b"", "WARC-Concurrent-To: nobody"),
        record("request", None, b"", "WARC-Concurrent-To: r1"),
        record("resource", "s1", b"plain"),
        record("revisit", "v1", http, "Content-Type: application/http", "WARC-Refers-To: r1"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in first))  # a member for each record
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(record("response", "r2", b"x" * 50)[:-30]))  # cut off
    (tmp_path / "three.warc.gz").write_bytes(gzip.compress(record("metadata", "n3", b"", "WARC-Concurrent-To: r2")))  # an empty block ends it
    (tmp_path / "four.warc.gz").write_bytes(gzip.compress(record("response", "r4", b"y" * 50)[:60]))  # cut off in its head
    records = warc.read_archives(spark, str(tmp_path))
    got = {r.record_id: r for r in records.collect()}
    assert len(got) == 14 and got["n3"].complete and not got["r4"].complete and not got["r2"].complete and len(got["r2"].payload) == 24
    assert bytes(got["r1"].payload) == b"\xff\x00\r\n" and got["r1"].payload_digest == got["r1"].declared_digest and got["r1"].concurrent_to == ["q1", "q9"]
    rows = warc.with_revisited(warc.captures(records)).collect()
    whole = {r.response.record_id: r for r in rows if r.response}
    assert set(whole) == {"r1", "r2", "r4", "s1", "v1"} and whole["r2"].metadata.record_id == "n3" and whole["r1"].request.record_id == "q1" and whole["r1"].metadata.record_id == "m1"
    assert whole["v1"].revisited.record_id == "r1" and whole["v1"].revisited.page_id == 8 and whole["v1"].revisited.payload_bytes == 4
    other = {r.other.record_id: r.capture_id for r in rows if r.other}
    assert other == {"i": None, "q2": "r1", "m6": "r1", "m7": "r1", "lost": None, None: None}
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(b"something else\r\n\r\n"))
    with pytest.raises(Exception, match="doesn't start with WARC"):
        warc.read_archives(spark, str(tmp_path)).count()
