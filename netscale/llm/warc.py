"""WARC archives: written by Spark's own text sink, read as streams of records, and assembled into captures.

A record ends with two line breaks, so rows that are records and a line separator of two line breaks make an archive. It is read with the same
separator: a compressed file is one split, whose chunks arrive in order, and Content-Length alone says where a record ends. Neither an archive
nor more than one record is held at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netscale.llm.common import written

BREAK = "\r\n"
#: Between records.
GAP = BREAK * 2
#: Payloads of fewer bytes are stored again.
LEAST = 1000
#: Bounds the size of an archive.
RECORDS_PER_FILE = 60_000
#: A hot response, which many revisits name, meets them in so many parts.
SALTS = 32
#: Fixed: the profile of a revisit whose payload is the same.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "warc_type", "target_uri", "warc_date")]
    + [T.StructField("concurrent_to", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("refers_to", "declared_digest", "payload_digest", "http_head")]
    + [T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("complete", T.BooleanType())]
)


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _uuid(kind: str, *of: Column) -> Column:
    """A name-based id: equal rows have equal ones, so that a task that runs again writes the same."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in of]).cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return _lines("<urn:uuid:", F.concat_ws("-", *parts), ">")


def write_archives(pages: DataFrame, path: str, least: int = LEAST, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of pages (page_id, url, html) in the folder path: a request, a response or revisit, and a metadata record of each row.

    Of rows with equal payloads (html in UTF-8; null: empty) of at least `least` bytes those with the largest page_id (a null one is the
    smallest) hold it as a response, and the others are revisits of the response with the largest url among them. Smaller payloads are always
    responses. Request and metadata name the response or revisit they are concurrent to. Spaces and control characters of an url are escaped
    in the headers. Rows that repeat are written each, with the same ids; other columns are ignored; an empty table gives an archive without records.
    """
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    size, digest = F.octet_length("html"), F.sha1(F.col("html").cast("binary"))
    rows = read.withColumns({"size": size, "digest": digest})
    # of payloads that are there more than once, the row that holds it; a payload of very many rows meets it in parts
    large = rows.where(F.col("size") >= least)
    copies = large.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("holder")).where("n > 1")
    copies = written(copies.select("digest", F.col("holder.page_id").alias("holder"), _uuid("response", F.col("holder.page_id"), F.col("holder.url"), F.col("digest")).alias("holder_id")), "copies")
    parts = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = dealt.join(parts, ["digest", "part"], "left")
    again = F.coalesce((F.col("size") >= least) & F.col("holder_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.lit(False))

    plain = F.coalesce("url", F.lit(""))
    escaped = plain
    for code in [*range(0x21), 0x7F]:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = rows.withColumn("target", F.when(plain.rlike(r"[\x00-\x20\x7F]"), escaped).otherwise(plain))
    safe = F.col("target")
    host = F.regexp_extract(safe, r"^.*?://([^/?#]*)", 1)
    asked = F.regexp_extract(safe, r"^.*?://[^/?#]*([^#]*)", 1)
    of = (F.col("page_id"), F.col("url"), F.col("digest"))
    main = F.when(again, _uuid("revisit", *of)).otherwise(_uuid("response", *of))

    def record(kind: Column | str, id_: Column, more: Column, content: str, block: Column) -> Column:
        return _lines("WARC/1.1\r\nWARC-Type: ", kind, "\r\nWARC-Record-ID: ", id_, f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: ", safe, BREAK, more, f"Content-Type: {content}\r\nContent-Length: ", F.octet_length(block).cast("string"), GAP, block)

    beside = _lines("WARC-Concurrent-To: ", F.col("main"), BREAK)
    head = _lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("size").cast("string"), GAP)
    request = record("request", _uuid("request", *of), beside, "application/http; msgtype=request", _lines("GET ", F.when(asked.startswith("/"), asked).otherwise(F.concat(F.lit("/"), asked)), " HTTP/1.1\r\nHost: ", host, GAP))
    payload = _lines("WARC-Payload-Digest: sha1:", F.col("digest"), BREAK)
    first = F.when(F.col("again"), _lines(payload, f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: ", F.col("holder_id"), BREAK)).otherwise(payload)
    kind = F.when(F.col("again"), "revisit").otherwise("response")
    response = record(kind, F.col("main"), first, "application/http; msgtype=response", F.concat(head, F.when(F.col("again"), "").otherwise(F.col("html"))))
    metadata = record("metadata", _uuid("metadata", *of), beside, "application/warc-fields", _lines("page-id: ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), BREAK))
    out = rows.withColumn("again", again).withColumn("main", main).select(F.explode(F.array(request, response, metadata)).alias("value"))
    out.write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Stream:
    """Records of one archive, from chunks of its bytes."""

    def __init__(self):
        self.held: list[bytes] = []
        self.size, self.need, self.head = 0, 0, None

    def add(self, chunk: bytes) -> Iterator[dict]:
        self.held.append(chunk)
        self.size += len(chunk)
        while self.size >= self.need:
            data = b"".join(self.held)
            if self.head is None:
                data = data.lstrip(b"\r\n")
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    if data and not b"WARC/".startswith(data[:5]) and not data.startswith(b"WARC/"):
                        raise ValueError("a record that doesn't start with WARC/: the archive isn't compressed, or broken")
                    self._keep(data, 0)
                    return
                if not data.startswith(b"WARC/"):
                    raise ValueError("a record that doesn't start with WARC/: the archive isn't compressed, or broken")
                self.head = _headers(data[:end])
                self._keep(data[end + 4 :], int(self.head.get("content-length", ["0"])[0]))
            else:
                yield _record(self.head, data[: self.need], True)
                self.head = None
                self._keep(data[self.need :], 0)
                if not self.size:
                    return

    def _keep(self, rest: bytes, need: int) -> None:
        self.held, self.size, self.need = [rest], len(rest), need

    def end(self) -> Iterator[dict]:
        """A record that the archive's end cuts off, in its block or its head."""
        data = b"".join(self.held)
        if self.head is None and data.lstrip(b"\r\n").startswith(b"WARC/"):
            head = _headers(data.lstrip(b"\r\n"))
            yield _record(head, b"", head.get("content-length") == ["0"])
        elif self.head is not None:
            yield _record(self.head, data, False)


def _headers(head: bytes) -> dict[str, list[str]]:
    """Values by lower-cased name; a line that starts with a space goes on with the one before."""
    out: dict[str, list[str]] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split(BREAK)[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), []).append(value.strip())
    return out


def _digest(value: str | None) -> str | None:
    """SHA-1 as lower-case hex, of hex or base 32; what isn't SHA-1 as it stands."""
    name, _, text = (value or "").partition(":")
    if name.strip().lower() != "sha1":
        return value
    text = text.strip()
    if len(text) == 32:
        return base64.b32decode(text.upper()).hex()
    return text.lower()


def _record(head: dict[str, list[str]], block: bytes, complete: bool) -> dict:
    """The columns of RECORD; a revisit has no payload."""
    one = lambda name: head.get(name, [None])[0]
    http, payload = None, block
    if (one("content-type") or "").startswith("application/http"):
        start, gap, payload = block.partition(b"\r\n\r\n")
        http = start.decode("utf-8", "replace")
    bare = one("warc-type") == "revisit"
    return {
        "record_id": one("warc-record-id"), "warc_type": one("warc-type"), "target_uri": one("warc-target-uri"), "warc_date": one("warc-date"),
        "concurrent_to": head.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "declared_digest": _digest(one("warc-payload-digest")),
        "payload_digest": None if bare else hashlib.sha1(payload).hexdigest(), "http_head": http, "payload": None if bare else payload,
        "payload_bytes": None if bare else len(payload), "complete": complete,
    }


def _parsed(batches: Iterator[pa.RecordBatch], without: frozenset[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.name, pa.list_(pa.string()) if f.name == "concurrent_to" else {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}.get(f.dataType.typeName(), pa.string())) for f in RECORD.fields])
    now, stream, held, size, gap = None, _Stream(), [], 0, b""

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(held, schema)

    for batch in batches:
        for file, chunk in zip(batch.column("file").to_pylist(), batch.column("chunk"), strict=True):
            found = []
            if file != now:
                found += stream.end()
                now, stream, gap = file, _Stream(), b""
            found += stream.add(gap + chunk.as_py())
            gap = GAP.encode()
            for r in found:
                if r["warc_type"] in without:
                    r["payload"] = None
                size += 1000 + len(r["payload"] or b"")
            held += found
            if size > 8_000_000:
                yield packed()
                held, size = [], 0
    held += [r | {"payload": None} if r["warc_type"] in without else r for r in stream.end()]
    if held:
        yield packed()


def read_archives(spark: SparkSession, path: str, without: Iterable[str] = ()) -> DataFrame:
    """Records of compressed archives (*.gz, of one gzip member or of many) under path, in the columns of RECORD.

    without: types of records whose payloads aren't wanted, but only their sizes and digests.

    payload is what follows the HTTP head, or the whole block of a record without one; payload_digest is its SHA-1 in hex, declared_digest that
    of the header. A revisit has no payload, so these are null. Header lines may be folded and repeated; one that is missing gives null. A record
    that its archive's end cuts off isn't complete; a payload may hold anything, line breaks and WARC headers too. An archive that isn't
    compressed raises, as it could be read from its middle.
    """
    chunks = spark.read.option("lineSep", GAP).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("chunk"))
    without = frozenset(without)
    return chunks.mapInArrow(lambda batches: _parsed(batches, without), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, response, request, metadata), structs of the columns of records.

    A response (or revisit, or resource) is a capture. Other records belong to the one that they name as concurrent or that names them, directly
    or through other records; of several the smallest id. Of a capture's requests the one with the smallest id is its request, and so for
    metadata; records of other kinds, further ones, and those that belong to no capture, are rows of their own, of which response is null,
    capture_id says whose they are (null: nobody's), and which stand under `other`. Nothing is dropped but copies of a request or
    metadata record with the same id; responses stay each. Records without an id belong nowhere. An empty table gives an empty one.
    """
    is_main = F.coalesce(F.col("warc_type").isin("response", "revisit", "resource"), F.lit(False))
    whole = F.struct(*[F.col(c) for c in records.columns])
    mains, rest = records.where(is_main), records.where(~is_main)
    found = _attached(mains.where("record_id is not null"), rest.where("record_id is not null"))
    attached = rest.join(found.withColumnRenamed("a", "record_id"), "record_id", "left").select(*records.columns, "capture_id")

    def first(kind: str) -> Column:
        own = F.col("warc_type") == kind
        return F.min_by(F.when(own, whole), F.when(own, F.col("record_id"))).alias(kind)

    kinds = attached.where("capture_id is not null and warc_type in ('request', 'metadata')")
    beside = written(kinds.groupBy("capture_id").agg(first("request"), first("metadata")), "beside")
    out = mains.select(F.col("record_id").alias("capture_id"), whole.alias("response")).join(beside, "capture_id", "left")
    taken = beside.select("capture_id", F.col("request.record_id").alias("__request"), F.col("metadata.record_id").alias("__metadata"))
    further = attached.join(taken, "capture_id", "left").where("not coalesce(record_id in (__request, __metadata), false)")
    return out.unionByName(further.select("capture_id", whole.alias("other")), allowMissingColumns=True)


def _attached(mains: DataFrame, rest: DataFrame) -> DataFrame:
    """(a, capture_id) of the other records that belong to a capture: by a link in either direction, then through records that do."""
    ids = mains.select(F.col("record_id").alias("capture_id")).distinct()
    named = mains.select(F.explode("concurrent_to").alias("a"), F.col("record_id").alias("capture_id"))
    names = rest.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("capture_id")).join(ids, "capture_id", "left_semi").select("a", "capture_id")
    found = last = written(named.union(names).groupBy("a").agg(F.min("capture_id").alias("capture_id")), "attached")
    # what is left is little in usual archives: records about the archive itself, and those that are linked through others
    loose = written(rest.select(F.col("record_id").alias("a")).distinct().join(found, "a", "left_anti"), "loose")
    if loose.isEmpty():
        return found
    links = rest.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    ways = written(links.union(links.select("b", "a")).distinct().join(loose, "a", "left_semi"), "links")
    while True:
        more = ways.join(last.select(F.col("a").alias("b"), "capture_id"), "b").join(found, "a", "left_anti")
        more = written(more.groupBy("a").agg(F.min("capture_id").alias("capture_id")), "attached")
        if more.isEmpty():
            return found
        last, found = more, found.union(more)


def with_revisited(found: DataFrame) -> DataFrame:
    """captures (read three times: best a table) with `revisited`, the response (record_id, page_id, payload_bytes, payload_digest) that a revisit refers to.

    A response that very many revisits name meets them in parts. Of responses of one id the one of the largest page_id counts. Null if
    there is none.
    """
    page = page_id().alias("page_id")
    responses = found.where("response.warc_type <> 'revisit'").select(F.col("response.record_id").alias("record_id"), F.struct(page, "response.payload_bytes", "response.payload_digest").alias("r"))
    named = found.where("response.warc_type = 'revisit'").select(F.col("response.refers_to").alias("record_id")).distinct()
    unique = responses.join(named, "record_id", "left_semi").groupBy("record_id").agg(F.max("r").alias("r"))
    parts = unique.select(F.col("record_id").alias("__to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__part"), F.struct("record_id", "r.*").alias("revisited"))
    dealt = found.withColumns({"__to": F.when(F.col("response.warc_type") == "revisit", F.col("response.refers_to")), "__part": F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")})
    return dealt.join(parts, ["__to", "__part"], "left").drop("__to", "__part")


def page_id() -> Column:
    """Of a capture, from its metadata record."""
    text = F.col("metadata.payload").cast("string")
    return F.nullif(F.regexp_extract(text, r"(?m)^page-id: (-?\d+)", 1), F.lit("")).cast("long")


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures that write_archives' archives hold.

    payload_digest and payload_bytes are of the full payload: as computed for a response, and of the response that it names for a revisit."""
    rows = with_revisited(found).where("response is not null")
    revisit = F.col("response.warc_type") == "revisit"
    return rows.select(
        page_id().alias("page_id"),
        F.when(revisit, F.col("revisited.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.declared_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        F.when(revisit, F.col("revisited.page_id")).alias("refers_to"),
    )
