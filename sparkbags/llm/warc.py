"""WARC archives: writing with segmentation and deduplication, reading back with
reassembly.

A page becomes a ``response`` record whose block is an HTTP message in chunked
transfer framing.  A block over ``SEGMENT`` bytes is cut: the first piece stays in
the response (segment 1), the others are ``continuation`` records that name their
origin and number; the last one carries the total length.  A page whose payload
another page has as well, and isn't the one with the largest id, becomes a
``revisit`` record without payload.  Each record is a gzip member of its own.

A record's identifier is its own (the number of the task that writes it, and its number
there), whatever the page's id, which is a header field beside it: records of rows with
equal or null ids never mix.

Reading parses all records.  Whole records are decoded where they are; segments are
grouped by origin identifier, ordered by number and checked against the total
length.  A decoded payload is held against the digest and the length in the header.  A
record of which a segment is missing, or whose framing, length or digest is wrong, has a
null payload and ``complete`` false, or with ``strict`` (as in ``round_trip``) ends the
run.  Groups are as large as one record at most.

Null payloads count as empty.  Rows that repeat id and payload are each written as
they are (each a response).  A null id comes back as null; among equal payloads it is
never the response, if another has an id; with null ids only, each is a response.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, settle, tidied, work_dir
from .files import read_files, write_bytes

SEGMENT = 32 << 10
CHUNK = 8 << 10
FILE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
_READ = 16 << 10
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_ID = "urn:sparkbags:record:"
PARSED = "record_id string, record_type string, page_id string, url string, refers_to string, digest string, payload_length long, segment int, origin string, total_length long, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def from_chunks(body: bytes) -> bytes:
    """The payload inside chunked framing; extensions and trailers are skipped.
    Raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(k.strip().lower() == b"transfer-encoding" and v.strip().lower() == b"chunked" for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    return from_chunks(body) if framed else body


def _record(kind: str, name: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), *fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def records(name: str, page_id, url: str | None, payload: bytes, sha: str, refers_to, segment: int = SEGMENT) -> list[bytes]:
    """The gzip members of one page; ``name`` makes the record's identifier."""
    name = f"{_ID}{name}"
    fields = [("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        return [_record("revisit", name, b"HTTP/1.1 200 OK\r\n\r\n", [*fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))])]
    block = _HTTP + to_chunks(payload)
    if len(block) <= segment:
        return [_record("response", name, block, fields)]
    out = [_record("response", name, block[:segment], [*fields, ("WARC-Segment-Number", "1")])]
    for k, at in enumerate(range(segment, len(block), segment), 2):
        more = [("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(k))]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record("continuation", f"{name}:{k}", block[at : at + segment], more))
    return out


def parse(data: bytes):
    """The records of an archive: header fields (names in lower case) and block."""
    pos, view = 0, memoryview(data)
    while pos < len(data) and data[pos]:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if pos >= len(data):
                raise ValueError("an archive is cut short")
            piece = view[pos : pos + _READ]
            parts.append(z.decompress(piece))
            pos += len(piece) - len(z.unused_data)
        raw = b"".join(parts)
        at = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(head["content-length"])
            yield head, raw[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, segment: int = SEGMENT) -> None:
    """Write archives.  Of equal payloads of at least ``least`` bytes the one with the
    largest key is the response."""
    spark = pages.sparkSession
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias("p"))
    rows = rows.withColumn("d", F.sha1("p"))
    shared = rows.where(F.length("p") >= least).groupBy("d").agg(F.max("k").alias("m"), F.count("*").alias("n")).where("n > 1").select("d", "m")
    rows = rows.join(shared, "d", "left")
    refers = F.when((F.length("p") >= least) & ~F.col("m").eqNullSafe(F.col("k")), F.col("m"))

    def run(it):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for b in it:
            for k, u, p, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = records(f"{part}-{n}", k, u, p, digest(p), m, segment)
                n += 1
                held += got
                size += sum(map(len, got))
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["data"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["data"])

    # the byte after an archive is zero, which gzip readers take for padding
    with batches(spark, 500):
        write_bytes(rows.select("k", "u", "p", refers.cast(kind).alias("m")).mapInArrow(tidied(run), "data binary"), F.col("data"), path, "\0", 1)


_NAMES = [x.split()[0] for x in PARSED.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in PARSED.split(", ")]
_HEAD = ["record_id", "record_type", "page_id", "url", "refers_to", "digest", "payload_length"]
DECODED = "record_id string, record_type string, page_id string, url string, refers_to string, payload binary, digest string, payload_bytes long, complete boolean"


def _parse(it):
    """Batches of records from batches of archives."""

    def bare(x):
        return None if x is None else x.strip("<>")

    for b in it:
        for data in b.column(0):
            rows = []
            for h, block in parse(data.as_py()):
                rows.append((bare(h.get("warc-record-id")), h.get("warc-type"), h.get("x-page-id"), h.get("warc-target-uri"), h.get("x-refers-to-page-id"), h.get("warc-payload-digest", "").removeprefix("sha1:"), int(h.get("x-payload-length", -1)), int(h.get("warc-segment-number", 0)), bare(h.get("warc-segment-origin-id")), int(h.get("warc-segment-total-length", -1)), block))
                if len(rows) >= 128:
                    yield rows
                    rows = []
            if rows:
                yield rows


def _decode(rows: list[dict], strict: bool = False) -> pa.RecordBatch:
    out = []
    for r in rows:
        got, ok = None, True
        if r["record_type"] != "revisit":
            try:
                parts = sorted(r["parts"] or [], key=lambda x: x["segment"])
                numbers = [x["segment"] for x in parts]
                block = b"".join(x["block"] for x in parts)
                ok = numbers in ([0], list(range(1, len(parts) + 1))) and (numbers == [0] or parts[-1]["total_length"] == len(block))
                got = payload_of(block) if ok else None
                sha = digest(got) if ok else r["digest"]
                # archives of others may lack the digest, or the length
                if ok and ((r["digest"] and r["digest"] != sha) or r["payload_length"] not in (None, -1, len(got))):
                    got, ok = None, False
            except ValueError:
                got, ok = None, False
            if strict and not ok:
                raise ValueError(f"record {r['record_id']} is incomplete or damaged")
        out.append((r["record_id"], r["record_type"], r["page_id"], r["url"], r["refers_to"], got, sha if got is not None else r["digest"], len(got) if got is not None else r["payload_length"], ok))
    cols = list(zip(*out, strict=True)) if out else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string()] * 5 + [pa.binary(), pa.string(), pa.int64(), pa.bool_()], strict=True)], [x.split()[0] for x in DECODED.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of all archives of a folder."""

    def run(it):
        for rows in _parse(it):
            yield _batch(rows)

    return read_files(spark, path).select("content").mapInArrow(tidied(run), PARSED)


def _reassembled(pieces: DataFrame, strict: bool) -> DataFrame:
    """Segments grouped by origin, ordered, checked and decoded."""
    part = F.struct("segment", "total_length", "block").alias("part")
    pieces = pieces.select(F.coalesce("origin", "record_id").alias("of"), F.when(F.col("segment") == 1, F.struct(*_HEAD)).alias("head"), part)
    pieces = pieces.groupBy("of").agg(F.max("head").alias("head"), F.collect_list("part").alias("parts"))
    pieces = pieces.select(*[F.coalesce(F.col(f"head.{c}"), F.col("of") if c == "record_id" else F.lit("response") if c == "record_type" else F.lit(None)).alias(c) for c in _HEAD], "parts")

    def run(it):
        for b in it:
            for k in range(0, len(b), 16):
                yield _decode(b.slice(k, 16).to_pylist(), strict)

    return pieces.mapInArrow(tidied(run), DECODED)


def reassemble(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """(record_id, record_type, page_id, url, refers_to, payload, digest, payload_bytes,
    complete): a row for each record but continuations.  A revisit's payload is null;
    its digest and length are those its header states."""

    def run(it):
        for b in it:
            for k in range(0, len(b), 128):
                yield _decode([r | {"parts": [r]} for r in b.slice(k, 128).to_pylist()], strict)

    return parsed.where("segment = 0").mapInArrow(tidied(run), DECODED).unionByName(_reassembled(parsed.where("segment > 0"), strict))


def read_pages(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``reassemble(read_records(...))``, whole records in one Python step."""

    def whole(it):
        for rows in _parse(it):
            rows = [dict(zip(_NAMES, r, strict=True)) for r in rows if r[7] == 0]
            yield _decode([r | {"parts": [r]} for r in rows], strict)

    def cut(it):
        for rows in _parse(it):
            if rows := [r for r in rows if r[7] > 0]:
                yield _batch(rows)

    files = read_files(spark, path).select("content")
    return files.mapInArrow(tidied(whole), DECODED).unionByName(_reassembled(files.mapInArrow(tidied(cut), PARSED), strict))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write archives of all pages to a new folder in the shared one and read them
    back: (key, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = work_dir(spark)
    write(pages, path, key, url, payload, least)
    kind = pages.schema[key].dataType.simpleString()
    got = read_pages(spark, path, strict=True)
    got = got.select(F.col("page_id").try_cast(kind).alias(key), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").try_cast(kind).alias("refers_to"))
    return settle(got, rows=2)  # files
