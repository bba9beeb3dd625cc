"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as a request, a response (or revisit) and a metadata
record.  The request and the metadata name the response in
``WARC-Concurrent-To``; reading joins them through those identifiers and emits
one nested row per capture.

Archives are written by Spark's text writer, one record a row, so that only
files of committed tasks appear and any store Spark writes to can hold them.
They are read as whole files, record by record by ``Content-Length``; a payload
may hold any bytes, also those of another record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Payloads below this many bytes are always written in full.
MIN_REVISIT_BYTES = 100
#: Bytes of payload an archive file is to hold on average: a file is read by one task.
FILE_BYTES = 64 << 20
_CRLF = "\r\n"
RECORD = ("record_id string, record_type string, concurrent_to array<string>, refers_to string, "
          "target_uri string, content_type string, block binary, headers map<string,string>")


def with_roles(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds payload, payload_digest, payload_bytes, record_type and refers_to (a page_id).

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES`` the one with
    the smallest page_id (then url; nulls last) is the response and the others
    revisit it; smaller payloads are all responses.  A null html is the empty
    payload.  Fully repeated rows have the same role.
    """
    own = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("page_id"),
                   F.col("url").isNull().alias("b"), F.col("url").alias("url"))
    p = (pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
         .withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long"), "own": own}))
    # one row per payload that is to be revisited; counted before the shuffle, so a hot payload is a few rows, and
    # written, so that the planner knows its size: if small, the pages are not shuffled to join it
    first = scratch.table(p.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest")
             .agg(F.min("own").alias("first"), F.count("*").alias("n")).where("n > 1")
             .select(F.col("payload_digest").alias("d"), "first"), "first")
    return (p.join(first, F.col("payload_digest") == F.col("d"), "left")
            .withColumn("revisit", F.col("first").isNotNull() & (F.col("own") != F.col("first")))
            .select("page_id", "url", "payload", "payload_digest", "payload_bytes", "own", "first",
                    F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
                    F.when(F.col("revisit"), F.col("first.page_id")).alias("refers_to")))


def _urn(*parts):
    """A stable record id: the same row always gets the same one."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", piece(1, 8), piece(9, 4), piece(13, 4), piece(17, 4), piece(21, 12)), F.lit(">"))


def _one_line(c):
    """Header values hold no control characters."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", " ")


def _record(kind, rid, headers: list, block):
    """A record as text, without its last line feed (the writer's line separator adds it)."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid),
             *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block, F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str, scratch: Scratch, captured: str = "2020-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write the captures of ``pages`` (page_id, url, html) as WARC files under ``path``.

    The response block is an HTTP message whose body is the payload; a revisit
    has the head only and names the response in WARC-Refers-To.  Null urls are
    empty; other columns are ignored.
    """
    p = with_roles(pages, scratch)
    key = lambda at: (F.col(f"{at}.page_id"), F.col(f"{at}.url"))
    uri, digest = F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"))
    date = F.lit(f"WARC-Date: {captured}")
    rid, first = _urn(F.lit("response"), *key("own"), F.col("payload_digest")), _urn(F.lit("response"), *key("first"), F.col("payload_digest"))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), rid)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    revisit = F.col("record_type") == "revisit"
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), first))  # null: concat_ws leaves it out
    profile = F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    response = _record(F.col("record_type"), rid, [date, uri, digest, profile, refers, F.lit("Content-Type: application/http; msgtype=response")],
                       F.when(revisit, head).otherwise(F.concat(head, F.col("payload").cast("string"))))
    request = _record(F.lit("request"), _urn(F.lit("request"), *key("own"), F.col("payload_digest")),
                      [date, uri, beside, F.lit("Content-Type: application/http; msgtype=request")],
                      F.concat(F.lit("GET "), _one_line(F.col("url")), F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n")))
    note = F.concat(F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(_CRLF))).otherwise(""),
                    F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF))
    metadata = _record(F.lit("metadata"), _urn(F.lit("metadata"), *key("own"), F.col("payload_digest")),
                       [date, uri, beside, F.lit("Content-Type: application/warc-fields")], note)
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 1
    (p.select(F.explode(F.array(request, response, metadata)).alias("value")).write
     .option("lineSep", "\n").option("compression", compression)
     .option("maxRecordsPerFile", 3 * max(1, int(FILE_BYTES / (mean + 1000)))).text(path))


class _Stream:
    """Bytes of a file, plain or gzip (one member or one per record), inflated piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = data, 0, bytearray()
        self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = self.data[self.at:self.at + (1 << 16)]
        if self.gz is None:
            self.held += chunk
        else:
            self.held += self.gz.decompress(chunk)
            if self.gz.eof:  # the next member begins where this one ended
                self.at -= len(self.gz.unused_data)
                self.gz = zlib.decompressobj(31)
        self.at += len(chunk)
        return True

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.held[:end + 1])
        del self.held[:end + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of every record; raises on bytes that are no record."""
    stream = _Stream(data)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers: list[tuple[str, str]] = []
        while (line := stream.line()) is not None and line.strip():
            if line[:1] in b" \t" and headers:  # folded value
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.decode('utf-8', 'replace').strip()}")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.append((name.strip().lower(), value.strip()))
        yield headers, stream.take(int(dict(headers)["content-length"]))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path`` (schema ``RECORD``)."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())),
                        ("refers_to", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()),
                        ("block", pa.binary()), ("headers", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse_records(content.as_py()):
                    h = dict(headers)
                    rows.append({"record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"),
                                 "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
                                 "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"),
                                 "content_type": h.get("content-type"), "block": block, "headers": list(h.items())})
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit record: its columns (record_id as capture_id), request and metadata (record_id, block).

    ``records`` needs record_id, record_type, concurrent_to and block; who needs
    no bodies derives what is wanted of them first and doesn't shuffle them.
    A request or metadata record belongs to the capture it is concurrent to,
    stated by either side or through the other one (metadata -> request ->
    response).  Of several requests (or metadata records) of a capture the one
    with the smallest record id is taken; a record written twice is one record;
    one without a capture is left out.  Captures without a partner keep a null.
    """
    skinny = records.select("record_id", "record_type", "concurrent_to", "block")
    main = F.col("record_type").isin("response", "revisit", "resource")
    links = records.where("record_id IS NOT NULL").select("record_id", "record_type", F.explode("concurrent_to").alias("to"))
    stated = links.select(F.col("record_id").alias("a"), F.col("to").alias("b"))
    both = stated.union(stated.select("b", "a")).distinct()
    anchors = records.where(main & F.col("record_id").isNotNull()).select(F.col("record_id").alias("capture_id")).distinct()
    direct = both.join(anchors, F.col("b") == F.col("capture_id"), "left_semi").select(F.col("a").alias("id"), F.col("b").alias("capture_id"))
    through = (both.join(direct, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "capture_id")
               .join(direct.select(F.col("id").alias("known")), F.col("id") == F.col("known"), "left_anti")
               .join(anchors.select(F.col("capture_id").alias("known")), F.col("id") == F.col("known"), "left_anti"))
    owner = direct.union(through).distinct()
    partners = (skinny.where(F.col("record_type").isin("request", "metadata"))
                .join(owner, F.col("record_id") == F.col("id"))
                .groupBy("capture_id").agg(*(F.min(F.when(F.col("record_type") == t, F.struct("record_id", "block"))).alias(t)
                                             for t in ("request", "metadata"))))
    captures = records.where(main).withColumnRenamed("record_id", "capture_id").drop("concurrent_to")
    return captures.join(partners, "capture_id", "left")


def field(block, name: str):
    """Value of one field of an application/warc-fields block."""
    return F.nullif(F.regexp_extract(block.cast("string"), rf"(?im)^{name}:[ ]*([^\r\n]*)", 1), F.lit(""))


def http_body(block):
    """Body of an HTTP message."""
    at = F.locate("\r\n\r\n", F.decode(block, "ISO-8859-1"))  # one character a byte
    return F.when(at > 0, F.substring(block, at + 4, F.octet_length(block))).otherwise(block)
