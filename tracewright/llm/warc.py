"""WARC archives: writing captures, reading archives back, and joining their records into one row per capture.

A capture is three records: the request, the response (or a revisit of the response with an equal payload) and metadata.
Request and metadata name the response in WARC-Concurrent-To. Files are gzipped WARC 1.1; a record ends with two line
breaks, which Spark's text writer puts after each row, so that any store Spark knows can hold them. The reader takes
files as bytes and finds records by their Content-Length, so payloads may hold anything; it inflates one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bound_batches, materialise, returning, scratch

END = "\r\n"
DATE = "2020-01-01T00:00:00Z"
#: characters of payload that a file is to hold, about
FILE_CHARS = 16_000_000


def _uri(kind: str, digest: str, page_id: int | None, url: str = "") -> str:
    """A record's identifier: of the payload's digest and the page_id, or a mark of the url where there is none."""
    page = f"none-{payload_digest(url.encode('utf-8', 'surrogatepass'))}" if page_id is None else page_id
    return f"<urn:capture:{kind}:{digest}:{page}>"


def _record(headers: list[tuple[str, str]], block: str) -> str:
    """A record without the two line breaks at its end."""
    clean = [(k, v.replace("\r", "%0D").replace("\n", "%0A")) for k, v in headers]
    return "WARC/1.1" + END + "".join(f"{k}: {v}{END}" for k, v in clean) + f"Content-Length: {len(block.encode())}{END}{END}{block}"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_records(page_id: int | None, url: str, html: str, refers_to: int | None) -> list[str]:
    """Request, response or revisit, and metadata record of a capture."""
    digest = payload_digest(html.encode())
    main = "revisit" if refers_to is not None else "response"
    own = _uri("response", digest, page_id, url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    head = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _uri("request", digest, page_id, url)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], f"GET / HTTP/1.1{END}{END}")
    more = [("WARC-Refers-To", _uri("response", digest, refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to is not None else []
    response = _record([("WARC-Type", main), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), *more, ("Content-Type", "application/http;msgtype=response")], head + ("" if refers_to is not None else html))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _uri("metadata", digest, page_id, url)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], f"page_id: {page_id}{END}payload_bytes: {len(html.encode())}{END}")
    return [request, response, metadata]


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Per row of ``pages`` (page_id, html): page_id, digest (hex SHA-1), refers_to (null: it is a response itself).

    Of equal payloads of at least ``least_bytes`` that with the largest page_id is the response. Copies are aggregated
    before they are shuffled.
    """
    html = F.coalesce("html", F.lit(""))
    payloads = materialise(pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes")), "payloads")
    last = payloads.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    of = payloads.join(last, "digest", "left")
    return of.select("page_id", "digest", F.when((F.col("bytes") >= least_bytes) & (F.col("last") != F.col("page_id")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, target: str, least_bytes: int = 0) -> None:
    """Write the captures of ``pages`` (page_id, url, html) as gzipped WARC files below ``target``.

    Null html and url are empty. Rows that share a page_id and a payload are one capture, as are rows without a page_id
    that share url and payload; all others come back as captures of their own. Only revisits' numbers are joined; where they are few, Spark broadcasts them and no page is shuffled.
    """
    bound_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    revisits = decide(pages, least_bytes).where("refers_to IS NOT NULL").select("page_id", "digest", "refers_to").distinct()
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    mean = pages.agg(F.avg(F.length(html)).alias("m")).first()["m"] or 1
    schema = pa.schema([("value", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                out: list[str] = []
                for p, u, h, r in zip(*(batch.column(c).slice(a, 256).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    out += capture_records(p, u, h, r)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], schema=schema)

    per_file = max(3, 3 * int(FILE_CHARS / max(mean, 1)))
    lines = rows.mapInArrow(returning(write), "value string")
    lines.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(target)


class _Stream:
    """The bytes of an archive, plain or gzipped in any number of members, inflated as they're asked for."""

    def __init__(self, data: bytes):
        self._parts, self._held = self._inflated(data) if data[:2] == b"\x1f\x8b" else iter([data]), bytearray()

    @staticmethod
    def _inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
        left = memoryview(data)
        while len(left):
            member, at = zlib.decompressobj(31), 0
            while not member.eof:
                if member.unconsumed_tail:
                    part = member.decompress(member.unconsumed_tail, size)
                elif at < len(left):
                    part = member.decompress(left[at : at + size], size)
                    at += size
                else:
                    raise ValueError("an archive that ends within a gzip member")
                yield part
            left = left[min(at, len(left)) - len(member.unused_data) :]
            if not any(left[:1]):  # padding
                return

    def _more(self) -> bool:
        part = next(self._parts, None)
        self._held += part or b""
        return part is not None

    def line(self) -> bytes | None:
        """The next line without its end; None at the end."""
        begin = 0
        while (end := self._held.find(b"\n", begin)) < 0:
            begin = len(self._held)
            if not self._more():
                if not self._held:
                    return None
                end = len(self._held)
                break
        out = bytes(self._held[:end]).rstrip(b"\r")
        del self._held[: end + 1]
        return out

    def take(self, size: int) -> bytes:
        while len(self._held) < size:
            if not self._more():
                raise ValueError("an archive that ends within a record")
        out = bytes(self._held[:size])
        del self._held[:size]
        return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in small letters) and block of each record of an archive, one record in memory at a time.

    Blank lines between records don't count; a header may have blanks around its colon or go on in the next line.
    """
    stream = _Stream(data)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record: {line[:60]!r}")
        headers: dict[str, str] = {}
        last = None
        while line := stream.line():
            text = line.decode("utf-8", "replace")
            if text[:1] in " \t" and last:
                headers[last] += " " + text.strip()
            elif ":" in text:
                last, _, value = text.partition(":")
                last = last.strip().lower()
                headers[last] = value.strip()
            else:
                raise ValueError(f"no header: {text[:60]!r}")
        yield headers, stream.take(int(headers["content-length"]))


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head, where it has one."""
    if "application/http" not in headers.get("content-type", "application/http").lower() or not block.startswith(b"HTTP/"):
        return block
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    return block[sum(min(ends)) :] if ends else b""


RECORDS = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, block binary"


def read_records(spark: SparkSession, source: str, blocks: bool = True) -> DataFrame:
    """One row for each record below ``source``; of responses the block is the payload and the digest is computed anew.

    Without ``blocks`` only metadata have a block, and ``payload_bytes`` tells the size of responses. Archives of others are
    read too: plain or gzipped in any way, with or without digests and HTTP heads. A digest that is given as SHA-1 must fit.
    """
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                for h, block in parse_records(content.as_py()):
                    kind, told, size = h.get("warc-type"), h.get("warc-payload-digest"), None
                    digest = told.removeprefix("sha1:") if told else None
                    if kind in ("response", "revisit"):
                        block = payload_of(h, block)
                    if kind == "response":
                        own = payload_digest(block)
                        # a digest of another kind can't be held against it
                        if told and (told.startswith("sha1:") or ":" not in told) and digest.upper() != own:
                            raise ValueError(f"{h.get('warc-record-id')}: payload and digest differ")
                        digest, size = own, len(block)
                    kept = block if blocks or kind == "metadata" else None
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, size, kept))
                    held += len(kept or b"")
                    if len(rows) == 600 or held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("content")
    return files.mapInArrow(returning(read), RECORDS.replace("block binary", "payload_bytes long, block binary"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata (structs; null where there is none).

    Records of a capture are brought together by the identifier of the response they are concurrent to. A capture has a
    handful of records; of repeated records of a type the one with the smallest identifier counts. A record that names no
    other is a capture of its own; no records give no captures.
    """
    record = F.struct("record_id", "record_type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "block")
    keyed = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))

    def one(*kinds: str):
        return F.min(F.when(F.col("record_type").isin(*kinds), record))

    return keyed.groupBy("capture_id").agg(one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes an archive of all pages, reads it back and tells what came of each page; null html is an empty payload."""
    target = scratch(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), target)
    captures = assemble(read_records(spark, target, blocks=False))
    number = lambda c: F.regexp_extract(c, ":(-?[0-9]+)>$", 1).try_cast("long")
    told = F.regexp_extract(F.decode(F.col("metadata.block"), "UTF-8"), "payload_bytes: ([0-9]+)", 1).try_cast("long")
    return captures.select(number(F.col("capture_id")).alias("page_id"), F.coalesce(F.col("response.payload_bytes"), told).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.when(F.col("response.record_type") == "revisit", number(F.col("response.refers_to"))).alias("refers_to"))


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: CAST(('0x' || substr(h, CAST(i * 5 // 4 + 1 AS INTEGER), 1)) AS INTEGER) * 16
        + CASE WHEN i * 5 // 4 + 2 <= 40 THEN CAST(('0x' || substr(h, CAST(i * 5 // 4 + 2 AS INTEGER), 1)) AS INTEGER) ELSE 0 END) AS v FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[i + 1] >> CAST(3 - (i * 5) % 4 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last = page_id THEN NULL ELSE last END AS refers_to FROM b
"""
