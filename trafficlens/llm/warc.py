"""WARC archives of pages: written one gzip member per record, read back sequentially.

Writing: each task writes its pages to ``.warc.gz`` files in the shared
folder, a new one after ``ARCHIVE_BYTES``, under names of their own per
attempt; only the manifest of successful tasks (checkpointed) names the files
that count, so a lost or repeated task does no harm.  A payload that other pages have too is stored once: its
smallest page_id is a ``response`` record, the others are ``revisit`` records
that refer to it.

Reading: one task per archive streams it in small chunks through an
incremental zlib decompressor, a member at a time, frames each record by its
Content-Length and verifies the payload's SHA-1 digest.  A damaged record
raises an error.  A header takes as much memory as its url, payloads are hashed as they stream.

Which payloads are equal comes from a SHA-1 grouping; payloads held by 1/1000
of the pages or more (at most 1000) meet their pages by broadcast, all others
by a shuffle, so no group of copies lands in one task.

Null html is an empty payload; null url is an empty target.  A page without
page_id is always a response and is never referred to; repeated rows of one
page_id that hold the smallest id of their payload are all responses.  An
empty table gives an empty result.  url characters outside printable ASCII
are percent-encoded, so they cannot break a header.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.common import attach, prepare, table
from trafficlens.llm.registry import register
from trafficlens.session import shared_path

CHUNK = 1 << 18
#: An archive is closed once it has this size; one read task takes about one archive.
ARCHIVE_BYTES = 1 << 30
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID(int=0x7761726370616765)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id)) if page_id is not None else uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, min_bytes: int = 0) -> bytes:
    """One WARC record, uncompressed: a response with the payload, or a revisit with the HTTP header only."""
    http = HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=':/?#[]@!$&()*+,;=%-._~')}",
            f"WARC-Payload-Digest: sha1:{base32_sha1(hashlib.sha1(payload).digest())}",
            f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class BadRecord(ValueError):
    pass


def members(stream, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """Each gzip member of a stream as an iterator of its decompressed pieces (read one before the next)."""
    rest = stream.read(chunk)
    while rest:
        z = zlib.decompressobj(31)
        state = {"rest": rest}

        def pieces():
            data = state["rest"]
            while True:
                out = z.decompress(data, chunk)
                if out:
                    yield out
                if z.eof:
                    state["rest"] = z.unused_data or stream.read(chunk)
                    return
                data = z.unconsumed_tail or stream.read(chunk)
                if not data and not z.eof:
                    raise BadRecord("archive ends inside a record")

        body = pieces()
        yield body
        for _ in body:
            pass
        rest = state["rest"]


class Reader:
    """Length-framed reading over the pieces of one member."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer = pieces, b""

    def head(self) -> dict[str, str]:
        """Lines up to the empty one, as header fields; the first line is field ''."""
        held, end = bytearray(self.buffer), self.buffer.find(b"\r\n\r\n")
        while end < 0:
            more = next(self.pieces, None)
            if more is None:
                raise BadRecord("no end of header")
            seen = max(0, len(held) - 3)
            held += more
            end = held.find(b"\r\n\r\n", seen)
        head, self.buffer = bytes(held[:end]), bytes(held[end + 4:])
        lines = head.decode().split("\r\n")
        fields = {"": lines[0]}
        for x in lines[1:]:
            name, _, value = x.partition(":")
            fields[name.strip().lower()] = value.strip()
        return fields

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            data = self.buffer or next(self.pieces, None)
            if data is None:
                raise BadRecord("record shorter than its Content-Length")
            self.buffer = data[n:]
            data = data[:n]
            n -= len(data)
            yield data

    def end(self) -> None:
        rest = self.buffer + b"".join(self.pieces)
        if rest != b"\r\n\r\n":
            raise BadRecord("record longer than its Content-Length")


def read_record(pieces: Iterator[bytes]) -> dict:
    """Header fields, payload size and digest of a record; digests and lengths are verified."""
    r = Reader(pieces)
    fields = r.head()
    if fields[""] != "WARC/1.1" or "content-length" not in fields:
        raise BadRecord("not a WARC record")
    length = int(fields["content-length"])
    block, payload, size = hashlib.sha1(), hashlib.sha1(), 0
    head, http = b"", None
    for data in r.exactly(length):
        block.update(data)
        if http is None:
            head += data
            if b"\r\n\r\n" in head:
                first, data = head.split(b"\r\n\r\n", 1)
                http = dict(x.split(": ", 1) for x in first.decode().split("\r\n")[1:])
            else:
                continue
        payload.update(data)
        size += len(data)
    r.end()
    if http is None:
        raise BadRecord("no HTTP header")
    if fields.get("warc-block-digest") != f"sha1:{base32_sha1(block.digest())}":
        raise BadRecord("block digest differs")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if stated != base32_sha1(payload.digest()) or size != int(http["Content-Length"]):
            raise BadRecord("payload digest or length differs")
    elif size:
        raise BadRecord("a revisit with a payload")
    return {"page_id": fields.get("x-page-id"), "payload_bytes": int(http["Content-Length"]),
            "payload_digest": stated, "record_type": fields["warc-type"],
            "refers_to": fields.get("x-refers-to-page-id"), "url": fields.get("warc-target-uri", "")}


def read_archive(stream) -> Iterator[dict]:
    for pieces in members(stream):
        yield read_record(pieces)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (bytes) and ``first``: the smallest page_id of an equal payload, null where none is."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b"")).alias("html"))
    # ids and digests only; the digest groups are read twice
    digests = (own.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes))
               .select("page_id", F.unhex(F.sha1("html")).alias("digest")).checkpoint())
    groups = (digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .filter("n > 1").checkpoint())
    later = attach(digests, groups, "digest", "n", digests.count()).filter("first < page_id")
    later = later.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("digest", "first"))).alias("firsts"))
    got = own.filter("page_id IS NOT NULL").join(later, "page_id", "left")
    got = got.select("page_id", "url", "html", F.expr("firsts[unhex(sha1(html))]").alias("first"))
    return got.unionByName(own.filter("page_id IS NULL").withColumn("first", F.lit(None).cast("long")))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 4,
               archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; the manifest: archive, records, bytes (stored, so the writing happens once)."""
    prepare(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        name, out, records, size = "", None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")]
            for page_id, url, html, first in zip(*cols):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                data = gzip_member(record(page_id, url, html, first), level)
                out.write(data)
                records += 1
                size += len(data)
                if size >= archive_bytes:
                    yield closed()
                    out, records, size = None, 0, 0
        if out is not None:
            yield closed()

    marked = mark_revisits(pages, min_bytes)
    return marked.mapInArrow(write, "archive string, records long, bytes long").checkpoint()


RECORD_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType())])


def read_warc(manifest: DataFrame, rows: int = 2000) -> DataFrame:
    """All records of the manifest's archives, each archive read by one task."""
    prepare(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for b in batches:
            for archive, want in zip(b["archive"].to_pylist(), b["records"].to_pylist()):
                files, path = pafs.FileSystem.from_uri(archive)
                held, seen = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream):
                        for k in ("page_id", "refers_to"):
                            r[k] = None if r[k] is None else int(r[k])
                        held.append(r)
                        seen += 1
                        if len(held) == rows:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                if seen != want:
                    raise BadRecord(f"{archive}: {seen} records of {want}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "archive").mapInArrow(read, RECORD_SCHEMA)


@register("op2_warc", oracle=r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, strlen(html) AS bytes FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM h)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      ((CAST(('0x' || substr(hex || '00', 1 + 2 * ((i * 5) // 8), 4)) AS INTEGER)) >> (11 - (i * 5) % 8)) & 31 AS INTEGER), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    manifest = write_warc(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
