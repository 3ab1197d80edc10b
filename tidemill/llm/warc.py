"""A deterministic sharded WARC writer with revisit records, and its reader.

Records are range-sorted by page_id; a task writes its range as gzip members, rolls files by compressed size and makes
every header anew: ids from page_id and digest, a fixed date, payload and block digests. Files appear under their names
only when complete, and the set of files counts as written once the manifest is there, which lists each file with its bytes
and digest; readers read these and no others. Equal input gives equal files.

Of payloads of at least `least` bytes that are equal, the record with the smallest page_id is the response; the others are
revisits without payload. Nulls: a null html is an empty payload, a null url leaves out the target; a null page_id is
written without the id and is never a response that others refer to, unless no equal payload has an id: then all stay
responses. Repeated rows of the smallest page_id are all responses. A very long html is one record, in a file of its own
length. Columns besides page_id, url and html play no part, however they are called. An empty table writes no file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import contents, discard, fingerprint, intact, map_arrow, partitions_for, put, put_manifest, scratch, stash

LEAST = 100
FILE_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f2d7f5e-5a49-4b64-9a9e-1f2f6a7c1d10")
# Fixed value: the profile of revisits by equal payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, as plain bytes."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", block, b"\r\n\r\n"])


def member(data: bytes) -> bytes:
    """A gzip member without a time, so equal records give equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def decompressed(data: bytes) -> bytes:
    """All members of a gzip file, in time that grows with its length however many members it has."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        member_ = zlib.decompressobj(31)
        while not member_.eof:
            if at >= len(view):
                raise ValueError("a gzip member that breaks off")
            part = view[at : at + (1 << 14)]
            out.append(member_.decompress(part))
            at += len(part) - len(member_.unused_data)
    return b"".join(out)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed archive; digests are checked."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        begin = end + 4
        at = begin + int(head["content-length"])
        block = data[begin:at]
        if head["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a damaged record: {head.get('warc-record-id')}")
        at += 4
        yield head, block


FILES = "name string, bytes long, sha256 string, records long"


def write(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives of pages (page_id, url, html) below folder; their table, which the manifest names."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # of repeated payloads only; as a table its size is known when the join is planned, and hot payloads are one row
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stash(first.select(F.col("digest").alias("d"), "first"))
    rows = rows.join(first, F.col("digest") == F.col("d"), "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("d", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, held, n = TaskContext.get().partitionId(), [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, n
            name, data = f"part-{part:07d}-{n:06d}.warc.gz", b"".join(members)
            put(folder, name, data)
            row = pa.RecordBatch.from_pylist([{"name": name, "bytes": len(data), "sha256": fingerprint(data), "records": len(members)}])
            members.clear()
            held, n = 0, n + 1
            return row

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members.append(member(record(*x)))
                held += len(members[-1])
                if held >= file_bytes:
                    yield close()
        if members:
            yield close()

    # the row's number spreads identical rows, whose order doesn't matter
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(partitions_for(pages), "page_id", "digest", "url", "row").sortWithinPartitions("page_id", "digest", "url", "row")
    out = put_manifest(folder, map_arrow(ordered.select("page_id", "url", "payload", "digest", "refers_to"), run, FILES), {})
    discard(first)
    return out


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark, folder: str) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, name, size_, sha in zip(batch.column(0), *(batch.column(c).to_pylist() for c in range(1, 4)), strict=True):
                rows = []
                for head, block in records(decompressed(intact(name, content.as_py(), size_, sha))):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(http.rpartition(b"Content-Length: ")[2])
                    if head["warc-type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"a damaged payload: {head.get('warc-record-id')}")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), size, digest, head["warc-type"], number("x-refers-to-page-id")))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_arrow(contents(spark, folder, ".warc.gz").select("content", "name", "bytes", "sha256"), run, SCHEMA, 4)


def round_trip(pages: DataFrame) -> DataFrame:
    spark, folder = pages.sparkSession, scratch(pages.sparkSession)
    write(pages, folder)
    return read(spark, folder)
