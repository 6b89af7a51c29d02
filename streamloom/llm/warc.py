"""WARC archives as a chunked record table.

An archive is a table of (archive, record, chunk, last, bytes, digest, row) rows: the bytes of a
record's chunks, in order, are its WARC/1.1 bytes, and digest is the SHA-1 of the payload up to
the end of that chunk. row is a number of each written record's own, which tells records of one
id (pages given twice, or without an id) apart. Writing and reading hold one chunk at a time beside the row that Spark
hands over, never a second whole record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.session import ready, stage

#: Payload bytes in a chunk.
CHUNK = 1 << 18
#: Archives that records are dealt over.
ARCHIVES = 64
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SCHEMA = "archive int, record string, chunk long, last boolean, bytes binary, digest string, row long"


def base32_digest(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    if record is None or record == "<urn:page:none>":
        return None
    return int(record[len("<urn:page:") : -1])


def header(page_id, url, kind: str, digest: str, size: int, refers_to) -> bytes:
    """The WARC header of a record; a revisit has the HTTP header alone for its block."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c for c in (url or 'about:blank') if c not in chr(13) + chr(10))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(_HTTP) + (size if kind == 'response' else 0)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _chunks(page_id, url, kind: str, digest: str, refers_to, payload: memoryview) -> Iterator[tuple[int, bool, bytes, str]]:
    """(chunk, last, bytes, running digest) of one record."""
    size, seen = len(payload), hashlib.sha1()
    head = header(page_id, url, kind, digest, size, refers_to) + _HTTP
    if kind == "revisit":
        yield 0, True, head + b"\r\n\r\n", digest
        return
    at = k = 0
    while True:
        part = payload[at : at + CHUNK]
        seen.update(part)
        at += len(part)
        last = at >= size
        yield k, last, (head if k == 0 else b"") + bytes(part) + (b"\r\n\r\n" if last else b""), base32_digest(seen.digest())
        if last:
            return
        k += 1


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, sha1, kind, refers_to, row) to chunk rows, a few MB at a time."""
    for batch in batches:
        rows, held = [], 0
        ids, urls, bodies, hexes, kinds, refers, own = batch.columns
        for i in range(batch.num_rows):
            raw = bodies[i].as_buffer()
            payload = memoryview(raw) if raw is not None else memoryview(b"")
            page, kind = ids[i].as_py(), kinds[i].as_py()
            digest = base32_digest(bytes.fromhex(hexes[i].as_py()))
            archive = (0 if page is None else page) % ARCHIVES
            for k, last, data, running in _chunks(page, urls[i].as_py(), kind, digest, refers[i].as_py(), payload):
                rows.append((archive, record_id(page), k, last, data, running, own[i].as_py()))
                held += len(data)
                if held > 1 << 22:
                    yield _rows(rows)
                    rows, held = [], 0
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "record", "chunk", "last", "bytes", "digest", "row"])


def write_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The chunk table of pages (page_id, url, html), written to the shared folder and reread.

    Of records with equal payloads of at least min_bytes bytes that with the smallest page_id is
    the response and the others revisit it; null html is an empty payload. A page without an id
    can be no response to others unless all that share its payload have none, in which case all
    are responses; so are repeated rows of the response itself. Other columns are ignored.
    """
    ready(pages.sparkSession)
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html")).withColumn("sha1", F.sha1("html"))
    first = slim.groupBy("sha1").agg(F.min("page_id").alias("first"))
    again = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = slim.join(first.hint("merge"), "sha1").select(
        "page_id", "url", "html", "sha1", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(told.mapInArrow(_write, _SCHEMA), "warc")


def _parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """(WARC header fields, where the payload starts) of a record's first chunk."""
    end = data.index(b"\r\n\r\n") + 4
    lines = data[: end - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, data.index(b"\r\n\r\n", end) + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows, each record's together and in order, to one row for each record."""
    fields, seen, size, expect, current = None, None, 0, 0, None
    for batch in batches:
        out = []
        records, numbers, lasts, datas, digests, own = (batch.column(i) for i in range(1, 7))
        for i in range(batch.num_rows):
            data = memoryview(datas[i].as_buffer())
            number, last = numbers[i].as_py(), lasts[i].as_py()
            record, row = records[i].as_py(), own[i].as_py()
            if number == 0:
                fields, start = _parse_head(bytes(data))
                data, seen, size, expect, current = data[start:], hashlib.sha1(), 0, 0, row
            if number != expect or row != current:
                raise ValueError(f"chunk {number} of {record} came out of order")
            expect += 1
            if last:
                data = data[:-4]
            revisit = fields["WARC-Type"] == "revisit"
            if not revisit:
                seen.update(data)
                size += len(data)
                if base32_digest(seen.digest()) != digests[i].as_py():
                    raise ValueError(f"the digest of {record} fails at chunk {number}")
            if last:
                told, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                if not revisit and (length != size or told != digests[i].as_py()):
                    raise ValueError(f"{record} has another payload than it tells")
                out.append((page_of(record), length, told, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_records(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each record.

    Records of one chunk are read where they are; the chunks of longer ones are brought together
    and streamed in order. Lengths and digests are checked; a damaged record raises.
    """
    ready(chunks.sparkSession)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    alone = chunks.where("chunk = 0 and last").mapInArrow(_read, schema)
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = chunks.where("not (chunk = 0 and last)").repartition(n, "row").sortWithinPartitions("row", "chunk").mapInArrow(_read, schema)
    return alone.union(long)
