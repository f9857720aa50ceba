"""A deterministic, sharded WARC writer, and its reader.

Pages are cut into ranges of page_id that depend on the ids alone, sorted, and written one
gzip member per record; a file is closed when its compressed size reaches a limit. Names,
headers and digests follow from the rows, so a repeated task or run writes the same bytes
under the same names, through temporary names; a manifest lists what counts.

Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is
the ``response`` and the others ``revisit`` it, without the payload.

Defined cases: NULL html is an empty payload; NULL url leaves out the target header; line ends in a url
are written as %0D and %0A; rows of equal page_id and payload are all responses if theirs is the
smallest page_id, and rows of equal page_id but different payloads stay separate records; a NULL
page_id comes first and never gives the response while another page has the payload; an empty table gives
no file; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.files import new_file, open_file
from tuneprep.llm.ranges import even_splits, range_of
from tuneprep.storage import materialize, scratch_path

LEAST = 0
RANGE_ROWS = 4_096
FILE_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: HTTP headers and payload, or for a revisit the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("range", "page_id", "kind", "url", "html", "digest", "first")])


def _write(batches: Iterator[pa.RecordBatch], out: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, page and kind; a page's revisit marks come right before it."""
    rows = _rows(batches)
    row = next(rows, None)
    at, number, marks = None, 0, (None, {})
    while row is not None:
        number = number + 1 if at == row[0] else 0
        at = row[0]
        path = f"{out}/pages-{at:06d}-{number:04d}.warc.gz"
        written = records = 0
        with new_file(path) as stream:
            while row is not None and row[0] == at and written < file_bytes:
                _, page_id, kind, url, html, digest, first = row
                if marks[0] != (page_id,):
                    marks = ((page_id,), {})
                if kind == 0:
                    marks[1][digest] = first
                else:
                    payload = (html or "").encode()
                    sha1 = hashlib.sha1(payload).digest()
                    press = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record(page_id, url, payload, base32_sha1(sha1), marks[1].get(sha1.hex()))
                    member = press.compress(raw) + press.flush()
                    stream.write(member)
                    written, records = written + len(member), records + 1
                row = next(rows, None)
        if records:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [written]})


def write_pages(
    pages: DataFrame, out: str, least: int = LEAST, range_rows: int = RANGE_ROWS, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write the archive below ``out`` and return the manifest (path, records, bytes).

    Who revisits whom is found on digests alone. The pages are shuffled once; a revisit mark is a
    short row that sorts right before its page.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    digests = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    digests = digests.where(F.col("size") >= least).drop("size")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    marks = digests.join(firsts.where("n > 1").drop("n"), "digest").where(again & F.col("first").isNotNull()).distinct()

    splits = spark.sparkContext.broadcast(np.array(even_splits(pages, "page_id", range_rows), np.int64))

    @F.arrow_udf("int")
    def range_number(ids: pa.Array) -> pa.Array:
        keys = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        return pa.array(range_of(keys, splits.value).astype(np.int32))

    empty = F.lit(None).cast("string")
    page_id = F.col("page_id").cast("long").alias("page_id")
    rows = pages.select(page_id, F.lit(1).alias("kind"), "url", "html", empty.alias("digest"), F.lit(None).cast("long").alias("first"))
    rows = rows.unionByName(
        marks.select(page_id, F.lit(0).alias("kind"), empty.alias("url"), empty.alias("html"), "digest", F.col("first").cast("long").alias("first"))
    )
    ordered = (
        rows.withColumn("range", range_number("page_id"))
        .repartitionById(len(splits.value) + 1, "range")
        .sortWithinPartitions("range", "page_id", "kind", "html")
    )
    written = ordered.mapInArrow(lambda b: _write(b, out, file_bytes), "path string, records long, bytes long")
    return materialize(written, "warc-manifest")


HEADER = re.compile(rb"^([A-Za-z-]+): (.*)$", re.M)


def members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    press, parts, data = zlib.decompressobj(31), [], source.read(chunk)
    while data:
        parts.append(press.decompress(data))
        if press.eof:
            yield b"".join(parts)
            data, parts, press = press.unused_data or source.read(chunk), [], zlib.decompressobj(31)
        else:
            data = source.read(chunk)


def parse(raw: bytes) -> dict:
    """A record's page, type, referred page, payload size and digest; the digest of a payload is checked."""
    head, block = raw.split(CRLF + CRLF, 1)
    fields = {k.lower(): v for k, v in HEADER.findall(head.replace(CRLF, b"\n"))}
    block = block[: int(fields[b"content-length"])]
    http, payload = block.split(CRLF + CRLF, 1)
    kind = fields[b"warc-type"].decode()
    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response" and base32_sha1(hashlib.sha1(payload).digest()) != digest:
        raise ValueError("A payload does not have its digest.")

    def page(name: bytes) -> int | None:
        text = fields[name].decode()[len("<urn:page:") : -1] if name in fields else "None"
        return None if text == "None" else int(text)

    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {
        "page_id": page(b"warc-record-id"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page(b"warc-refers-to"),
    }


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )
    for batch in batches:
        for path in batch.column("path").to_pylist():
            found = []
            with open_file(path) as source:
                for raw in members(source):
                    found.append(parse(raw))
                    if len(found) == 4096:
                        yield pa.RecordBatch.from_pylist(found, schema)
                        found = []
            yield pa.RecordBatch.from_pylist(found, schema)


def read_pages(manifest: DataFrame) -> DataFrame:
    """The records of the files that the manifest names."""
    files = max(1, manifest.count())  # a row is short, but its task reads the file
    return manifest.select("path").repartition(files, "path").mapInArrow(_read, RECORDS)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages below the shared folder and describe the records read back."""
    return read_pages(write_pages(pages, scratch_path(pages.sparkSession, "warc"), least))
