"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader cuts files into byte ranges. A task looks for gzip magic in its range, takes a candidate for a record only if
it decompresses to a WARC header, and owns the records that start inside its range; the last may end beyond it. From the
first record on it goes from member to member, so magic bytes inside compressed data are never looked at. Members and
ranges need no index, and a lost task is simply read again.

Archives of others are read as well: every type of record of any version, also several records in one gzip member, with
the digest and length of the payload computed where the record is whole.

Writing: of records with equal payloads, the one with the largest page id carries the payload, and the others are
revisits that refer to it by digest and record id. The groups are found on digests; page texts are shuffled only where
the list of revisits is too long to broadcast. Each task writes one file under a temporary name and renames it when it
is complete; a task that runs again writes the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import common

VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+[ \t]*\r?\n")
_VERSION_LIMIT = 32
_END_OF_HEADER = re.compile(rb"\r?\n\r?\n")
MAGIC = b"\x1f\x8b\x08"
# Every record carries this date unless the caller has a column of dates: output must not depend on the time of writing.
DATE = "1970-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 8 * 1024 * 1024
READ_BYTES = 256 * 1024
_HEADER_LIMIT = 64 * 1024
_RECORD_PREFIX = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    """Header values are one line."""
    return " ".join(value.split())


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member. A revisit leaves the payload out and keeps its digest and length."""
    name = "none" if page_id is None else str(page_id)
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<{_RECORD_PREFIX}{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url or "") or "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if is_revisit:
        headers[4:4] = [("WARC-Refers-To", f"<{_RECORD_PREFIX}{refers_to}>"), ("WARC-Profile", IDENTICAL)]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head + block + b"\r\n\r\n") + press.flush()


def _without_header(block: bytes) -> tuple[bytes, bytes]:
    """What lies before and after the first empty line; all of it before if there is none."""
    found = _END_OF_HEADER.search(block)
    return (block[: found.start()], block[found.end() :]) if found else (block, b"")


def _named(head: bytes) -> dict[str, str]:
    """Header fields by name in lower case; lines that begin with white space go on with the field before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parsed(member: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of a member. Without a length the block is all that is left."""
    while _VERSION_LINE.match(member):
        head, rest = _without_header(member)
        headers = _named(head)
        size = headers.get("content-length", "")
        block = rest[: int(size)] if size.isdigit() else rest
        yield headers, block
        member = rest[len(block) :].lstrip(b"\r\n")


def _page_of(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(_RECORD_PREFIX)
    return int(text) if text.lstrip("-").isdigit() else None


def decided(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``refers_to`` and ``is_revisit`` for every row of ``pages``.

    Payloads of at least ``min_bytes`` bytes are compared by SHA-1 and length. A NULL html is an empty payload. Rows
    without an id never stand for others; if no row of a group has an id, all of them are responses. Rows that repeat the
    id which stands for the group are all responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    key: Column = F.concat_ws(":", F.sha1(F.col("html").cast("binary")), F.octet_length("html"))
    sized = rows.where(F.octet_length("html") >= min_bytes)
    groups = sized.groupBy(key.alias("_key")).agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = common.settle(groups.where("_n > 1").select(F.concat(F.lit("="), "_key").alias("_group"), "_first"))
    small = common.fits_broadcast(groups.count(), 128)
    found = rows.withColumn("_group", F.concat(F.lit("="), key)).join(F.broadcast(groups) if small else groups, "_group", "left")
    is_revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return found.select(
        "page_id", "url", F.col("html").alias("payload"), F.when(is_revisit, F.col("_first")).alias("refers_to"), is_revisit.alias("is_revisit")
    )


def write(pages: DataFrame, folder: str, *, min_bytes: int = 0) -> DataFrame:
    """Write all pages into ``folder`` and return ``path``, ``n_records`` and ``n_bytes`` of each file written.

    An empty table writes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft = f"{path}.{uuid.uuid4().hex}.tmp"
        count = size = 0
        stream = None
        for batch in batches:
            for page_id, url, html, refers_to, is_revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    stream = store.open_output_stream(draft, compression=None)
                member = record_bytes(page_id, url, html.encode(), refers_to, is_revisit)
                stream.write(member)
                count, size = count + 1, size + len(member)
        if stream is not None:
            stream.close()
            store.move(draft, path)
            columns = [pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "n_records", "n_bytes"])

    return decided(pages, min_bytes=min_bytes).mapInArrow(run, "path string, n_records bigint, n_bytes bigint")


class _Window:
    """Forward reading of a file from a position, in pieces of ``READ_BYTES``."""

    def __init__(self, stream: pa.NativeFile, start: int, size: int) -> None:
        self.stream, self.start, self.size = stream, start, size
        self.data = b""

    def fill(self, upto: int) -> None:
        """Have all bytes up to position ``upto``, or to the end of the file."""
        end = self.start + len(self.data)
        if upto > end and end < self.size:
            self.stream.seek(end)
            self.data += self.stream.read(min(self.size, max(upto, end + READ_BYTES)) - end)

    def drop(self, before: int) -> None:
        """Forget what lies before ``before``, once that is worth a copy."""
        if before - self.start > 8 * READ_BYTES:
            self.data = self.data[before - self.start :]
            self.start = before

    def at(self, position: int, length: int) -> bytes:
        self.fill(position + length)
        return self.data[position - self.start : position - self.start + length]


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at``, unpacked, and the position after it; None if no WARC member starts there."""
    if window.at(at, len(MAGIC)) != MAGIC:
        return None
    press = zlib.decompressobj(31)
    parts: list[bytes] = []
    seen, position = 0, at
    try:
        while not press.eof:
            piece = window.at(position, READ_BYTES)
            if not piece:
                return None
            parts.append(press.decompress(piece))
            position += len(piece)
            before, seen = seen, seen + len(parts[-1])
            if before < _VERSION_LIMIT <= seen and not _VERSION_LINE.match(b"".join(parts)):
                return None
            if before < _HEADER_LIMIT <= seen and not _END_OF_HEADER.search(b"".join(parts)):
                return None
    except zlib.error:
        return None
    record = b"".join(parts)
    if not _VERSION_LINE.match(record):
        return None
    return record, position - len(press.unused_data)


def records_of_range(stream: pa.NativeFile, start: int, end: int, size: int) -> Iterator[bytes]:
    """The unpacked members that start in ``[start, end)``."""
    window = _Window(stream, start, size)
    at = start
    while at < min(end, size):
        found = _member(window, at)
        if found:
            record, at = found
            yield record
        else:  # not at a member: find the next candidate
            window.fill(at + READ_BYTES)
            offset = window.data.find(MAGIC, at + 1 - window.start)
            at = window.start + offset if offset >= 0 else max(at + 1, window.start + len(window.data) - len(MAGIC) + 1)
        window.drop(at)


def read(spark: SparkSession, folder: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record below ``folder``: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_digest``,
    ``payload_bytes``, ``payload`` (NULL for a revisit) and ``record_id``.

    The payload of HTTP messages is what follows their header; that of other records, as ``warcinfo`` and ``metadata``, is
    the whole block. Records that ``write`` has not written have no ``page_id``, and revisits only the digest and length
    that they state. A field that a record lacks is NULL. A payload that contradicts the digest under which ``write``
    stored it is an error.

    Spark lists the files; their sizes give the ranges, which are dealt out evenly.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    ranges = files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("start")
    )
    n = max(1, int(ranges.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as stream:
                    rows: list[tuple] = []
                    held = 0
                    for member in records_of_range(stream, start, start + split_bytes, size):
                        rows += [_row(headers, block) for headers, block in parsed(member)]
                        held += len(member)
                        if held > SPLIT_BYTES:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    return ranges.repartition(n).mapInArrow(run, READ_SCHEMA)


READ_SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary,"
    " record_id string"
)
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("record_id", pa.string()),
    ]
)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers.get("warc-type", "").lower() or None
    stated, size = headers.get("warc-payload-digest", ""), headers.get("x-payload-length", "")
    digest = stated.removeprefix("sha1:") if stated.startswith("sha1:") else None
    length, payload = int(size) if size.isdigit() else None, None
    if kind != "revisit":
        is_message = headers.get("content-type", "").lower().startswith("application/http")
        payload = _without_header(block)[1] if is_message else block
        found = payload_digest(payload)
        if length is not None and (digest, length) != (found, len(payload)):
            raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
        digest, length = found, len(payload)
    name = headers.get("warc-record-id")
    page, first = _page_of(name), _page_of(headers.get("warc-refers-to"))
    return page, headers.get("warc-target-uri"), kind, first, digest, length, payload, name


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
