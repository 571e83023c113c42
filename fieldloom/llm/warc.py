"""WARC archives with an index written first and coalesced byte-range reads.

Writing: every page is one record, compressed as a gzip member of its own.  Among records of
equal payload digest the one of the smallest page_id is a ``response``; the others are
``revisit`` records without a body that name it.  Each attempt of a task writes an archive of
its own name; the index holds path, offset, length, URL and digest per record, and as only the
attempt that Spark commits puts rows there, what a lost attempt left is never read.

Reading: selected index rows are sorted by path and offset; ranges at most ``gap`` bytes apart
are read at once, up to ``READ_BYTES`` per read, and the members within are decoded.  Tasks
are as many as the selected bytes need at ``TASK_BYTES`` each, since the index alone, which is all
that Spark sees of them, is small; a body's digest is computed again and compared with its header.

A response holds an HTTP message, a status line and headers before the payload, as other readers
expect; the payload digest and length are those of the payload alone.

Edge cases: a null html is an empty payload, a null url an empty one; repeated rows of one
page_id and equal payload are records each, of the type that page_id has; payloads below
``min_revisit_bytes`` are all responses; payloads of any size are one record; records
without a page_id revisit the one that has the smallest, or are all responses where none has; other columns,
whatever their names, are not read; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.shared import Scratch, fresh_path
from fieldloom.llm.textkit import release

READ_BYTES, TASK_BYTES = 8 << 20, 64 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ROWS_PER_BATCH, ROWS_AT_ONCE = 2000, 128
_INDEX = "page_id long, path string, offset long, length long, url string, digest string"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _clean(url: str) -> str:
    """A header value keeps to its line."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def encode_record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit has no payload, its headers tell the payload's size."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append("Content-Type: application/http; msgtype=response")
    payload = HTTP_HEAD + payload
    head.append(f"Content-Length: {len(payload)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def decode_record(raw: bytes) -> tuple:
    """(page_id, url, type, refers_to, digest, payload size, payload), the digest of a body recomputed."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    name = fields["WARC-Record-ID"][10:-1]
    page = int(name) if name else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest:
            raise ValueError(f"record {page}: payload digest {own}, header {digest}")
        return page, _unclean(fields["WARC-Target-URI"]), "response", None, own, len(payload), payload
    return page, _unclean(fields["WARC-Target-URI"]), "revisit", int(fields["WARC-Refers-To"][10:-1]), digest, int(fields["X-Payload-Length"]), None


def _filesystem(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base if "://" in base or base.startswith("file:") else "file://" + os.path.abspath(base))


def _uri(base: str) -> str:
    """file:/x as file:///x, which every reader takes."""
    return "file://" + base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base


def _writer(base: str):
    """Writes a task's records into one archive; yields its index."""

    def run(batches):
        fs, root = _filesystem(base)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        offset, index, out = 0, [], None
        for b in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
            for page, url, payload, size, sha, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "sha", "refers_to")), strict=True):
                digest = base64.b32encode(sha).decode()
                raw = encode_record(page, url or "", (payload or b"") if refers is None else b"", size, digest, refers)
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(raw)
                index.append((page, f"{base}/{name}", offset, len(raw), url, digest))
                offset += len(raw)
            if len(index) >= ROWS_PER_BATCH:
                yield _index_batch(index)
                index = []
        if out is not None:
            out.close()
        yield _index_batch(index)
        index, b = [], None
        release()

    return run


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "path", "offset", "length", "url", "digest"])


def write_archives(pages: DataFrame, base: str, min_revisit_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) under ``base``; returns the written index.

    Only responses carry their body to the writer.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    hashed = plain.select("page_id", "url", F.octet_length("payload").cast("long").alias("size"), F.unhex(F.sha1("payload")).alias("sha"), "payload")
    shared = hashed.where(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    marked = hashed.join(scratch.table(shared, "shared"), "sha", "left")
    refers = F.when((F.col("size") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = marked.select("page_id", "url", "size", "sha", F.when(refers.isNull(), F.col("payload")).alias("payload"), refers.alias("refers_to"))
    return scratch.table(rows.mapInArrow(_writer(_uri(base)), _INDEX), "index")


def ranges(rows: list[tuple[int, int]], gap: int, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """Reads (start, end, which rows) that cover sorted (offset, length) rows."""
    own: list[int] = []
    start = end = 0
    for i, (offset, length) in enumerate(rows):
        if own and (offset - end > gap or offset + length - start > most):
            yield start, end, own
            own = []
        if not own:
            start = end = offset
        end = max(end, offset + length)
        own.append(i)
    if own:
        yield start, end, own


def _reader(gap: int, bodies: bool):
    def run(batches):
        for b in batches:
            paths, offsets, lengths = (b.column(c).to_pylist() for c in ("path", "offset", "length"))
            i = 0
            while i < len(paths):
                j = i
                while j < len(paths) and paths[j] == paths[i]:
                    j += 1
                fs, root = _filesystem(paths[i])
                with fs.open_input_file(root) as f:
                    for start, end, own in ranges(list(zip(offsets[i:j], lengths[i:j], strict=True)), gap):
                        raw = f.read_at(end - start, start)
                        rows = [decode_record(raw[offsets[i + k] - start : offsets[i + k] - start + lengths[i + k]]) for k in own]
                        yield _record_batch(rows, bodies)
                        raw, rows = b"", []
                i = j
        release()

    return run


def _record_batch(rows: list[tuple], bodies: bool) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)]
    if not bodies:
        cols[-1] = [None] * len(rows)
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])


def read_records(selected: DataFrame, gap: int = 4096, bodies: bool = True) -> DataFrame:
    """The records that rows of an index name; reads are sorted and coalesced."""
    parts = int((selected.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES) + selected.sparkSession.sparkContext.defaultParallelism
    spread = selected.select("path", "offset", "length").repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(_reader(gap, bodies), _RECORD)


def new_archive_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "archives")
