"""WARC archives with an index of records, read back by byte ranges.

Writing streams each partition into gzip-per-record WARC files in a shared
folder and returns the index: file, offset, length, URL and digest of every
record.  Each attempt of a task writes files of its own and the index names
those of the attempt that counted, so a lost executor leaves unused files and
no wrong entry.  Reading sorts the selected index entries by file and offset,
merges neighbouring ranges into one read each and cuts the records out.

The shared folder is opened with ``pyarrow.fs``: file, hdfs, s3 and gs paths.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import scratch, written

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables hold no capture time; a fixed one lets reruns agree.
DATE = "1970-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 100
FILE_BYTES, GAP_BYTES, READ_BYTES, OUT_BYTES = 64 << 20, 64 << 10, 8 << 20, 16 << 20
INDEX = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
         "refers_to long, file string, offset long, length long")
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``least`` bytes every row with the smallest
    page_id is a response (a repeated row too), the others revisit it; null
    ids come last and revisit when another id exists.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"payload_bytes": F.octet_length("html").cast("long"),
                       "payload_digest": F.sha2("html", 256),
                       "pk": F.coalesce(F.col("page_id").cast("string"), F.lit("n"))})
    d = p.filter(F.col("payload_bytes") >= least).select("page_id", "pk", "payload_digest")
    first = (d.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
             .filter((F.col("n") > 1) & F.col("refers_to").isNotNull()).select("payload_digest", "refers_to"))
    again = (d.join(written(first, "first"), "payload_digest")
             .filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")))
             .select("pk", "payload_digest", "refers_to").distinct())
    out = p.join(written(again, "revisits"), ["pk", "payload_digest"], "left")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _record(page_id, url, html: str, digest: str, refers_to) -> bytes:
    """One WARC record, not compressed."""
    body = HTTP + html.encode() if refers_to is None else HTTP
    uri = "urn:page:none" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}",
                 f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", f"X-Payload-Bytes: {len(html.encode())}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as an Arrow batch: ids stay whole numbers beside nulls."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)],
                                      schema=schema)


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``with_revisits`` rows as WARC files under ``folder``; returns the stored index."""

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        attempt, n, out, at, name = uuid.uuid4().hex, 0, None, 0, ""
        try:
            for b in batches:
                rows = []
                for i, url, html, size, digest, kind, ref in zip(*[x.to_pylist() for x in b.columns], strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{attempt}-{n:05d}.warc.gz", 0
                        out, n = fs.open_output_stream(f"{root}/{name}", compression=None), n + 1
                    member = gzip.compress(_record(i, url, html, digest, ref), 4, mtime=0)
                    out.write(member)
                    rows.append((i, url, size, digest, kind, ref, name, at, len(member)))
                    at += len(member)
                yield _batch(rows, index)
        finally:
            if out is not None:
                out.close()

    cols = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    index = to_arrow_schema(StructType.fromDDL(INDEX))
    return written(records.select(*cols).mapInArrow(write, INDEX), "index")


def ranges(entries, gap: int = GAP_BYTES, most: int = READ_BYTES):
    """Merge (file, offset, length) entries, sorted, into (file, start, end, entries) reads.

    Neighbours in a file at most ``gap`` bytes apart share a read, until it
    would span more than ``most`` bytes; an entry given twice is read once.
    """
    run: list = []
    for e in entries:
        if run and (e[0] != run[0][0] or e[1] - end > gap or e[1] + e[2] - run[0][1] > most):  # noqa: F821
            yield run[0][0], run[0][1], end, run  # noqa: F821
            run = []
        end = max(end, e[1] + e[2]) if run else e[1] + e[2]
        run.append(e)
    if run:
        yield run[0][0], run[0][1], end, run


def parse(record: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and block of one record."""
    head, block = record.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not at the start of a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(h["content-length"])
    if len(block) != n + 4 or block[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    return h, block[:n]


def read_records(index: DataFrame, folder: str, gap: int = GAP_BYTES, most: int = READ_BYTES,
                 payloads: bool = True) -> DataFrame:
    """The records that the given index entries name, one row per entry.

    ``payload`` is null for revisits, and for all without ``payloads``; rows
    leave a task in batches of at most OUT_BYTES of payloads and a record.  A response's size and digest are those
    of the payload as read, and it is an error if the digest is not the one
    in the header; a revisit's are those in its header.
    """

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        opened, name = None, None
        for b in batches:
            rows, held = [], 0
            for file, start, end, run in ranges(zip(*[x.to_pylist() for x in b.columns], strict=True), gap, most):
                if file != name:
                    if opened is not None:
                        opened.close()
                    opened, name = fs.open_input_file(f"{root}/{file}"), file
                data = memoryview(opened.read_at(int(end - start), int(start)))
                for _, offset, length, url in run:
                    h, block = parse(zlib.decompress(data[offset - start:offset - start + length], 31))
                    page = int(h["x-page"]) if h["x-page"] else None
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "revisit":
                        rows.append((page, url, "revisit", int(h["x-refers-to-page"]), int(h["x-payload-bytes"]),
                                     digest, None))
                        continue
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    got = hashlib.sha256(payload).hexdigest()
                    if got != digest:
                        raise ValueError(f"the payload of page {page} is not the one that was written")
                    rows.append((page, url, h["warc-type"], None, len(payload), got, payload if payloads else None))
                    held += len(payload) if payloads else 0
                    if held >= OUT_BYTES:  # a batch of the index may name far more than fits a worker
                        yield _batch(rows, records)
                        rows, held = [], 0
            yield _batch(rows, records)
        if opened is not None:
            opened.close()

    records = to_arrow_schema(StructType.fromDDL(RECORDS))
    entries = index.select("file", "offset", "length", "url")
    return (entries.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
            .mapInArrow(read, RECORDS))


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write every page (page_id, url, html); returns the index and the folder.

    A null html is an empty payload, a null url is written as ``urn:page:none``
    (the index keeps null), control characters of a url are percent-encoded in
    the header.  Repeated rows are written each.  Other columns are not read.
    No pages: no files and an empty index.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    return write_archives(with_revisits(pages), folder), folder
