"""WARC archives: one gzip member per record, written and read by tasks.

Every writing task makes files of its own and reports them; only reported files count, so a repeated task does no
harm. The reader is splittable: a task scans its byte range for gzip magic, accepts a place as a member if
its first bytes inflate to a WARC header, and owns the records that start inside its range, to their end.
Payloads that occur several times are stored once; the others are revisit records that name it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimspark.session import materialise, scratch_path
from claimspark.sources.paths import file_system

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE_END = b"\r\n"

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
SPLIT_BYTES = 32 << 20
_READ = 1 << 20
_DATE = "2020-01-01T00:00:00Z"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One record as a gzip member. ``refers_to`` makes it a revisit, which has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response")]
    head.append(("WARC-Record-ID", f"<urn:page:{'none:' + digest if page_id is None else page_id}>"))
    head.append(("WARC-Date", _DATE))
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    block = http if revisit else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = VERSION + LINE_END + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + LINE_END + block + LINE_END * 2
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def revisits(pages: DataFrame, id_col: str, payload, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``digest, response_id`` of the payloads that several records share; digests only are grouped."""
    digests = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    groups = digests.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("id").alias("response_id"), F.count("*").alias("rows"))
    return groups.filter("rows > 1 and response_id is not null").select("digest", "response_id")


_FILES = "path string, bytes long, records long"


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row below ``folder``; returns ``path, bytes, records`` of the files written.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is a response, others
    revisit it; rows that repeat that id are responses too. NULL html is an empty payload, a NULL url is left
    out, a NULL id has a record name without number and is never the one revisited. Line ends in urls are
    percent-encoded. Other columns are ignored. An empty table writes no file.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    shared = materialise(revisits(pages, id_col, payload, min_bytes), "warc-shared")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.join(shared, "digest", "left").select(
        "id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, path, size, records = [], None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    system, inner = file_system(path)
                    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out, size, records = system.open_output_stream(inner, compression=None), 0, 0
                member = record_bytes(row["id"], row["url"], row["payload"], row["digest"], row["refers_to"], len(row["payload"]))
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= file_bytes:
                    out.close()
                    files.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            files.append((path, size, records))
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files]) for i in range(3)], ["path", "bytes", "records"])

    return materialise(rows.mapInArrow(write, _FILES), "warc-files")


class _Window:
    """Bytes of a file by absolute place, read in pieces and forgotten behind the reader."""

    def __init__(self, stream, start: int):
        self.stream, self.base, self.data = stream, start, bytearray()
        stream.seek(start)

    def have(self, end: int) -> bool:
        while self.base + len(self.data) < end:
            more = self.stream.read(_READ)
            if not more:
                return False
            self.data += more
        return True

    def forget(self, place: int) -> None:
        if place - self.base > 4 * _READ:
            del self.data[: place - self.base]
            self.base = place

    def member(self, start: int) -> tuple[bytes, int] | None:
        """The inflated member at ``start`` and its end, or None if none begins there."""
        inflater, text, at = zlib.decompressobj(31), bytearray(), start
        while not inflater.eof:
            self.have(at + 1)
            piece = bytes(self.data[at - self.base : at - self.base + (4096 if not text else _READ)])
            if not piece:
                return None
            try:
                text += inflater.decompress(piece)
            except zlib.error:
                return None
            at += len(piece)
            if len(text) >= 5 and not text.startswith(b"WARC/"):
                return None
        return bytes(text), at - len(inflater.unused_data)


def records_in(stream, start: int, end: int) -> Iterator[bytes]:
    """The records whose members begin in ``start .. end - 1``."""
    window, at = _Window(stream, start), start
    while at < end:
        window.have(min(at + _READ, end + len(MAGIC)))
        found = window.data.find(MAGIC, at - window.base)
        if found < 0 or window.base + found >= end:
            loaded = window.base + len(window.data)
            # A member that begins in the last byte before ``end`` shows its magic only behind it.
            if found >= 0 or loaded >= end + len(MAGIC) - 1 or not window.have(loaded + 1):
                return
            at = max(at, loaded - len(MAGIC) + 1)
            window.forget(at)
            continue
        at = window.base + found
        member = window.member(at)
        if member is None:
            at += 1
            continue
        yield member[0]
        at = member[1]
        window.forget(at)


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of its HTTP head, payload."""
    head, _, rest = record.partition(LINE_END * 2)
    fields = _headers(head)
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(LINE_END * 2)
    return fields, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(LINE_END)[1:])
    return {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}


_ROWS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_NAMES = [c.split(" ")[0] for c in _ROWS.split(", ")]


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives in ``files`` (``path, bytes``): id, url, type, payload (NULL for revisits), size and SHA-1 of the
    full payload, and the id that a revisit refers to. The digest of a stored payload is computed from what was read."""
    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    count = max(1, splits.count())
    splits = splits.repartitionByRange(count, "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        rows, size = [], 0
        for batch in batches:
            for split in batch.to_pylist():
                system, inner = file_system(split["path"])
                with system.open_input_file(inner) as stream:
                    for record in records_in(stream, split["start"], split["end"]):
                        fields, http, payload = parse_record(record)
                        revisit = fields["warc-type"] == "revisit"
                        rows.append((
                            _page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], None if revisit else payload,
                            int(http["content-length"]) if revisit else len(payload),
                            fields["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
                            _page(fields.get("warc-refers-to")),
                        ))
                        size += len(record)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=schema)

    return splits.mapInArrow(read, _ROWS)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new folder below the shared one and read the archives back."""
    return read_warc(write_warc(pages, scratch_path(spark, "warc"), **options))
