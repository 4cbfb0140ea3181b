"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of WARC 1.1 and gzip.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"

MIN_REVISIT_BYTES = 1000  #: equal payloads of fewer bytes are all written out
FILE_BYTES = 256 << 20  #: a task begins a new archive after so many bytes
SPLIT_BYTES = 32 << 20  #: of an archive, to a reading task
PIECE = 1 << 16

FILES = "path string, bytes long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def _header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    zip_ = zlib.compressobj(level, zlib.DEFLATED, 31)
    return zip_.compress(record) + zip_.flush()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _safe(url: str) -> str:
    """A header field can't hold control characters: they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(row: dict, date: str) -> bytes:
    """A response record, or a revisit record with the response's HTTP header and no payload."""
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _urn(row["page_id"])), ("WARC-Date", date)]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _safe(row["url"])))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(row["refers_to"]))]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return _header(fields, http + (row["payload"] or b""))


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, digest, payload_bytes, record_type, refers_to and payload (null in revisits).

    Counts by digest are combined before they move. Only payloads that occur more than once are
    joined back, by a written table: Spark broadcasts it if it is small, else it splits the join's
    large partitions, so a payload of a third of all pages is no hot task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    named = named.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    counts = named.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    common_ = common.written(counts.where("n > 1 and last is not null").select("digest", "last"), "repeated-payloads")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return named.join(common_, "digest", "left").select(
        "page_id",
        "url",
        "digest",
        "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("last")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", level: int = 5, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; the archives' paths and sizes.

    Each record is a gzip member of its own. Of records with equal payloads of a thousand bytes or
    more, the one with the largest page_id is the response and the others revisit it; rows that
    repeat that page_id are responses too, and so is every row if all page_ids are null. A null html
    is an empty payload, a null url has no target field; other columns are ignored; an empty table
    makes no archive. A task that is tried again writes new files, and the table returned names only
    those of attempts that succeeded.
    """
    folder = common.shared_folder(pages.sparkSession, "warc")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n = None, "", 0
        for row in (x for whole in batches for batch in common.slices(whole, "payload") for x in batch.to_pylist()):
            if out is None:
                path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                out = common.open_output(path)
                info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                out.write(_member(_header(info, b"format: WARC File Format 1.1\r\n"), level))
            out.write(_member(record(row, date), level))
            n += 1
            if out.tell() >= file_bytes:
                yield pa.RecordBatch.from_pylist([{"path": path, "bytes": out.tell(), "records": n}])
                out = out.close()
        if out is not None:
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": out.tell(), "records": n}])
            out.close()

    return common.written(with_revisits(pages).mapInArrow(task, FILES), "archives")


def members(uri: str, start: int, end: int) -> Iterator[bytes]:
    """The decoded gzip members of an archive that begin in the bytes [start, end).

    The range is searched for gzip's magic bytes. A candidate counts if it decodes to a record's
    first line; the next member begins where one ends. A member that ends beyond the range is read to
    its end. (A payload that itself holds archives, and that gzip stored as it is, could be taken for
    records; this writer always deflates.)
    """
    with common.open_input(uri) as f:
        size = f.size()
        data = f.read_at(min(end + len(GZIP_MAGIC) - 1, size) - start, start)
        at = data.find(GZIP_MAGIC)
        while 0 <= at and start + at < end:
            taken = _decode(f, data, at, start, size)
            if taken is None:
                at += 1
            else:
                yield taken[0]
                at = taken[1] - start
            at = data.find(GZIP_MAGIC, at)


def _decode(f, data: bytes, at: int, start: int, size: int) -> tuple[bytes, int] | None:
    """A member's content and the place where it ends, or None if this is no record."""
    unzip, out, place = zlib.decompressobj(31), [], start + at
    try:
        while not unzip.eof:
            piece = data[place - start : place - start + PIECE] if place - start < len(data) else f.read_at(min(16 * PIECE, size - place), place)
            if not piece:
                return None
            out.append(unzip.decompress(piece))
            place += len(piece) - len(unzip.unused_data)
            head = b"".join(out) if len(out) < 3 else out[0]
            if len(head) >= 5 and not head.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    whole = b"".join(out)
    return (whole, place) if whole.startswith(b"WARC/") else None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse(content: bytes) -> dict | None:
    """A row of RECORDS, and the payload, of a response or revisit record; None for other types."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    number = lambda name: int(x) if (x := fields.get(name, "")[len("<urn:page:") : -1]) else None
    row = {"page_id": number("warc-record-id"), "record_type": kind, "refers_to": number("warc-refers-to"), "target_uri": fields.get("warc-target-uri")}
    if kind == "response":
        return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    return row | {"payload": None, "payload_bytes": int(_fields(http)["content-length"]), "payload_digest": digest}


def read_archives(files: DataFrame, payload: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The response and revisit records of the archives in ``files(path, bytes)``: RECORDS, with the
    payload (null in revisits) if asked. Archives are dealt out in byte ranges; a record belongs to
    the range in which it begins, so each is read once, whichever way archives are split."""
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payload
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in batch.to_pylist()):
            rows, held = [], 0
            for content in members(part["path"], part["start"], min(part["start"] + split_bytes, part["bytes"])):
                if row := parse(content):
                    rows.append(row)
                    held += len(content)
                if held > PIECE * 256 or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "path", "start").mapInArrow(task, RECORDS + ", payload binary" * payload)
