"""WARC archives: writing with payload deduplication, and reading with reassembly of segmented records.

A long record is cut into segments (ISO 28500): the first keeps its type and gets number 1, the others are
``continuation`` records with the id of the first as origin and a running number; the last states the total length.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, stored

MIN_REVISIT_BYTES = 100
SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
RECORDS_PER_FILE = 4096
#: extension field of segments: the written row they belong to
ROW_FIELD = "X-Segment-Row"
DATE = "2000-01-01T00:00:00Z"
_PAGE = re.compile(r"<urn:page:(-?\d+|none):")


# -- writing ---------------------------------------------------------------------------------------------------------


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:16]}>"


def _head(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Body in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def page_records(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool,
    segment_bytes: int = SEGMENT_BYTES, row: str | None = None,
) -> Iterator[bytes]:
    """The records of one page, without the two line ends after each.

    Pages with equal page_id and payload have one record id, which revisits name; ``row`` tells their segments apart.
    """
    rid = _record_id(page_id, digest)
    common = [
        ("WARC-Target-URI", re.sub(r"[\x00-\x20]+", "%20", url) if url is not None else None),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        # the headers of the later fetch; the payload is that of the record it refers to
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        fields = [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", rid),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
        yield _head(fields + common, len(block)) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common]
    if len(block) <= segment_bytes:
        yield _head(fields, len(block)) + block
        return
    starts = range(0, len(block), segment_bytes)
    for number, at in enumerate(starts, 1):
        own = block[at : at + segment_bytes]
        if number == 1:
            yield _head([*fields, ("WARC-Segment-Number", 1), (ROW_FIELD, row)], len(own)) + own
            continue
        more: list[tuple[str, object]] = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"{rid[:-1]}:{number}>"),
            *common[:2],
            ("WARC-Segment-Origin-ID", rid),
            ("WARC-Segment-Number", number),
            (ROW_FIELD, row),
            ("WARC-Segment-Total-Length", len(block) if number == len(starts) else None),
        ]
        yield _head(more, len(own)) + own


def write_archives(
    pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE
) -> None:
    """Write a record per page as gzipped WARC files.

    Of pages with equal payloads of at least 100 bytes, the one with the smallest page_id is a response and the others
    revisit it. Digests are counted before anything moves; only those that occur more than once are joined back, and
    the pages themselves stay in the tasks that read them (unless there are too many repeated digests to send around).
    Spark's text sink writes the files, with the two line ends after a record as its line separator; a file has at most
    ``records_per_file`` records of at most ``segment_bytes`` bytes of content.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    repeated = stored(
        rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first_id"),
        "repeated-payloads",
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for record in page_records(*row, segment_bytes, f"{task}-{next(numbers)}"):
                    out.append(record)
                    size += len(record)
                if size >= 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (
        rows.join(repeated, "digest", "left")
        .select(
            "page_id", "url", "payload", "digest", "first_id",
            F.coalesce((F.col("page_id") > F.col("first_id")) | (F.col("page_id").isNull() & F.col("first_id").isNotNull()), F.lit(False)).alias("revisit"),
        )
        .mapInArrow(build, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


# -- reading ---------------------------------------------------------------------------------------------------------


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an uncompressed archive, one at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def dechunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing (chunk extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length than stated")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and decoded payload of a response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("latin-1").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _page_of(record_id: str) -> int | None:
    found = _PAGE.match(record_id)
    return int(found[1]) if found and found[1] != "none" else None


_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean"
_ARROW_ROW = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("complete", pa.bool_())]


def _described(fields: dict[str, str], block: bytes) -> tuple:
    """What is known of a whole record."""
    http, payload = http_payload(block)
    kind, page = fields["warc-type"], _page_of(fields["warc-record-id"])
    if kind == "revisit":
        digest = fields["warc-payload-digest"].partition(":")[2]
        return page, int(http["content-length"]), digest, kind, _page_of(fields["warc-refers-to"]), True
    digest = hashlib.sha256(payload).hexdigest()
    stated = fields.get("warc-payload-digest", f"sha256:{digest}")
    return page, len(payload), digest, kind, None, stated == f"sha256:{digest}"


def reassembled(record_id: str, kind: str, parts: list[dict]) -> list[tuple]:
    """Records from their segments: ordered by number, none missing, of the stated total length.

    Equal records that were written more than once come back as often. A record with a missing segment or another
    length comes back as one row that is not complete.
    """
    by_number: dict[int, list[dict]] = {}
    for part in parts:
        by_number.setdefault(part["number"], []).append(part)
    order = sorted(by_number)
    block = b"".join(by_number[k][0]["block"] for k in order)
    total = next((p["total"] for p in by_number[order[-1]] if p["total"] is not None), None)
    if order != list(range(1, len(order) + 1)) or len(block) != total:
        return [(_page_of(record_id), None, None, kind, None, False)]
    return [_described({"warc-type": kind, "warc-record-id": record_id}, block)] * len(by_number[1])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, complete.

    Each archive is read record by record. Whole records are decoded on the spot and leave as digests; only segments
    carry their bytes into the shuffle by origin id and written row, so that each record is ordered, checked and decoded
    on its own however often it was written. Without the row (archives from elsewhere) the origin id alone is the key.
    Records of other types than response, revisit and continuation are passed over.
    """
    piece = pa.struct([("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
    names = ["origin", "row", *(n for n, _ in _ARROW_ROW), "segment"]
    types = [pa.string(), pa.string(), *(t for _, t in _ARROW_ROW), piece]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([] for _ in names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                raw = io.BytesIO(content.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if raw.read(2) == b"\x1f\x8b" else raw
                raw.seek(0)
                rows, size = [], 0
                for fields, block in parse_records(stream):
                    kind, rid = fields["warc-type"], fields["warc-record-id"]
                    if "warc-segment-number" in fields:
                        total = fields.get("warc-segment-total-length")
                        segment = {"number": int(fields["warc-segment-number"]), "total": int(total) if total else None, "block": block}
                        origin = fields.get("warc-segment-origin-id", rid)
                        own_kind = None if kind == "continuation" else kind
                        rows.append((origin, fields.get(ROW_FIELD.lower(), ""), None, None, None, own_kind, None, None, segment))
                        size += len(block)
                    elif kind in ("response", "revisit"):
                        rows.append((None, None, *_described(fields, block), None))
                    if len(rows) >= 5_000 or size >= 1 << 23:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for origin, whole, kind, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [tuple(whole.values())] if origin is None else reassembled(origin, kind or "response", parts)
            columns = zip(*rows, strict=True) if rows else ([] for _ in _ARROW_ROW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(columns, _ARROW_ROW, strict=True)], names=[n for n, _ in _ARROW_ROW]
            )

    records = (
        spark.read.format("binaryFile")
        .load(path)
        .select("content")
        .mapInArrow(read, f"origin string, row string, {_ROW}, segment struct<number: int, total: bigint, block: binary>")
    )
    own = [n for n, _ in _ARROW_ROW]
    # whole records get a key of their own, so that one pass over the archives serves both kinds
    key = F.coalesce(F.concat("origin", F.lit(" "), "row"), F.concat(F.lit("whole "), F.monotonically_increasing_id().cast("string")))
    return (
        records.withColumn("key", key)
        .groupBy("key")
        .agg(
            F.first("origin").alias("origin"),
            F.first(F.struct(*own)).alias("whole"),
            F.max("record_type").alias("kind"),
            F.collect_list("segment").alias("parts"),
        )
        .select("origin", "whole", "kind", "parts")
        .mapInArrow(join_up, _ROW)
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages as archives to the shared folder and read them back (see ``read_archives``).

    A null html is an empty payload. A page without id takes part like the others; among equal payloads it revisits the
    smallest id, if there is one. Rows that share page_id and payload are all responses (or all revisits). A null url
    is left out of the record. An empty table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "archives")
    write_archives(pages, path)
    return read_archives(spark, path)
