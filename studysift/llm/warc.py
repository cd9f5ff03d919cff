"""Legacy web archives (ARC) and their conversion to WARC.

ARC files start with a version block that tells how many fields a record's header line has: five in version 1, ten in
version 2. The last field is the block's length in bytes, and the block follows the line. Conversion synthesises what
WARC asks for and ARC lacks: record identifiers, ISO timestamps, record types, block and payload digests. Of records
with equal payloads of at least ``REVISIT_BYTES`` the one with the smallest page id stays a response and the others
become revisits without a payload.

Archives are cut at ``ARCHIVE_BYTES``, so that reading one stays within a task's memory, and are written by Spark's
text writer, one record a row, gzipped. Payloads are not shuffled unless the table of repeated payloads is too large
to be broadcast; then the join on the digest is left to adaptive execution, which splits a frequent payload.

Defined results: a null payload is empty; a null url becomes ``urn:page:`` and the id; a null ``page_id`` is carried
as an absent field and never is the response that others refer to, unless all are null; repeated rows that share the
smallest id are all responses; an empty table gives an empty result. A record that breaks the format raises an error
with the archive's name and place.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studysift.llm.common import stored
from studysift.operators.storage import shared_folder

ARCHIVE_BYTES = 32 << 20
REVISIT_BYTES = 100
BATCH_BYTES = 8 << 20
FETCHED = "20240101000000"  # ARC date of pages that come without one
FIELDS = {1: 5, 2: 10}
HEADS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/studysift/{name}-{uuid.uuid4().hex}"


# ARC: writing


def version_block(version: int, archive: str) -> bytes:
    body = f"{version} 0 studysift\n{HEADS[version]}\n".encode()
    line = {
        1: f"filedesc://{archive} 0.0.0.0 {FETCHED} text/plain {len(body)}\n",
        2: f"filedesc://{archive} 0.0.0.0 {FETCHED} text/plain 200 - - 0 {archive} {len(body)}\n",
    }[version]
    return line.encode() + body


def arc_record(version: int, archive: str, offset: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    owner = "" if page_id is None else str(page_id)
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{owner}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {owner}\r\n\r\n".encode()
    size = len(head) + len(payload)
    line = {
        1: f"{target} 0.0.0.0 {FETCHED} text/html {size}\n",
        2: f"{target} 0.0.0.0 {FETCHED} text/html 200 - - {offset} {archive} {size}\n",
    }[version]
    return line.encode() + head + payload


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of the pages, version 1 from tasks with even numbers and version 2 from the others; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        version, number, held, offset = 1 + task % 2, 0, 0, archive_bytes
        rows: list[tuple[str, int, bytes]] = []
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if offset >= archive_bytes:
                    number, offset, place = number + 1, 0, 0
                    archive = f"{task:06d}-{number:05d}"
                    rows.append((archive, place, version_block(version, archive)))
                    offset = len(rows[-1][2]) + 1
                place += 1
                rows.append((archive, place, arc_record(version, archive, offset, page_id, url, (html or "").encode())))
                offset += len(rows[-1][2]) + 1
                held += len(rows[-1][2])
                if held >= BATCH_BYTES:
                    yield _batch(rows, ["archive", "place", "value"], [pa.string(), pa.int64(), pa.binary()])
                    rows, held = [], 0
        yield _batch(rows, ["archive", "place", "value"], [pa.string(), pa.int64(), pa.binary()])

    asked = pages.select(F.col("page_id").cast("long"), "url", "html")
    records = asked.mapInArrow(run, "archive string, place long, value binary")
    _write(records, path, "\n")


def _write(records: DataFrame, path: str, separator: str) -> None:
    """One gzipped file per archive, its records in order of place, each followed by the separator."""
    (
        records.sortWithinPartitions("archive", "place")
        .select("archive", F.col("value").cast("string").alias("value"))
        .write.partitionBy("archive")
        .option("lineSep", separator)
        .option("compression", "gzip")
        .text(path)
    )


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


# ARC: reading


def arc_records(data: bytes, name: str) -> Iterator[tuple[int, int, list[str], bytes]]:
    """``(offset, version, header fields, block)`` of each record, the version block first and at offset 0."""
    at, version, first = 0, 0, True
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r") if stop >= 0 else ""
        if not version:
            if not line.startswith("filedesc://"):
                raise ValueError(f"{name}: no version block")
            version = int(data[stop + 1 : stop + 2] or b"0")
            if version not in FIELDS:
                raise ValueError(f"{name}: unknown version")
        fields = line.rsplit(" ", FIELDS[version] - 1)
        if len(fields) != FIELDS[version] or not fields[-1].isdigit() or stop + 1 + int(fields[-1]) > len(data):
            raise ValueError(f"{name}: broken record at byte {at}")
        end = stop + 1 + int(fields[-1])
        yield 0 if first else at, version, fields, data[stop + 1 : end]
        at, first = end, False


RECORD = "archive string, place long, version int, page_id long, url string, ip string, date string, mime string, http binary, payload_bytes long, payload_digest string"
RECORD_ARROW = [pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string(), pa.binary()]


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under the path; digests always, payloads on request."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                for offset, version, fields, block in arc_records(gzip.decompress(content), name):
                    head, gap, payload = block.partition(b"\r\n\r\n")
                    if not gap or not head.startswith(b"HTTP/"):  # not a reply of a web server: all is payload
                        head, payload = b"", block
                    owner = header_fields(head).get("x-page-id")
                    digest = hashlib.sha256(payload).hexdigest()
                    row = (name, offset, version, int(owner) if owner else None, *fields[:4], head + gap if head else b"")
                    rows.append((*row, len(payload), digest, payload))
                    held += len(payload) if payloads else 200
                    if held >= BATCH_BYTES:
                        yield _batch(rows, names, RECORD_ARROW[: len(names)])
                        rows, held = [], 0
        yield _batch(rows, names, RECORD_ARROW[: len(names)])

    return _archives(spark, path).mapInArrow(run, schema)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True)
    return files.load(path).select(F.regexp_extract("path", "archive=([^/]+)", 1).alias("archive"), "content")


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


# Conversion


def repeated_payloads(records: DataFrame) -> DataFrame:
    """``(payload_digest, first)`` of payloads that several records share: page, archive and place of their first."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "archive", "place")).alias("first")
    pages = records.filter((F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("place") > 0))
    return pages.groupBy("payload_digest").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")


def iso_date(arc_date: Column) -> Column:
    """``20240131235959`` as ``2024-01-31T23:59:59Z``; shorter dates are filled up."""
    full = F.concat(arc_date, F.substring(F.lit("00000101000000"), F.length(arc_date) + 1, F.lit(14)))
    groups = r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*"
    return F.regexp_replace(full, groups, "$1-$2-$3T$4:$5:$6Z")


def record_id(archive: Column, place: Column) -> Column:
    """A name-based identifier from where the record stands, the same whenever the same archive is converted."""
    name = F.md5(F.concat_ws(" ", archive, place.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def to_warc(records: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(archive, place, value)``: WARC records equivalent to the ARC records.

    The version block is the record at the start of its archive, whatever the urls of other records look like.
    """
    joined = records.join(repeated, "payload_digest", "left")
    page, first, url, info = F.col("page_id"), F.col("first.page_id"), F.col("url"), F.col("place") == 0
    revisit = ~info & F.col("first").isNotNull() & ~page.eqNullSafe(first)
    web = F.octet_length("http") > 0
    kind = F.when(info, "warcinfo").when(revisit, "revisit").when(web, "response").otherwise("resource")
    about = F.format_string("format: WARC File Format 1.0\r\ndescription: converted from %s, ARC version %d\r\n", url, "version")
    block = F.when(info, about.cast("binary")).otherwise(
        F.concat("http", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    )
    mime = F.when(info, "application/warc-fields").when(web, "application/http; msgtype=response").otherwise(F.col("mime"))
    joined = joined.select("archive", "place", "page_id", "first", "url", "ip", "payload_digest", "payload_bytes",
                           F.col("date").alias("arc_date"), block.alias("block"), kind.alias("kind"), mime.alias("type"))
    again, info = F.col("kind") == "revisit", F.col("kind") == "warcinfo"
    named = [
        ("WARC-Type", F.col("kind")),
        ("WARC-Record-ID", record_id(F.col("archive"), F.col("place"))),
        ("WARC-Date", iso_date(F.col("arc_date"))),
        ("WARC-Target-URI", F.when(~info, url)),
        ("WARC-Refers-To", F.when(again, record_id(F.col("first.archive"), F.col("first.place")))),
        ("WARC-IP-Address", F.when(~info & (F.col("ip") != "0.0.0.0"), F.col("ip"))),
        ("WARC-Payload-Digest", F.when(~info, F.concat(F.lit("sha256:"), "payload_digest"))),
        ("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        ("X-Refers-To-Page-Id", F.when(again, first)),
        ("X-Page-Id", page),
        ("X-Payload-Length", F.when(~info, F.col("payload_bytes"))),
        ("Content-Type", F.col("type")),
        ("Content-Length", F.octet_length("block")),
    ]
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in named]  # an absent value leaves its line out
    head = F.concat(F.concat_ws("\r\n", F.lit("WARC/1.0"), *lines), F.lit("\r\n\r\n"))
    return joined.select("archive", "place", F.concat(head.cast("binary"), F.col("block")).alias("value"))


def warc_records(data: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\r\n\r\n", at)
        fields = header_fields(data[at:stop]) if stop >= 0 and data.startswith(b"WARC/", at) else {}
        length = fields.get("content-length", "")
        if not length.isdigit() or stop + 4 + int(length) > len(data):
            raise ValueError(f"{name}: broken record at byte {at}")
        at = stop + 4 + int(length)
        yield fields, data[stop + 4 : at]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url, date)`` of each page's record.

    A response's payload is measured and its digest taken anew, and both must agree with the header.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def row(fields: dict[str, str], block: bytes, name: str) -> tuple:
        kind, size = fields["warc-type"], int(fields["x-payload-length"])
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if kind != "revisit":
            payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{name}: a payload does not agree with its digest")
        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
        return (int(page) if page else None, size, digest, kind, int(refers) if refers else None,
                fields["warc-target-uri"], fields["warc-date"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                records = warc_records(gzip.decompress(content), name)
                rows = [row(f, b, name) for f, b in records if f["warc-type"] != "warcinfo"]
                yield _batch(rows, names, kinds)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string"
    return _archives(spark, path).mapInArrow(run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Read the ARC archives twice, for the digests and for the payloads, and write their WARC equivalents."""
    repeated = stored(repeated_payloads(read_arc(spark, arc_path, payloads=False)), "repeated_payloads")
    _write(to_warc(read_arc(spark, arc_path), repeated), warc_path, "\r\n\r\n")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages into legacy archives, these into WARC archives, and those read back: one row per page."""
    spark = pages.sparkSession
    arcs, warcs = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arcs)
    convert(spark, arcs, warcs)
    return read_warc(spark, warcs)
