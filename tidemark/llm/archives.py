"""Web archives: pages into ARC files, ARC files into WARC files, WARC files into records.

The converter reads archives of both versions of the older format by their declared
lengths. The version block at the head of an archive names the fields of its header lines,
so that a line is cut by the names its archive declares. Each record becomes a WARC record
with an identifier, a timestamp and digests that follow from the old one alone. Of records
with the same payload one is a response and the others are revisits that refer to it; they
are found by digest over all archives before any is written.

An archive is one row while Spark handles it, as a record has no mark by which it could be
found from the middle of a file. Archives are cut at ARCHIVE_BYTES, so rows are bounded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

#: An archive is closed once it has so many bytes; a longer record has one to itself.
ARCHIVE_BYTES = 1 << 24
#: Payloads with fewer bytes are never revisits.
LEAST_REVISITED = 100
#: The timestamp of pages that come without one.
DATE = "20000101000000"
ITEM = "X-Item-ID"

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

BLANK = re.compile(rb"[\x00-\x20\x7f]")


class Entry(NamedTuple):
    """A record of an ARC file."""

    offset: int
    url: str | None
    ip: str
    date: str
    mime: str
    block: bytes


def _field(value: bytes | None) -> bytes:
    """A value as one word of a header line; blanks are percent-encoded, nothing is a dash."""
    return BLANK.sub(lambda m: b"%%%02X" % m[0][0], value or b"") or b"-"


def _line(version: int, url: bytes, mime: str, offset: int, length: int, date: str) -> bytes:
    values = {
        "URL": url,
        "IP-address": b"0.0.0.0",
        "Archive-date": date.encode(),
        "Content-type": mime.encode(),
        "Result-code": b"200",
        "Offset": b"%d" % offset,
        "Archive-length": b"%d" % length,
    }
    return b" ".join(values.get(name, b"-") for name in ARC_FIELDS[version].split()) + b"\n"


def arc_opening(version: int, date: str = DATE) -> bytes:
    """The version block of an archive: its own header line, then version and names of fields."""
    body = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n".encode()
    return _line(version, b"filedesc://tidemark.arc", "text/plain", 0, len(body), date) + body


def arc_entry(version: int, offset: int, item_id: int | None, url: bytes | None, body: bytes, date: str = DATE) -> bytes:
    """A record with the response of a server, behind the line break that ends the one before."""
    named = b"" if item_id is None else b"%s: %d\r\n" % (ITEM.encode(), item_id)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(body), named)
    line = _line(version, _field(url), "text/html", offset, len(head) + len(body), date)
    return b"".join((b"\n", line, head, body))


def unpacked(content: bytes) -> bytes:
    """An archive without compression, one gzip member or several."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        inflate = zlib.decompressobj(31)
        parts.append(inflate.decompress(content) + inflate.flush())
        if not inflate.eof:
            raise ValueError("an archive is cut off")
        content = inflate.unused_data
    return b"".join([*parts, content])


def arc_entries(archive: bytes) -> Iterator[Entry]:
    """The records of an ARC file of either version, without the version block."""
    names: list[str] | None = None
    at = 0
    while at < len(archive):
        if archive[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = archive.find(b"\n", at)
        line = archive[at : stop if stop >= 0 else len(archive)].rstrip(b"\r")
        fields = line.rsplit(b" ", len(names) - 1) if names else line.split(b" ")
        length = fields[-1]
        if stop < 0 or not length.isdigit() or (names and len(fields) != len(names)):
            raise ValueError(f"no header line of an ARC record at byte {at}")
        begin, end = stop + 1, stop + 1 + int(length)
        if end > len(archive):
            raise ValueError(f"the record at byte {at} has fewer bytes than it declares")
        block = archive[begin:end]
        if names is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError("an ARC file has to begin with its version block")
            version, declared, *_ = block.decode().split("\n")
            if int(version.split()[0]) not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            names = declared.split()
        else:
            value = dict(zip(names, (f.decode("utf-8", "replace") for f in fields)))
            url = value["URL"]
            yield Entry(
                at, None if url == "-" else url, value["IP-address"], value["Archive-date"], value["Content-type"], block
            )
        at = end


def warc_date(date: str) -> str:
    """A timestamp of up to 14 digits as WARC writes it; what is missing is the earliest."""
    if not re.fullmatch(r"\d{4,14}", date):
        raise ValueError(f"no timestamp: {date!r}")
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


def record_id(archive: str, offset: int) -> str:
    """The identifier of a record by its place, the same on every run over the same files."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def payload_of(block: bytes) -> tuple[bytes, bytes | None]:
    """(payload, head) of a server's response; a block that is none is all payload, its head null."""
    if block.startswith(b"HTTP/"):
        head, found, body = block.partition(b"\r\n\r\n")
        if found:
            return body, head
    return block, None


def item_of(head: bytes | None) -> int | None:
    for line in (head or b"").split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == ITEM.lower().encode():
            return int(value)
    return None


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [WARC_VERSION, *(f"{name}: {value}" for name, value in fields if value is not None)]
    lines.append(f"Content-Length: {len(block)}")
    return b"".join(("\r\n".join(lines).encode(), b"\r\n\r\n", block, b"\r\n\r\n"))


class First(NamedTuple):
    """The response that a revisit refers to."""

    item_id: int | None
    archive: str
    offset: int
    url: str | None
    date: str


def converted(entry: Entry, archive: str, first: First | None) -> bytes:
    """The WARC record of an ARC record: a revisit of `first`, or its own response."""
    payload, head = payload_of(entry.block)
    kind, block = ("response" if head is not None else "resource"), entry.block
    fields: list[tuple[str, object]] = [
        ("WARC-Record-ID", record_id(archive, entry.offset)),
        ("WARC-Date", warc_date(entry.date)),
        ("WARC-Target-URI", entry.url),
        ("WARC-IP-Address", None if entry.ip in ("-", "0.0.0.0") else entry.ip),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        (ITEM, item_of(head)),
        ("X-Payload-Length", len(payload)),
    ]
    if first is not None:
        kind, block = "revisit", (head or b"") + b"\r\n\r\n"
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(first.archive, first.offset)),
            ("WARC-Refers-To-Target-URI", first.url),
            ("WARC-Refers-To-Date", warc_date(first.date)),
            ("X-Refers-To-Item-ID", first.item_id),
        ]
    fields.append(("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()))
    fields.append(("Content-Type", HTTP if head is not None else entry.mime))
    return warc_record([("WARC-Type", kind), *fields], block)


def warc_opening(archive: str) -> bytes:
    block = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nisPartOf: {archive}\r\n".encode()
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(archive, 0)), ("WARC-Date", warc_date(DATE))]
    return warc_record([*fields, ("Content-Type", "application/warc-fields")], block)


def warc_records(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields by lower-cased name, block) of each record of a WARC file."""
    at = 0
    while at < len(archive):
        if archive[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = archive.find(b"\r\n\r\n", at)
        if stop < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = archive[at:stop].decode().split("\r\n")[1:]
        fields = {name.strip().lower(): value.strip(" \t") for name, _, value in (x.partition(":") for x in lines)}
        begin = stop + 4
        end = begin + int(fields["content-length"])
        if end > len(archive):
            raise ValueError(f"the record at byte {at} has fewer bytes than it declares")
        yield at, fields, archive[begin:end]
        at = end


def _write(archives: DataFrame, path: str) -> str:
    """Each row's bytes in `value` as a compressed file of its own."""
    # The text sink writes the bytes of a string as they are, and a line break behind.
    text = archives.select(F.col("value").cast("string"))
    text.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, archive, content) of each file, `archive` being the file's name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def write_arc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    date: str = DATE,
) -> str:
    """Write a record for each row of `pages` into ARC files in the folder `path`, and return it.

    Tasks fill archives in turn with the formats' two versions, and close one at
    ARCHIVE_BYTES; nothing is shuffled. The payload is the body in UTF-8, empty where null.
    The id goes into a header of the response, and is left out where null; a null or empty
    url is a dash, blanks in a url are percent-encoded. Repeated rows are separate records.
    Other columns are not read. An empty table gives no archive with records.
    """

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size = 1, [], 0
        for batch in batches:
            bodies, urls = batch.column(2).cast(pa.binary()), batch.column(1).cast(pa.binary())
            for item, url, body in zip(batch.column(0).to_pylist(), urls, bodies):
                if not parts:
                    parts = [arc_opening(version, date)]
                    size = len(parts[0])
                parts.append(arc_entry(version, size + 1, item, url.as_py(), body.as_py() or b"", date))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])
                    version, parts = 3 - version, []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])

    narrow = pages.select(
        F.col(id_col).cast("long").alias("item_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(body_col).cast("string").alias("body"),
    )
    return _write(narrow.mapInArrow(fill, "value binary"), path)


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, item_id, url, date, payload_bytes, payload_digest) of each record of the ARC files in `path`."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["archive", "offset", "item_id", "url", "date", "payload_bytes", "payload_digest"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for e in arc_entries(unpacked(content.as_py())):
                    payload, head = payload_of(e.block)
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((archive, e.offset, item_of(head), e.url, e.date, len(payload), digest))
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "archive string, offset long, item_id long, url string, date string, payload_bytes long, payload_digest string"
    return _archives(spark, path).select("archive", "content").mapInArrow(read, schema)


def revisits(index: DataFrame) -> DataFrame:
    """(archive, offset, first) of each record whose payload another one has: the one with the least id.

    Null ids come last; equal ids are in order of archive and offset.
    """
    place = F.struct(
        F.col("item_id").isNull().alias("no_id"),
        "item_id",
        "archive",
        "offset",
        "url",
        "date",
    )
    long = index.where(F.col("payload_bytes") >= LEAST_REVISITED)
    firsts = long.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts = stage(firsts.where("n > 1").drop("n"), "firsts")
    met = long.join(firsts, "payload_digest")
    other = (F.col("archive") != F.col("first.archive")) | (F.col("offset") != F.col("first.offset"))
    return met.where(other).select("archive", "offset", "first")


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str) -> str:
    """Write the records of all ARC files in `arc_path` as WARC files into `warc_path`, and return it.

    One archive becomes one archive, with the same records in the same order. A record
    whose payload of at least LEAST_REVISITED bytes another one has too is a revisit of
    the one with the least id, as `revisits` has it; its block keeps the response's header
    only. Records that are not a server's response become resources. An archive that is
    cut off or does not follow its declared lengths is an error.
    """
    index = stage(arc_index(spark, arc_path), "index")
    again = revisits(index).groupBy("archive").agg(
        F.collect_list(
            F.struct(
                "offset", "first.item_id", F.col("first.archive").alias("first_archive"),
                F.col("first.offset").alias("first_offset"), "first.url", "first.date",
            )
        ).alias("again")
    )
    again = stage(again, "again")
    met = _archives(spark, arc_path).join(again, "archive", "left").select("archive", "content", "again")

    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                firsts = {}
                for r in again.as_py() or ():
                    firsts[r["offset"]] = First(r["item_id"], r["first_archive"], r["first_offset"], r["url"], r["date"])
                entries = arc_entries(unpacked(content.as_py()))
                parts = [warc_opening(archive), *(converted(e, archive, firsts.get(e.offset)) for e in entries)]
                # The sink writes the last line break.
                whole = pa.array([b"".join(parts).removesuffix(b"\n")], pa.binary())
                yield pa.RecordBatch.from_arrays([whole], ["value"])

    return _write(met.mapInArrow(convert, "value binary"), warc_path)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(archive, offset, record_type, record_id, url, date, item_id, payload_bytes, payload_digest, refers_to_id,
    refers_to, payload) of each record of the WARC files in `path`, less the archives' own descriptions.

    `refers_to` is the item of the response that a revisit refers to. Size and digest of a
    response are those of the payload that was read; one that does not have its declared
    digest is an error. `payload` is null for revisits, and for all records unless
    `payloads` asks for it.
    """
    names = [
        "archive", "offset", "record_type", "record_id", "url", "date", "item_id", "payload_bytes", "payload_digest",
        "refers_to_id", "refers_to", "payload",
    ]
    kinds = [pa.string(), pa.int64()] + [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64(), pa.binary()]
    whole = lambda value: None if value is None else int(value)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, f, block in warc_records(unpacked(content.as_py())):
                    kind, digest = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha256:")
                    if kind == "warcinfo":
                        continue
                    payload = None
                    if kind != "revisit":
                        payload, _ = payload_of(block) if kind == "response" else (block, None)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"the payload at byte {offset} of {archive} does not have its digest")
                    size = whole(f.get("x-payload-length")) if payload is None else len(payload)
                    rows.append(
                        (
                            archive, offset, kind, f["warc-record-id"], f.get("warc-target-uri"), f["warc-date"],
                            whole(f.get(ITEM.lower())), size, digest, f.get("warc-refers-to"),
                            whole(f.get("x-refers-to-item-id")), payload if payloads else None,
                        )
                    )
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = (
        "archive string, offset long, record_type string, record_id string, url string, date string, item_id long, "
        "payload_bytes long, payload_digest string, refers_to_id string, refers_to long, payload binary"
    )
    return _archives(spark, path).select("archive", "content").mapInArrow(read, schema)
