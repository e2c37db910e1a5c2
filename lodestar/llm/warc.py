"""Legacy archive converter: ARC files of versions 1 and 2 to WARC 1.1, written and read as gzip members.

An ARC file opens with a version block whose second line names the version
and whose third line names the fields of the header lines that follow; each
header line declares the length of its content. The converter reads those by
the version's own field list and synthesises what WARC wants: record
identifiers (a UUID made from the record's own bytes and place), ISO
timestamps from 14-digit dates, the record type, and SHA-256 block and payload
digests.

The query lays its pages down as gzipped ARC files, converts those, and reads the
WARC files back. Files are written through Spark's own writer, one for each
segment of at most SEGMENT_BYTES of records, so that commits survive lost
executors, any store Spark can write will do, and no archive is too large to
read as a whole. (Spark has no binary writer: the text writer takes the bytes
as they are, and a segment ends with an empty gzip member whose last byte,
always 0, is the writer's line end.) Each record is a gzip member of its own;
a WARC segment opens with a warcinfo record. Ids are percent-encoded in
header fields, so no id can break a line.

Defined cases: null html is an empty payload, a null url is `-`; a null
page_id is carried as none; payloads under MIN_REVISIT bytes are never
revisits; of rows that share the smallest page_id of equal payloads, each is a
response; an empty table writes no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import new_path, store

MIN_REVISIT = 100
SEGMENT_BYTES = 8 << 20
GZIP_LEVEL = 1
#: The field lists of the two ARC versions and WARC's names for record types and profiles.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"
_EMPTY_MEMBER = gzip.compress(b"", 1, mtime=0)


class ArcError(ValueError):
    """An ARC file that doesn't follow its declared version or lengths."""


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes

    @property
    def url(self) -> str:
        return self.fields["URL"]


def _clean(url: str) -> str:
    """A URL fit for a field of a header line."""
    return "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in url.encode("utf-8", "replace")).encode("latin-1").decode("utf-8", "replace") or "-"


def arc_header(version: int, date: str, filename: str) -> bytes:
    """The version block at the head of an ARC file."""
    body = f"{version} 0 lodestar\n{ARC_FIELDS[version]}\n".encode()
    middle = "text/plain" if version == 1 else f"text/plain 200 - - 0 {filename}"
    return f"filedesc://{filename} 0.0.0.0 {date} {middle} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, *, ip: str = "0.0.0.0", mime: str = "text/html", status: int = 200, offset: int = 0, filename: str = "-") -> bytes:
    middle = mime if version == 1 else f"{mime} {status} {zlib.crc32(content):08x} - {offset} {filename}"
    return f"{_clean(url)} {ip} {date} {middle} {len(content)}\n".encode() + content + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block, by the field list that the block declares."""
    if not data.startswith(b"filedesc://"):
        raise ArcError("no version block")
    end = data.index(b"\n")
    first = data[:end].decode("utf-8").split(" ")
    if not first[-1].isdigit():
        raise ArcError("the version block declares no length")
    block = data[end + 1 : end + 1 + int(first[-1])]
    lines = block.split(b"\n")
    if len(lines) < 2 or not re.match(rb"[12] ", lines[0]):
        raise ArcError(f"unknown version line {lines[0][:40]!r}")
    names = lines[1].decode("ascii").split(" ")
    if " ".join(names) != ARC_FIELDS[int(lines[0][:1])]:
        raise ArcError(f"the fields don't belong to version {lines[0][:1].decode()}")
    at = end + 1 + int(first[-1])
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        values = data[at:end].decode("utf-8").rstrip("\r").split(" ")
        if end < 0 or len(values) != len(names) or not values[-1].isdigit():
            raise ArcError(f"bad header line at byte {at}")
        size = int(values[-1])
        if end + 1 + size > len(data):
            raise ArcError(f"the record at byte {at} declares more bytes than there are")
        yield ArcRecord(dict(zip(names, values, strict=True)), data[end + 1 : end + 1 + size])
        at = end + 1 + size


def warc_date(arc_date: str) -> str:
    """ISO time of a 14-digit date; shorter dates are read as far as they go."""
    digits = arc_date[:14]
    if not re.fullmatch(r"[0-9]{4,14}", digits):
        raise ArcError(f"bad date {arc_date!r}")
    full = digits + "00000101000000"[len(digits) :]
    return datetime.strptime(full, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload; no head if it isn't an HTTP response."""
    if content.startswith(b"HTTP/"):
        cut = content.find(b"\r\n\r\n")
        if cut >= 0:
            return content[: cut + 4], content[cut + 4 :]
    return b"", content


def record_id(*parts: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'|'.join(parts)).digest()[:16], version=4)}>"


def _page_of(head: bytes) -> str | None:
    found = re.search(rb"\r\nX-Page-Id: ([^\r]*)\r\n", head)
    return unquote(found[1].decode()) if found else None


def to_warc(record: ArcRecord, first_page: str | None = None) -> bytes:
    """The equivalent WARC record; with first_page, a revisit of that page's record that keeps the HTTP head only."""
    head, payload = _split_http(record.content)
    block = head if first_page is not None else record.content
    digest = hashlib.sha256(payload).hexdigest()
    page = _page_of(head)
    own = (page.encode(), digest.encode()) if page is not None else (record.url.encode(), record.fields["Archive-date"].encode(), record.content)
    fields = [
        ("WARC-Type", "revisit" if first_page is not None else "response" if head else "resource"),
        ("WARC-Record-ID", record_id(*own)),
        ("WARC-Date", warc_date(record.fields["Archive-date"])),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if first_page is not None:
        refers = record_id(first_page.encode(), digest.encode())
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers), ("X-Refers-To-Page-Id", quote(first_page))]
    fields += [("Content-Type", "application/http; msgtype=response" if head else record.fields["Content-type"]), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode() + block + 2 * _CRLF


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:cut].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        block = data[cut + 4 : cut + 4 + size]
        if data[cut + 4 + size : cut + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it declares")
        yield fields, block
        at = cut + 8 + size


def _members(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members; what is left after a member is never copied as a whole."""
    view, at = memoryview(data), 0
    while at < len(data):
        one, out = zlib.decompressobj(31), []
        while not one.eof and at < len(data):
            part = view[at : at + 16384]
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        if whole := b"".join(out):
            yield whole


def _http_head(page_id: object, size: int) -> bytes:
    page = "" if page_id is None else f"X-Page-Id: {quote(str(page_id))}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {size}\r\n\r\n".encode()


def _gzip(record: bytes) -> bytes:
    member = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return member.compress(record) + member.flush()


def warc_info(date: str) -> bytes:
    """The record that opens a WARC file."""
    block = b"software: lodestar\r\nformat: WARC File Format 1.1\r\n"
    text = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(b'warcinfo', date.encode())}\r\nWARC-Date: {warc_date(date)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return text.encode() + block + 2 * _CRLF


def _segments(record, opening: bytes):
    """Batches to segments: record makes the bytes of a row from its columns; each segment opens with `opening`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            whole = b"".join([_gzip(opening), *held, _EMPTY_MEMBER])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], names=["segment"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                held.append(_gzip(record(*row)))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield segment()
                    size = 0
        if held:
            yield segment()

    return run


def _write(segments: DataFrame, path: str) -> None:
    text = segments.select(F.col("segment").cast("string").alias("value"))
    text.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def write_arc_files(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", version: int = 1, date: str = "20240101000000") -> None:
    """One ARC record of that version for each row, in gzipped ARC files under path."""

    def record(page, link, body) -> bytes:
        payload = _bytes(body)
        return arc_record(version, link.as_py() or "-", date, _http_head(page.as_py(), len(payload)) + payload)

    rows = pages.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").cast("binary").alias("html"))
    _write(rows.mapInArrow(_segments(record, arc_header(version, date, "pages.arc")), "segment binary"), path)


_ARC_ROW = "page string, url string, ip string, archive_date string, mime string, content binary, payload_digest string, payload_bytes long, file string, place int"


def _arc_rows(with_content: bool):
    names = [x.split(" ")[0] for x in _ARC_ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int32()]
        for batch in batches:
            for archive, file in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = []
                for place, r in enumerate(_arc_records(archive)):
                    head, payload = _split_http(r.content)
                    content = r.content if with_content else None
                    found.append((_page_of(head), r.url, r.fields["IP-address"], r.fields["Archive-date"], r.fields["Content-type"], content, hashlib.sha256(payload).hexdigest(), len(payload), file, place))
                for i in range(0, len(found), 500):
                    part = found[i : i + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], kinds[k]) for k in range(len(names))], names=names)

    return run


def _arc_records(archive: pa.Scalar) -> Iterator[ArcRecord]:
    data = archive.as_buffer().to_pybytes()
    return read_arc(b"".join(_members(data)) if data[:2] == b"\x1f\x8b" else data)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content", "path")


def read_arc_files(spark, path: str, *, with_content: bool = True) -> DataFrame:
    """The records of all ARC files under path, of either version, gzipped or plain: page, url, ip, archive_date, mime, content, payload_digest, payload_bytes, and the file and place where it stands."""
    return _files(spark, path).mapInArrow(_arc_rows(with_content), _ARC_ROW)


def convert_arc_files(spark, arc_path: str, path: str, *, kind: str = "string", date: str = "20240101000000") -> None:
    """Write the records of all ARC files under arc_path as WARC files under path.

    Equal payloads of at least MIN_REVISIT bytes are found by digest; of each the
    record of the smallest page id (ordered as `kind`) is a response and the others
    revisit it. Only the small table of repeated digests meets the records again.
    """
    digests = store(read_arc_files(spark, arc_path, with_content=False).where(F.col("payload_bytes") >= MIN_REVISIT).select("page", "payload_digest", "file", "place"), "payloads").df
    repeated = digests.groupBy(F.col("payload_digest").alias("d")).agg(F.min(F.col("page").cast(kind)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = store(repeated, "repeated-payloads")
    first = digests.join(repeated.side(), F.col("payload_digest") == F.col("d")).where(~F.col("page").cast(kind).eqNullSafe(F.col("first")))
    revisits = first.groupBy(F.col("file").alias("f")).agg(F.collect_list(F.struct("place", F.col("first").cast("string").alias("first"))).alias("revisits"))
    revisits = store(revisits, "revisits")  # of a file at most as many as it has records
    files = _files(spark, arc_path).join(revisits.side(), F.col("path") == F.col("f"), "left").select("content", "revisits")
    _write(files.mapInArrow(_converted(date), "segment binary"), path)


def _converted(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, revisits in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                firsts = {x["place"]: x["first"] for x in revisits or ()}
                members = [_gzip(to_warc(record, firsts.get(place))) for place, record in enumerate(_arc_records(archive))]
                whole = b"".join([_gzip(warc_info(date)), *members, _EMPTY_MEMBER])
                yield pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], names=["segment"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers"]
    for batch in batches:
        for archive in batch.column(0):
            out: list[tuple] = []
            for member in _members(archive.as_buffer().to_pybytes()):
                for fields, block in read_warc(member):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = _split_http(block)
                    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
                    size = int(http["Content-Length"])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    refers = fields.get("X-Refers-To-Page-Id")
                    out.append((_page_of(head), size, digest, fields["WARC-Type"], unquote(refers) if refers else None))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64() if k == 1 else pa.string()) for k in range(5)], names=names)


def read_archives(spark, path: str, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    out = files.mapInArrow(_read, "page string, payload_bytes long, payload_digest string, record_type string, refers string")
    return out.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


def archive_round_trip(pages: DataFrame, *, version: int = 1, path: str | None = None) -> DataFrame:
    """Lay the pages down as ARC files (by default in the shared folder), convert those to WARC and read the archives back."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    path = path or new_path(spark, "archives")
    write_arc_files(pages, f"{path}/arc", version=version)
    convert_arc_files(spark, f"{path}/arc", f"{path}/warc", kind=kind)
    return read_archives(spark, f"{path}/warc", kind)
