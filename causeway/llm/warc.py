"""Legacy archives to WARC: parse ARC header lines and declared lengths, write equivalent WARC records, read them back.

ARC version 1 has five fields in a record's header line, version 2 has ten; the ``filedesc:`` record at the head of an
archive states the version and becomes a ``warcinfo`` record. A record's body is as long as its line declares. Each ARC
record becomes a WARC/1.1 record: type ``response`` (HTTP messages and ``dns:`` answers; ``resource`` for other bodies), or
``revisit`` where an equal payload of at least ``least`` bytes has a smaller id; identifier, date, and SHA-256 digests
are derived from the record, so a second conversion gives the same bytes.

Archives are written by Spark's text writer, whose line separator is the blank line pair that ends a WARC record, so any
file system that Spark knows will do. They are read as whole files of bounded size and parsed by declared length.

Cases: a null payload is an empty one, a null address becomes ``about:blank``; repeated rows are repeated records; pages
without an id are responses, and are nobody's original; a header line that is none is an error, or with ``strict=False``
what follows is skipped up to the next line that is one; very long pages make an archive of their own; an
empty table gives no records; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.llm.common import lean_batches, shared_dir, slices, string_buffers

END = b"\r\n\r\n"
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Bytes of payload for each archive file; readers hold one file at a time.
ARCHIVE_BYTES = 16 << 20
RECORD_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes


def clean_url(url: str | None) -> str:
    """An address that fits into a header line: white space and control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def arc_head(version: int, name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    block = f"{version} 0 causeway\n{fields}\n".encode()
    tail = f"{len(block)}" if version == 1 else f"200 - - 0 {name} {len(block)}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}\n".encode() + block + b"\n"


def arc_record(version: int, url: str, body: bytes, date: str, mime: str, offset: int = 0, name: str = "pages.arc") -> bytes:
    tail = f"{len(body)}" if version == 1 else f"200 - - {offset} {name} {len(body)}"
    return f"{url} 0.0.0.0 {date} {mime} {tail}\n".encode() + body + b"\n"


HEADER = re.compile(rb"(?:filedesc|https?|dns|ftp|whois|about)[^ \n]*(?: [^ \n]*){3,8} \d+\r?\n")


def read_arc(data: bytes, strict: bool = True) -> Iterator[ArcRecord]:
    """The records of one archive, its ``filedesc:`` first, by the version's header lines and declared lengths."""
    at, fields = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at : max(stop, at)].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        opens = line[0].startswith("filedesc:")
        length = int(line[-1]) if stop >= 0 and line[-1].isdecimal() else -1
        body = data[stop + 1 : stop + 1 + max(length, 0)]
        version = body.split(b" ", 1)[0].strip() if opens else b""
        wrong = (
            "no header line" if length < 0
            else f"ARC version {version!r}" if opens and version not in (b"1", b"2")
            else f"a header line of {len(line)} fields, not {fields}" if not opens and len(line) != fields
            else "a record that ends early" if len(body) != length
            else ""
        )
        if wrong:
            if strict:
                raise ValueError(f"{wrong} at byte {at} of an ARC file")
            later = HEADER.search(data, at + 1)
            while later and data[later.start() - 1 : later.start()] != b"\n":
                later = HEADER.search(data, later.start() + 1)
            at = later.start() if later else len(data)
            continue
        if opens:
            fields = 5 if version == b"1" else 10
        yield ArcRecord(line[0], line[1], line[2], line[3], body)
        at = stop + 1 + length


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message; a body without a status line is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(END)
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def warc_record(key: int | None, arc: ArcRecord, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it."""
    head, payload = split_http(arc.body)
    when = datetime.strptime(arc.date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    digest = hashlib.sha256(payload).hexdigest()
    info, http = arc.url.startswith("filedesc:"), bool(head)
    if info:
        version = arc.body.split(b" ", 1)[0].decode()
        block = f"software: causeway\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {version}\r\n".encode()
        kind, content = "warcinfo", "application/warc-fields"
    else:
        block = head if refers_to is not None else arc.body
        kind = "revisit" if refers_to is not None else "response" if http or arc.url.startswith("dns:") else "resource"
        content = "application/http; msgtype=response" if http else "text/dns" if arc.url.startswith("dns:") else arc.content_type
    own = record_id(key, digest) if not info else record_id(None, hashlib.sha256(arc.url.encode() + arc.date.encode() + arc.body).hexdigest())
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if info:
        lines.append(f"WARC-Filename: {arc.url.removeprefix('filedesc://')}")
    else:
        lines += [f"WARC-Target-URI: {arc.url}", f"WARC-IP-Address: {arc.ip}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
        if key is not None:
            lines.append(f"X-Page-Id: {key}")
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def record_id(key: int | None, digest: str) -> str:
    """An identifier from a page's id and its payload's digest."""
    return f"<urn:uuid:{uuid.uuid5(RECORD_NAMESPACE, f'page:{key}:{digest}')}>"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode("utf-8").split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        if len(block) != length or data[stop + 4 + length : stop + 8 + length] != END:
            raise ValueError(f"the WARC record at byte {at} does not end where it declares")
        yield headers, block
        at = stop + 8 + length


def http_response(payload: bytes, mime: str = "text/html") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def digest():
    return F.unhex(F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256))


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, digest and refers_to of pages whose payload, of at least ``least`` bytes, has an equal of smaller id.

    Keys are payload digests, counted with map-side sums; only digests that occur twice are joined back, a digest's rows
    dealt over salted keys so that one payload of very many pages does not meet in one task.
    """
    salts = 16
    sized = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", digest().alias("digest")).distinct()
    first = sized.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return (
        sized.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
        .join(first, ["digest", "salt"])
        .where("page_id <> refers_to")
        .select("page_id", "digest", "refers_to")
    )


def convert(pages: DataFrame, path: str, version: int = 1, date: str = "20000101000000") -> None:
    """Writes each page as an ARC record of ``version``, converts the archives, and saves the WARC files at ``path``.

    ``pages``: page_id, url, html, refers_to.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(2))
            urls, keys, refers = (batch.column(i).to_pylist() for i in (1, 0, 3))
            data = raw.tobytes()
            for start, end in slices(offsets):
                archive, at = [arc_head(version)], 0
                for i in range(start, end):
                    body = http_response(data[offsets[i] : offsets[i + 1]])
                    archive.append(arc_record(version, clean_url(urls[i]), body, date, "text/html", at))
                    at += len(archive[-1])
                out = [
                    (warc_record(keys[i], arc, refers[i]) if i >= start else warc_record(None, arc)).decode("utf-8")
                    for i, arc in zip(range(start - 1, end), read_arc(b"".join(archive)), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows = pages.select("page_id", "url", "html", "refers_to").mapInArrow(records, "value string")
    rows.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files at ``path``."""
    import zlib

    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, warc_date string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in read_warc(zlib.decompress(data.as_py(), 31)):
                    if h["warc-type"] == "warcinfo":
                        continue
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    revisit = h["warc-type"] == "revisit"
                    payload = split_http(block)[1]
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {h['warc-record-id']} differs from its digest")
                    rows.append((
                        int(h["x-page-id"]) if "x-page-id" in h else None, int(h["x-payload-length"]) if revisit else len(payload), digest, h["warc-type"],
                        int(h["x-refers-to-page-id"]) if revisit else None, h["warc-target-uri"], h["warc-record-id"], h["warc-date"],
                    ))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "warc_date"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
        .select("content").mapInArrow(parse, fields)
    )


def archive(pages: DataFrame, version: int = 1, least: int = 100) -> DataFrame:
    """Converts all pages to WARC files in the shared folder, reads the files, and returns a row per record."""
    spark = pages.sparkSession
    lean_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    size = pages.agg(F.coalesce(F.sum(F.octet_length("html") + 200), F.lit(0))).first()[0]
    files = max(1, -(-int(size) // ARCHIVE_BYTES))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    dealt = pages.withColumn("digest", digest()).repartition(files, "page_id", "digest")
    dealt = dealt.join(revisits(pages, least), ["page_id", "digest"], "left")
    convert(dealt, path, version)
    return read_back(spark, path)
