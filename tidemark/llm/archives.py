"""Legacy archives (ARC) turned into WARC records, written through Spark and read back.

An ARC file opens with a version block whose second line names the version and whose third names the fields of every
record line: five of them in version 1, ten in version 2. Each record is such a line and as many bytes as it declares.
The converter gives each record the identifier, timestamp, type and digests that a WARC capture of it would have.
Payloads are bytes all the way; nothing of them need be UTF-8.

WARC files have one gzip member a record. A task puts members together up to a size, and Spark's text writer, which
writes the bytes of a value as they are, makes a file of each, so files lie wherever Spark can write. Its line separator
is the zero byte that closes the last member. Reading follows members and declared lengths only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, join_by_key, scratch, ship

#: The field lines of both versions.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
#: Compressed bytes that a WARC file aims at; a larger record is alone in its file.
FILE_BYTES = 16 << 20
#: Compressed bytes that a member's decompressor is given first.
MEMBER_BYTES = 4 << 10
#: Pages that make an ARC file on their way, and the capture time they get unless another is given.
ARC_PAGES, CAPTURED = 200, "20240101000000"
PAGE, REFERS, LENGTH = "X-Page-Id", "X-Refers-To-Page-Id", "Content-Length"
#: A gzip member of nothing. Members of 16 MiB or more don't end in a zero byte; this one follows them.
_NOTHING = gzip.compress(b"", mtime=0)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: Iterator[ArcRecord], version: int, *, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    body = b"%d 0 tidemark\n%s\n" % (version, FIELDS[version])
    middle = b"" if version == 1 else b" 200 - - 0 " + name.encode()
    out = [b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n%s\n" % (name.encode(), date.encode(), middle, len(body), body)]
    offset = len(out[0])
    for r in records:
        middle = b"" if version == 1 else b" 200 %s - %d %s" % (sha1(r.content).encode(), offset, name.encode())
        out.append(b"%s %s %s %s%s %d\n%s\n" % (r.url.encode(), r.ip.encode(), r.date.encode(), r.mime.encode(), middle, len(r.content), r.content))
        offset += len(out[-1])
    return b"".join(out)


def _plain(data: bytes) -> bytes:
    """The bytes of an archive, whatever gzip members it is made of."""
    return b"".join(members(data)) if data[:2] == b"\x1f\x8b" else data


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds. A decompressor copies what it is given beyond a member's end, so it is given a little,
    and twice as much each time that the member goes on."""
    rest = memoryview(data)
    while len(rest):
        d, plain, size = zlib.decompressobj(31), [], MEMBER_BYTES
        while len(rest) and not d.eof:
            given = rest[:size]
            plain.append(d.decompress(given))
            rest, size = rest[len(given) - len(d.unused_data) :], 2 * size
        if not d.eof:
            raise ValueError("a gzip member that is cut short")
        yield b"".join(plain)


def _text(field: bytes) -> str:
    try:
        return field.decode()
    except UnicodeDecodeError:
        return field.decode("latin-1")


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block, by the fields that the block names; gzip members are undone first."""
    data, at, names = _plain(data), 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        values = data[at:end].rstrip(b"\r").split(b" ")
        length = int(values[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError("an ARC record is shorter than it declares")
        at = end + 1 + length
        while at < len(data) and data[at : at + 1] in b"\r\n":
            at += 1
        if names is None:
            lines = content.split(b"\n")
            names = lines[1].strip().split(b" ")
            if int(lines[0].split(b" ")[0]) not in FIELDS or len(values) != len(names):
                raise ValueError("an ARC version block that names other fields than it has")
            continue
        if len(values) != len(names):
            raise ValueError("an ARC record line with other fields than its version has")
        f = {k.decode(): _text(v) for k, v in zip(names, values, strict=True)}
        yield ArcRecord(f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], content)


def _printable(url: str | None) -> str:
    """A URL as one word: white space and control characters are percent-encoded, a missing one is ``unknown:``."""
    return "".join(c if "!" <= c <= "~" or (c > "\xa0" and not c.isspace()) else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "unknown:"


def timestamp(date: str) -> str:
    """ARC's fourteen digits (twelve in old files) as a WARC date."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page: int | None) -> str:
    made = uuid.UUID(bytes=hashlib.sha1(f"{url} {date} {'' if page is None else page}".encode()).digest()[:16], version=5)
    return f"<urn:uuid:{made}>"


_PARTS = pa.schema([("url", pa.string()), ("date", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("sha1", pa.string()), ("bytes", pa.int64()), ("page", pa.int64())])
PARTS = "url string, date string, head binary, payload binary, sha1 string, bytes long, page long"


def _parts(r: ArcRecord) -> dict:
    head, found, payload = r.content.partition(END) if r.content.startswith(b"HTTP/") else (b"", b"", r.content)
    page = next((x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.startswith(PAGE.encode())), b"")
    return {"url": r.url, "date": r.date, "head": head + found, "payload": payload, "sha1": hashlib.sha1(payload).hexdigest(), "bytes": len(payload), "page": int(page) if page else None}


def convert(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = CAPTURED) -> DataFrame:
    """The parts of a WARC record for each page, by way of ARC files of both versions in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ARC_PAGES):
                captured = []
                for i, u, html in zip(*(c.to_pylist() for c in batch.slice(at, ARC_PAGES).columns), strict=True):
                    body = (html or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{LENGTH}: {len(body)}\r\n{PAGE}: {'' if i is None else i}\r\n\r\n"
                    captured.append(ArcRecord(_printable(u), "0.0.0.0", date, "text/html", head.encode() + body))
                yield pa.RecordBatch.from_pylist([_parts(r) for r in read_arc(write_arc(iter(captured), 1 + at // ARC_PAGES % 2))], schema=_PARTS)

    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, PARTS)


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """The parts of a WARC record for each record of the ARC files of a path, plain or gzip. A file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for r in read_arc(content.as_py()):
                    yield pa.RecordBatch.from_pylist([_parts(r)], schema=_PARTS)

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PARTS)


def first_of_payloads(rows: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """``sha1``, ``bytes``, ``first`` (page, url, date), ``n`` of payloads that several rows (sha1, bytes, page, url, date)
    have. No payload is read."""
    known = rows.where((F.col("bytes") >= min_bytes) & F.col("page").isNotNull())
    return known.groupBy("sha1", "bytes").agg(F.min(F.struct("page", "url", "date")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


def with_revisits(parts: DataFrame, shared: DataFrame) -> DataFrame:
    """Adds ``first`` to parts of records: the page with the same payload and the least id, where that is another page.

    ``shared`` is what ``first_of_payloads`` gives, written; where it is small Spark broadcasts it, and no payload moves.
    """
    joined = join_by_key(parts, shared, ["sha1", "bytes"], "page", how="left")
    return joined.withColumn("first", F.when(F.col("page").isNotNull() & (F.col("first.page") != F.col("page")), F.col("first")))


def _record(r: dict) -> bytes:
    first = r["first"]
    block = r["head"] if first else r["head"] + r["payload"]
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", record_id(r["url"], r["date"], r["page"])),
        ("WARC-Date", timestamp(r["date"])),
        ("WARC-Target-URI", r["url"]),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(r['sha1'])).decode()}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Type", "application/http;msgtype=response" if r["head"] else "application/octet-stream"),
    ]
    if first:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(_printable(first["url"]), first["date"], first["page"])), (REFERS, str(first["page"]))]
    fields += [("X-Payload-Length", str(r["bytes"])), (LENGTH, str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def _member(record: bytes) -> bytes:
    out = gzip.compress(record, 4, mtime=0)
    return out if out[-1] == 0 else out + _NOTHING


def _gathered(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                held.append(_member(_record(batch.slice(at, 1).to_pylist()[0])))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["file"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["file"])

    return run


def write_warc(parts: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    ship(parts.sparkSession)
    files = parts.select("url", "date", "head", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "sha1", "bytes", "page", "first")
    values = files.mapInArrow(_gathered(file_bytes), "file binary").select(F.col("file").cast("string").alias("value"))
    values.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, compressed or not; one gzip member is held at a time."""
    for plain in members(data) if data[:2] == b"\x1f\x8b" else (data,):
        at = 0
        while at < len(plain):
            end = plain.index(END, at)
            lines = plain[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            start, length = end + 4, int(fields[LENGTH])
            yield fields, plain[start : start + length]
            at = start + length
            if plain[at : at + 4] != END:
                raise ValueError("a WARC record of another length than it declares")
            at += 4


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in read_records(content.as_py()):
                head, payload = (block.split(END, 1) + [b""])[:2] if block.startswith(b"HTTP/") else (b"", block)
                digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                if not revisit and sha1(payload) != digest or f"sha1:{sha1(block)}" != fields["WARC-Block-Digest"]:
                    raise ValueError("a payload or block that doesn't match its digest")
                page = next((x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.startswith(PAGE.encode())), b"")
                size = int(fields["X-Payload-Length"]) if revisit else len(payload)
                rows.append({"page": int(page) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(fields[REFERS]) if revisit else None, "uri": fields["WARC-Target-URI"]})
            yield pa.RecordBatch.from_pylist(rows, schema=_LISTED)


_LISTED = pa.schema([("page", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string())])


def read_warc(spark: SparkSession, path: str, *, id_col: str = "page_id") -> DataFrame:
    """A row for each record of the WARC files: page, length and digest of the full payload, type, page referred to, URI."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_list, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string").withColumnRenamed("page", id_col)


def archive(pages: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = CAPTURED) -> DataFrame:
    """Converts pages by way of ARC, writes WARC files to the shared folder and reads them back.

    - Null and empty html is an empty payload; all such pages share it. A null or empty URL is ``unknown:``.
    - A row with a null page id is a response, and no other record refers to it. Rows that repeat an id are all
      responses if the id is the least with their payload.
    - Payloads below ``min_bytes`` are responses. Other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path, work = scratch(spark, "warc"), Workspace(spark, "archive")
    html = F.coalesce(F.col(html_col), F.lit(""))
    named = pages.select(F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"), F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.lit(date).alias("date"))
    shared = work.save(first_of_payloads(named, min_bytes=min_bytes), "shared")
    write_warc(with_revisits(convert(pages, id_col=id_col, url_col=url_col, html_col=html_col, date=date), shared), path)
    return read_warc(spark, path, id_col=id_col)


#: The listing for DuckDB, whose SHA-1 gives hexadecimal digits: five hex digits make four digits in base 32.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS least FROM p),
b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1), '' ORDER BY i) AS payload_digest
      FROM x, (SELECT unnest(range(0, 32)) AS i) GROUP BY page_id)
SELECT x.page_id, x.payload_bytes, b.payload_digest, CASE WHEN x.page_id = x.least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN x.page_id <> x.least THEN x.least END AS refers_to, CASE WHEN coalesce(pages.url, '') = '' THEN 'unknown:' ELSE pages.url END AS uri
FROM x JOIN b USING (page_id) JOIN pages USING (page_id)
"""
