"""Web archives: legacy ARC files converted to WARC.

ARC files begin with a version block and hold records behind one header line each, with five fields in version 1
and ten in version 2; the last field declares the content's length, by which records are cut. A converted record
gets a WARC identifier, date, type and digests. Of records with equal payloads the one with the least page number
is the response; the others are revisits, which keep their HTTP headers and point to it.

Files are written by Spark's text sink, whose line separator is the formats' own record terminator, and read whole
as binary files, so both work in any store that Spark reaches. They are compressed with gzip.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.common import settled

#: Names of the header line's fields, as the version block declares them (fixed formats).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Records, and about bytes, of one archive file at most; pages of the crawl get this date when they state none.
FILE_RECORDS, FILE_BYTES, CRAWLED = 500, 256 << 20, "20240102030405"
#: The page number's header among the record's HTTP headers, and the name space of record identifiers.
PAGE_HEADER, RECORD_SPACE = "X-Page-Id", uuid.UUID("6f0c1b1e-27cb-5a43-9f0e-1d1f6a4c2b70")
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _per_file(largest: int | None) -> int:
    return max(1, min(FILE_RECORDS, FILE_BYTES // max(1, largest or 1)))


def write_arc(pages: DataFrame, path: str, version: int) -> None:
    """Writes pages(page_id, url, html) as ARC files of the version; null html counts as empty, null url as urn:page:ID.

    A record's content is an HTTP response of which the payload is html in UTF-8. White space and control
    characters in a url are percent-encoded, since header fields are divided by spaces.
    """
    most = _per_file(pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0])
    block = f"{version} 0 spanwright\n{FIELDS[version]}\n"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, name = 0, "none.arc"
        for batch in batches:
            out = []
            for page, url, html in zip(*(batch.column(k) for k in ("page_id", "url", "html")), strict=True):
                page, url, body = page.as_py(), url.as_py(), (html.as_py() or "").encode()
                if count % most == 0:
                    name = f"pages-{page}.arc"
                    out.append(f"filedesc://{name} 0.0.0.0 {CRAWLED} text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(block)}\n{block}".encode())
                count += 1
                number = "" if page is None else f"{PAGE_HEADER}: {page}\r\n"
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(body)}\r\n\r\n".encode() + body
                where = quote(url if url else f"urn:page:{page}", safe="!#$%&'()*+,/:;=?@[]~")
                more = f"200 {sha1_base32(content)} - 0 {name} " if version == 2 else ""
                out.append(f"{where} 0.0.0.0 {CRAWLED} text/html {more}{len(content)}\n".encode() + content)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["line"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # the text sink starts a new file after so many records and their version block
    rows.mapInArrow(lines, "line binary").select(F.col("line").cast("string")).write.option("maxRecordsPerFile", most + 1).options(**_GZIP).text(path, lineSep="\n")


def arc_records(data: bytes, faults: list[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of an uncompressed ARC file's records, cut by their declared lengths.

    The version block, which may recur where files were joined, names the fields of what follows. A header line
    that lacks fields, or a length that goes beyond the file, raises ValueError; with a list for ``faults`` it is
    noted there instead and reading goes on with the next line that is a header.
    """
    names, at, lost = None, 0, False

    def fault(what: str) -> None:
        if faults is None:
            raise ValueError(what)
        if not lost:
            faults.append(what)

    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            fault(f"ARC header line at byte {at} has no end")
            return
        fields = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        opening = fields[0].startswith("filedesc://")
        if not (fields[-1].isascii() and fields[-1].isdigit()) or end + 1 + int(fields[-1]) > len(data):
            fault(f"ARC record at byte {at} declares no valid length")
            at, lost = end + 1, True
            continue
        if not opening and (names is None or len(fields) != len(names)):
            fault(f"ARC record at byte {at} does not fit its version block")
            at, lost = end + 1, True
            continue
        content = data[end + 1 : end + 1 + int(fields[-1])]
        at, lost = end + 1 + len(content), False
        if opening:
            version, _, declared = content.partition(b"\n")
            declared = declared.split(b"\n")[0].decode("utf-8", "replace").strip()
            number = version.split()[:1]
            names = (declared or FIELDS.get(int(number[0]) if number and number[0].isdigit() else 1, FIELDS[1])).split(" ")
        else:
            yield dict(zip(names, fields, strict=True)), content


def inflated(data: bytes) -> bytes:
    """The bytes of all members of a gzip file."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


_PARSED = "file string, place long, page_id long, url string, date string, mime string, http string, payload binary, digest string, fault string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]
    names = [f.split()[0] for f in _PARSED.split(", ")]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            out, size, faults = [], 0, []
            for k, (fields, record) in enumerate(arc_records(inflated(content.as_py()), faults)):
                head, cut, body = record.partition(b"\r\n\r\n") if record.startswith(b"HTTP/") else (b"", b"", record)
                http = (head + cut).decode("latin-1")
                out.append((path, k, _page(http), fields.get("URL", "urn:unknown"), fields.get("Archive-date", ""), fields.get("Content-type", "application/octet-stream"), http, body, sha1_base32(body), None))
                size += len(body)
                if size > 4 << 20:
                    yield told(out)
                    out, size = [], 0
            out += [(path, None, None, None, None, None, None, None, None, fault) for fault in faults]
            if out:
                yield told(out)


def _page(http: str) -> int | None:
    for line in http.split("\r\n"):
        name, _, value = line.partition(":")
        if name == PAGE_HEADER and value.strip().lstrip("-").isdigit():
            return int(value)
    return None


def _arc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(_parse, _PARSED)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files in a folder: file, place, page_id, url, date, mime, http, payload, digest; malformed ones are left out, see arc_faults."""
    return _arc(spark, path).filter("fault is null").drop("fault")


def arc_faults(spark: SparkSession, path: str) -> DataFrame:
    """file, fault: what read_arc leaves out of the files in a folder."""
    return _arc(spark, path).filter("fault is not null").select("file", "fault")


def _stamp(date: str) -> str:
    """An ARC date of 4 to 14 digits, which may lack its last fields, as a WARC date; anything else is the epoch."""
    digits = date if date.isascii() and date.isdigit() and 4 <= len(date) <= 14 and len(date) % 2 == 0 else "1970"
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc_lines(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = record_id(r["page_id"], r["url"], r["digest"], r["file"], r["place"])
                if count % most == 0:
                    block = b"software: spanwright\r\nformat: WARC File Format 1.1\r\n"
                    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(own, 'warcinfo')}>", f"WARC-Date: {_stamp(CRAWLED)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
                    out.append("\r\n".join(head).encode() + b"\r\n\r\n" + block)
                count += 1
                http = r["http"].encode("latin-1")
                body = b"" if r["revisit"] else r["payload"]
                head = [
                    "WARC/1.1",
                    f"WARC-Type: {'revisit' if r['revisit'] else 'response'}",
                    f"WARC-Record-ID: <urn:uuid:{own}>",
                    f"WARC-Date: {_stamp(r['date'])}",
                    f"WARC-Target-URI: {r['url']}",
                    f"WARC-Payload-Digest: sha1:{r['digest']}",
                ]
                if r["revisit"]:
                    first = r["first"]
                    head += [
                        f"WARC-Refers-To: <urn:uuid:{record_id(first['page_id'], first['url'], r['digest'], first['file'], first['place'])}>",
                        f"WARC-Refers-To-Target-URI: {first['url']}",
                        f"WARC-Refers-To-Date: {_stamp(first['date'])}",
                        f"WARC-Refers-To-Page: {first['page_id']}",
                        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    ]
                head += [
                    f"WARC-Block-Digest: sha1:{sha1_base32(http + body)}",
                    f"Content-Type: {'application/http; msgtype=response' if http else r['mime']}",
                    f"Content-Length: {len(http) + len(body)}",
                ]
                out.append("\r\n".join(head).encode() + b"\r\n\r\n" + http + body)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["line"])

    return run


def record_id(page: int | None, url: str, digest: str, file: str, place: int) -> uuid.UUID:
    """An identifier for the record at a place of a file, so that repeated pages have different ones."""
    return uuid.uuid5(RECORD_SPACE, f"{page} {url} {digest} {file.rpartition('/')[2]} {place}")


def write_warc(records: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes records (as from read_arc) as WARC files; payloads under ``least_bytes`` are all responses.

    Of equal payloads, by SHA-1 and length, the record with the least (page_id, url) is the response, rows
    repeated with it included. Records without page_id are responses and never referred to.
    """
    size = F.length("payload")
    entry = F.struct("page_id", "url", "file", "place", "date")
    first = settled(records.groupBy("digest", size.alias("size")).agg(F.min(F.when(F.col("page_id").isNotNull(), entry)).alias("first"), F.count("*").alias("n")))
    most = _per_file(first.agg(F.max("size")).first()[0])
    # dealt out anew, so that Spark can split a digest that many records share
    revisits = first.filter((F.col("n") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull()).select("digest", "size", "first").repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = records.withColumn("size", size).join(revisits, ["digest", "size"], "left")
    told = told.withColumn("revisit", F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first.page_id")))
    told.drop("size").mapInArrow(_warc_lines(most), "line binary").select(F.col("line").cast("string")).write.option("maxRecordsPerFile", most + 1).options(**_GZIP).text(path, lineSep="\r\n\r\n")


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of an uncompressed WARC file's records, cut by Content-Length."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        begin, n = end + 4, int(head["Content-Length"])
        if data[begin + n : begin + n + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} does not end where it declares")
        yield head, data[begin : begin + n]
        at = begin + n + 4


_READ = "page_id long, url string, record_id string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = [f.split()[0] for f in _READ.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for head, block in warc_records(inflated(content.as_py())):
                if head["WARC-Type"] == "warcinfo":
                    continue
                http, cut, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                lines = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:] if ": " in line)
                full = head["WARC-Type"] == "response"
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                intact = head["WARC-Block-Digest"] == f"sha1:{sha1_base32(block)}" and (not full or digest == sha1_base32(body))
                size = len(body) if full else int(lines["Content-Length"])
                refers = head.get("WARC-Refers-To-Page")
                out.append((_page((http + cut).decode("latin-1")), head["WARC-Target-URI"], head["WARC-Record-ID"], head["WARC-Date"], head["WARC-Type"], size, digest, None if refers is None else int(refers), intact))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files in a folder; payload_bytes and payload_digest are of the full payload, a revisit's included."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_read, _READ)
