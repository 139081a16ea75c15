"""Converting legacy ARC archives to WARC."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.textkit import blocks
from lexmill.plans.checkpoint import Workspace
from lexmill.plans.skew import hot_join

#: Header fields of an ARC record by version of its file, in the order of the format. Fixed values.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
END = "\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_file(version: int, name: str, date: str, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC file: its version block, then ``(url, type, content)`` records."""
    names = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}
    head = f"{version} 0 lexmill\n{' '.join(names[k] for k in FIELDS[version])}\n".encode()
    out = bytearray()

    def add(url: str, kind: str, content: bytes) -> None:
        value = {"url": re.sub(r"\s", "%20", url) or "-", "ip": "0.0.0.0", "date": date, "type": kind, "status": "200", "checksum": hashlib.md5(content).hexdigest(), "location": "-", "offset": str(len(out)), "filename": name, "length": str(len(content))}
        out.extend((" ".join(value[k] for k in FIELDS[version]) + "\n").encode() + content + b"\n")

    add(f"filedesc://{name}", "text/plain", head)
    for record in records:
        add(*record)
    return bytes(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields, content)`` of every record; the version block says how header lines are read.

    Contents are cut by their declared lengths, so they may hold anything. A line that doesn't have its version's
    number of fields, or a length beyond the file, is an error.
    """
    first = data[: data.index(b"\n")].decode("utf-8")
    size = int(first.rsplit(" ", 1)[1])
    block = data[len(first.encode()) + 1 :][:size]
    version = int(block.split(b" ", 1)[0])
    at = 0
    while at < len(data):
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8").split(" ")
        names = FIELDS[1] if not at and len(values) == 5 else FIELDS[version]
        if len(values) != len(names):
            raise ValueError(f"{len(values)} header fields at byte {at}, {len(names)} in version {version}")
        header = dict(zip(names, values, strict=True))
        stop = end + 1 + int(header["length"])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} ends after the file")
        yield header, data[end + 1 : stop]
        at = stop + 1 if data[stop : stop + 1] == b"\n" else stop


def record_id(*parts: object) -> str:
    """The same name for the same record at each conversion."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """HTTP header with its blank line, and payload; None where the content isn't an HTTP message."""
    if not content.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", content)
    return (content[: m.end()], content[m.end() :]) if m else (content, b"")


def to_warc(header: dict[str, str], content: bytes, ident: object = None, refers_to: object = None) -> bytes:
    """The WARC record of an ARC record, without the end mark.

    ``filedesc:`` becomes warcinfo, HTTP messages responses, others resources. ``refers_to`` makes a revisit,
    which keeps the HTTP header only. The date is the ARC's 14 digits; digests are base-32 SHA-1.
    """
    d = f"{header['date']:0<14}"
    http = split_http(content)
    payload = http[1] if http else content
    digest = digest32(payload)
    kind = "warcinfo" if header["url"].startswith("filedesc://") else "revisit" if refers_to is not None else "response" if http else "resource"
    block = http[0] if kind == "revisit" and http else content
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(header['url'] if ident is None else ident, digest)}", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"]
    if kind == "warcinfo":
        lines += [f"WARC-Filename: {header['url'].removeprefix('filedesc://')}", "Content-Type: application/warc-fields"]
        block = "software: lexmill\r\nformat: WARC File Format 1.0\r\ndescription: from ARC\r\n".encode()
    else:
        lines += [f"WARC-Target-URI: {header['url']}", f"WARC-IP-Address: {header['ip']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
        lines += [f"Content-Type: {'application/http; msgtype=response' if http else header['type']}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    if ident is not None:
        lines += [f"X-Page-ID: {ident}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END.encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields in lower case, block)`` of every record."""
    at = 0
    while at < len(data):
        end = data.index(END.encode(), at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        header = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        stop = end + 4 + int(header["content-length"])
        yield header, data[end + 4 : stop]
        at = stop + 4


def convert_pages(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """``(page_id, url, html, refers_to)`` rows as WARC records: written to ARC, versions 1 and 2 in turn, parsed and converted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for rows, _, _ in blocks(batches, "html"):
            turn += 1
            ids, urls, html, refers = (rows.column(i).to_pylist() for i in range(4))
            made = []
            for url, text in zip(urls, html, strict=True):
                payload = (text or "").encode()
                made.append((url or "", "text/html", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload))
            records = parse_arc(arc_file(1 + turn % 2, f"pages-{ids[0]}.arc", date, made))
            next(records)  # the version block is no page
            out = []
            for i, (header, content) in enumerate(records):
                out.append(to_warc(header, content, "" if ids[i] is None else ids[i], refers[i]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(work, "value string")


def records_of(parts: Iterator[str]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of archives whose text was cut at blank lines, one at a time: a header, then as many parts as its declared length takes."""
    for head in parts:
        lines = head.split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record header where one must be")
        header = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        length, block = int(header["content-length"]), bytearray(next(parts, "").encode())
        while len(block) < length:
            more = next(parts, None)
            if more is None:
                raise ValueError(f"{header['warc-record-id']} ends after its file")
            block += END.encode() + more.encode()
        if len(block) != length:
            raise ValueError(f"{header['warc-record-id']} has {len(block)} bytes instead of {length}")
        yield header, bytes(block)


def read_archives(spark, path: str) -> DataFrame:
    """``(record_id, record_type, page_id, payload_bytes, payload_digest, target)`` of the records of WARC files, gzipped or not; digests are checked.

    A file is read as a stream by one task, a record at a time, so its size doesn't matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "target"])

        out = []
        for header, block in records_of(x.as_py() for batch in batches for x in batch.column(0)):
            http = split_http(block)
            digest = header["warc-payload-digest"].removeprefix("sha1:")
            if header["warc-type"] == "revisit":
                n = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http[0])[1])
            else:
                payload = http[1] if http else block
                n = len(payload)
                if digest32(payload) != digest:
                    raise ValueError(f"{header['warc-record-id']}: its payload has another digest")
            page = header.get("x-page-id", "")
            out.append((header["warc-record-id"], header["warc-type"], int(page) if page else None, n, digest, header.get("warc-refers-to")))
            if len(out) == 4096:
                yield made(out)
                out = []
        if out:
            yield made(out)

    return spark.read.option("lineSep", END).text(path).mapInArrow(work, "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, target string")


def archive_pages(pages: DataFrame, least_bytes: int = 0, file_records: int = 2000, ws: Workspace | None = None) -> DataFrame:
    """Writes a WARC record per page and reads the archives back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a response, the
    others are revisits of it. Which page refers to which is found on digests alone, with the copies of a hot payload dealt out; the html joins by page. Null html is an empty payload, null url a dash. Null page_ids count as smaller than any
    other; rows that repeat the largest page_id are all responses. Html of any length is one record. An empty table gives an empty result; further columns are ignored.
    """
    spark = pages.sparkSession
    ws = ws or Workspace(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url")).alias("row"), F.sha1(html.cast("binary")).alias("sha"))
    narrow = ws.table(p.select("page_id", "row", "sha", F.octet_length(html).alias("size")), "digests")
    last = ws.table(narrow.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").withColumnRenamed("sha", "same"), "last")
    refers = hot_join(narrow, last, "sha", "same", "n", "row").where((F.col("size") >= least_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")))
    refers = refers.select(F.col("page_id").alias("of"), F.col("row").alias("of_row"), F.col("sha").alias("of_sha"), F.col("last").alias("refers_to")).distinct()
    p = p.join(refers.hint("merge"), (F.col("row") == F.col("of_row")) & (F.col("sha") == F.col("of_sha")) & F.col("page_id").eqNullSafe(F.col("of")), "left")
    convert_pages(p).write.option("lineSep", END).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(ws.path("archives"))
    read = ws.table(read_archives(spark, ws.path("archives")), "records")
    targets = read.where("record_type = 'revisit'").groupBy("target").agg(F.count("*").alias("n"))
    responses = read.where("record_type <> 'revisit'").select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to")).distinct().join(targets.withColumnRenamed("target", "of"), "of")
    return hot_join(read, ws.table(responses, "responses"), "target", "of", "n", "record_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
