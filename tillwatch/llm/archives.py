"""Legacy web archives (ARC) to WARC.

An ARC file opens with a version block whose second line says how the header lines that follow are laid out;
each record is such a line, a declared number of bytes and a line feed. The converter reads records by their
declared length, and gives each a WARC identifier, timestamp, type and digests.

Archives are written by Spark's text writer, one row per record with the record separator as line separator,
so they reach any store that Spark reaches and a lost task is simply written again; they are read as binary
files and parsed inside tasks record by record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.frames import shared_folder

#: Fixed values of the ARC format: fields of a record's header line, by the version that the version block names.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NOBODY, NOWHERE = "0.0.0.0", "urn:none"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FLUSH = 8 << 20
RECORD = "page_id long, url string, ip string, date string, status int, head binary, payload binary, digest string, error string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def batches_of(rows: Iterable[dict], schema: pa.Schema, weigh: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    """Record batches of about FLUSH bytes."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) + 200
        if size > FLUSH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def unpacked(content: bytes) -> io.BufferedReader | io.BytesIO:
    """A stream over an archive; gzip members (one for the file or one per record) are opened on the way."""
    import gzip

    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


# ARC


def arc_opening(version: str, name: str, date: str) -> str:
    block = f"{version} 0 tillwatch\n{FIELDS[version]}\n"
    between = "" if version == "1" else f"200 - - 0 {name} "
    return f"filedesc://{name} {NOBODY} {date} text/plain {between}{len(block)}\n{block}"


def arc_record(version: str, url: str, date: str, document: bytes, name: str) -> str:
    between = "" if version == "1" else f"200 {base32_sha1(document)} - 0 {name} "
    return f"{url} {NOBODY} {date} text/html {between}{len(document)}\n{document.decode()}"


def safe_url(url: str | None) -> str:
    """Header lines part fields by blanks, so blanks and controls of a URL are percent-encoded."""
    return re.sub(r"[\s\x00-\x20\x7f]", lambda m: quote(m[0]), url) if url else NOWHERE


def _arc_lines(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    version, name = str(1 + part % 2), f"part-{part:05d}.arc"

    def rows() -> Iterator[dict]:
        opened = False
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if not opened:
                    yield {"value": arc_opening(version, name, date)}
                    opened = True
                body = (html or "").encode()
                number = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(body)}\r\n\r\n"
                yield {"value": arc_record(version, safe_url(url), date, head.encode() + body, name)}

    yield from batches_of(rows(), pa.schema([("value", pa.string())]), lambda row: len(row["value"]))


def write_arcs(pages: DataFrame, folder: str, date: str = "20240102030405") -> None:
    """pages (page_id, url, html) as ARC files, versions 1 and 2 by turns. Null html is an empty payload."""
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    chosen.mapInArrow(lambda x: _arc_lines(x, date), "value string").write.text(folder, compression="gzip", lineSep="\n")


def arc_records(stream: io.BufferedReader | io.BytesIO) -> Iterator[dict]:
    """url, ip, date, type, document or error of each record; the version block decides how lines are read.

    A line that is no header is skipped up to the next that is; a record cut short is reported with what is there.
    """
    count = len(FIELDS["1"].split())
    while line := stream.readline():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            continue
        parts = text.rsplit(" ", count - 1)
        if text.startswith("filedesc://"):
            parts = [text.split(" ")[0], *text.split(" ")[1:4], text.rsplit(" ", 1)[1]]
        if len(parts) < 5 or not parts[-1].isdigit() or not re.fullmatch(r"\d{8,17}", parts[2]):
            yield {"error": f"no header line: {text[:80]}"}
            continue
        length = int(parts[-1])
        document = stream.read(length)
        if text.startswith("filedesc://"):
            version = document.split(b" ", 1)[0].decode("ascii", "replace")
            if version not in FIELDS:
                yield {"error": f"unknown version {version}"}
            count = len(FIELDS.get(version, FIELDS["1"]).split())
            continue
        yield {"url": parts[0], "ip": parts[1], "date": parts[2], "type": parts[3], "document": document,
               "error": None if len(document) == length else f"{len(document)} of {length} bytes"}


def http_parts(document: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, body); without an HTTP head all is body."""
    if not document.startswith(b"HTTP/"):
        return b"", document
    head, gap, body = document.partition(b"\r\n\r\n")
    return (head + gap, body) if gap else (document, b"")


def head_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("status", pa.int32()),
                     ("head", pa.binary()), ("payload", pa.binary()), ("digest", pa.string()), ("error", pa.string())])


def _parsed(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for content in batch.column("content"):
                for record in arc_records(unpacked(content.as_py())):
                    if "document" not in record:
                        yield record
                        continue
                    head, body = http_parts(record["document"])
                    number, status = head_field(head, "X-Page-Id"), re.match(rb"HTTP/\S+ (\d{3})", head)
                    yield {**{k: record[k] for k in ("url", "ip", "date", "error")}, "page_id": int(number) if number else None,
                           "status": int(status[1]) if status else None, "head": head if payloads else None,
                           "payload": zlib.compress(body, 1) if payloads else None, "digest": base32_sha1(body)}

    yield from batches_of(rows(), _RECORD, lambda row: len(row.get("payload") or b""))


def read_arcs(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all ARC files of a folder (payload zlib-packed), with an error text where a record is damaged.

    Without ``payloads`` heads and payloads are left out and nothing is packed; digests are there all the same.
    """
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(lambda x: _parsed(x, payloads), RECORD)


# WARC


def record_id(page_id: int | None, url: str, date: str) -> str:
    """A version 8 UUID of the record's own facts: 48 bits of a hash, then the page number."""
    mark = hashlib.sha1(f"{url} {date} {page_id}".encode()).hexdigest()[:12]
    number = 0 if page_id is None else page_id % (1 << 64)
    text = f"{mark}8{0 if page_id is None else 1:x}0{number >> 60:x}8{number & ((1 << 60) - 1):015x}"
    return f"<urn:uuid:{text[:8]}-{text[8:12]}-{text[12:16]}-{text[16:20]}-{text[20:]}>"


def page_of(identifier: str) -> int | None:
    text = identifier.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    if text[13] == "0":
        return None
    number = int(text[15], 16) << 60 | int(text[17:], 16)
    return number - (1 << 64) if number >= 1 << 63 else number


def warc_date(date: str) -> str:
    try:
        return datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))] if v is not None]
    return f"WARC/1.1\r\n{''.join(lines)}\r\n".encode() + block


def _warc_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() if TaskContext.get() else 0

    def rows() -> Iterator[dict]:
        opened = False
        for batch in batches:
            for row in batch.to_pylist():
                date = warc_date(row["date"])
                if not opened:
                    yield {"value": warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, f"warcinfo {part}", row["date"])), ("WARC-Date", date),
                                                 ("Content-Type", "application/warc-fields")], b"software: tillwatch\r\nformat: WARC File Format 1.1\r\n")}
                    opened = True
                again = row["refers_to"] is not None
                kind = "revisit" if again else "response" if row["head"] else "resource"
                fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(row["page_id"], row["url"], row["date"])), ("WARC-Date", date),
                          ("WARC-Target-URI", row["url"]), ("WARC-IP-Address", row["ip"] if row["ip"] != NOBODY else None),
                          ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
                          ("WARC-Profile", REVISIT if again else None),
                          ("WARC-Refers-To", record_id(row["refers_to"], row["refers_url"], row["refers_date"]) if again else None),
                          ("WARC-Refers-To-Target-URI", row["refers_url"] if again else None),
                          ("WARC-Refers-To-Date", warc_date(row["refers_date"]) if again else None),
                          ("WARC-Truncated", "disconnect" if row["error"] else None),
                          ("Content-Type", "application/http; msgtype=response" if row["head"] else "application/octet-stream")]
                yield {"value": warc_record(fields, row["head"] if again else row["head"] + zlib.decompress(row["payload"]))}

    yield from batches_of(rows(), pa.schema([("value", pa.binary())]), lambda row: len(row["value"]))


def convert_arcs(spark: SparkSession, arc_folder: str, warc_folder: str, least_revisit: int = 0) -> None:
    """Write the records of ARC files as WARC files.

    Of records with equal payloads of at least ``least_revisit`` bytes the one with the smallest page number is a
    response, later ones are revisits of it without a payload; smaller payloads are all responses. Records without
    a page number come after all others, and are all responses where no record of their payload has one. Records
    with one number and payload are alike. Damaged records that still have a document are kept and marked truncated.
    """
    records = read_arcs(spark, arc_folder).where("digest IS NOT NULL")
    named = read_arcs(spark, arc_folder, payloads=False).where("digest IS NOT NULL")
    first = named.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("first"))
    joined = records.join(first.hint("shuffle_hash"), "digest")
    length = F.coalesce(F.regexp_extract(F.col("head").cast("string"), r"(?im)^content-length:\s*(\d+)", 1).try_cast("long"), F.lit(1 << 40))
    again = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id")) & (length >= least_revisit) & (F.octet_length("head") > 0)
    pick = lambda name: F.when(again, F.col(f"first.{name}"))
    lines = joined.select(
        "page_id", "url", "ip", "date", "head", "payload", "digest", "error",
        pick("page_id").alias("refers_to"), pick("url").alias("refers_url"), pick("date").alias("refers_date"))
    lines.mapInArrow(_warc_lines, "value binary").select(F.col("value").cast("string")).write.text(warc_folder, compression="gzip", lineSep="\r\n\r\n")


def warc_records(stream: io.BufferedReader | io.BytesIO) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("date", pa.string()), ("intact", pa.bool_()),
                   ("payload", pa.binary())])


def _pages(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in warc_records(unpacked(content.as_py())):
                    if fields["warc-type"] not in ("response", "revisit", "resource"):
                        continue
                    head, body = http_parts(block)
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    again = fields["warc-type"] == "revisit"
                    number, own = head_field(head, "X-Page-Id"), None if again else base32_sha1(body)
                    yield {"page_id": int(number) if number else page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
                           "payload_bytes": int(head_field(head, "Content-Length") or 0) if again else len(body),
                           "payload_digest": said if again else own, "record_type": fields["warc-type"],
                           "refers_to": page_of(fields["warc-refers-to"]) if again else None,
                           "record_id": fields["warc-record-id"], "date": fields["warc-date"],
                           "intact": fields["warc-block-digest"] == f"sha1:{base32_sha1(block)}" and (again or said == own),
                           "payload": body if payloads and not again else None}

    yield from batches_of(rows(), _PAGE, lambda row: len(row["payload"] or b""))


def read_warcs(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Page records of all WARC files of a folder; intact tells whether the digests in them hold."""
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(
        lambda x: _pages(x, payloads),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, intact boolean, payload binary")


def archived(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """pages (page_id, url, html) through ARC and WARC and back. An empty table gives no rows; a null URL is
    ``urn:none``; extra columns are not archived."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    write_arcs(pages, f"{folder}/arc")
    convert_arcs(spark, f"{folder}/arc", f"{folder}/warc", least_revisit)
    return read_warcs(spark, f"{folder}/warc").drop("payload")
