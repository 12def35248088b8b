"""From legacy web archives (ARC, versions 1 and 2) to WARC 1.1, and back from WARC to rows.

An ARC file is a version block, whose header names the fields of later headers, and records of a header line, a body of the declared
length and a line end. The converter parses either version, follows declared lengths only (a body may hold anything), and makes a
WARC record of each: an identifier from url, time and content, the time in ISO form, the type, block and payload digests in base32
SHA-1, and an HTTP block. Among equal payloads of at least ``least`` bytes the one with the largest page id stays a response; the
others become revisit records that refer to it and keep only the HTTP header. Smaller payloads are all responses.

Files are written by Spark's text writer with raw bytes: a row is a run of records of about ``RUN_BYTES`` (beginning with its own
version block or warcinfo record), a file at most ``RUNS_PER_FILE`` rows, compressed as a whole with gzip. The writer puts the
line end that ends a run, so no local file is touched and a lost task is simply written again.

Rows: NULL html is an empty payload. NULL or repeated page ids are kept; among equal payloads with equal largest id each of them is
a response. Spaces and control characters in a url are percent-encoded in headers; a NULL url is written as "-" and read back as NULL.
Only page_id, url and html are read. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabreg.llm.common import narrow, pieces_of_batches, salted_lookup, shared_path

RUN_BYTES = 2 << 20
RUNS_PER_FILE = 8
FIRST_DAY = datetime(2000, 1, 1, tzinfo=UTC)
# fixed values: field names of the two header versions, and of WARC
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f%]")
ESCAPED = re.compile(r"%([0-9A-F]{2})")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _url(value: str | None) -> str:
    """A url without blanks; one that could be taken for a missing one or for an archive's own first record is escaped."""
    if value is None:
        return "-"
    out = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)
    return f"%{ord(out[0]):02X}{out[1:]}" if out == "-" or out.startswith("filedesc:") else out or "%"


def _plain_url(value: str) -> str | None:
    return None if value == "-" else "" if value == "%" else ESCAPED.sub(lambda m: chr(int(m[1], 16)), value)


def _http(page_id: int | None, size: int) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {size}\r\n\r\n".encode()


# ---- ARC ------------------------------------------------------------------------------------------------------------------

def arc_start(version: int, name: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(FIELDS[version])}\n".encode()
    rest = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 20000101000000 text/plain{rest} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, when: str, body: bytes, offset: int, name: str) -> bytes:
    rest = "" if version == 1 else f" 200 {zlib.crc32(body):08x} - {offset} {name}"
    return f"{url} 0.0.0.0 {when} text/html{rest} {len(body)}\n".encode("utf-8", "surrogatepass") + body


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file (or of several in a row): header fields by name, and ``body``."""
    at, names = 0, FIELDS[1]
    while at < len(content):
        if content[at] == 10:  # line ends between records
            at += 1
            continue
        stop = content.index(b"\n", at)
        line = content[at:stop].decode("utf-8", "surrogatepass").split(" ")
        opening = line[0].startswith("filedesc://")
        size = int(line[-1])
        body = content[stop + 1:stop + 1 + size]
        if len(body) != size:
            raise ValueError("an ARC record ends before its declared length")
        at = stop + 1 + size
        if opening:
            head = body.decode().split("\n")
            names = tuple(head[1].split(" "))
            if names != FIELDS[int(head[0].split(" ")[0])]:
                raise ValueError(f"unknown ARC fields {names}")
            continue
        if len(line) != len(names):
            raise ValueError(f"an ARC header of {len(line)} fields where {len(names)} are declared")
        yield dict(zip(names, line, strict=True)) | {"body": body}


def write_arc(pages: DataFrame, path: str) -> None:
    """Every page as an ARC record; runs of both versions, by a hash of the first page id."""
    rows = narrow(pages, page_id="page_id:long", url="url:string", html="html:string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, version, name = [], 0, 1, ""
        for batch in pieces_of_batches(batches, "html", RUN_BYTES):
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not held:
                    version, name = 1 + zlib.crc32(str(page).encode()) % 2, f"pages-{page}.arc"
                    held.append(arc_start(version, name))
                    size = len(held[0])
                payload = (html or "").encode("utf-8", "surrogatepass")
                when = (FIRST_DAY + timedelta(seconds=(page or 0) % (1 << 29))).strftime("%Y%m%d%H%M%S")
                held.append(arc_record(version, _url(url), when, _http(page, len(payload)) + payload, size, name))
                size += len(held[-1])
                if size >= RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], ["value"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], ["value"])

    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.option("maxRecordsPerFile", RUNS_PER_FILE).option("compression", "gzip").option("lineSep", "\n").text(path))


def _split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, payload


def read_arc(spark: SparkSession, path: str, with_payload: bool) -> DataFrame:
    """(row, page_id, url, time, bytes, digest[, payload]) of every record; ``row`` is the record's synthesised identifier."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for k, r in enumerate(parse_arc(zlib.decompress(content, 31))):
                    head, payload = _split_http(r["body"])
                    when = datetime.strptime(r["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
                    page = int(head["x-page-id"]) if "x-page-id" in head else None
                    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name.rpartition('/')[2]} {k} {r['URL']} {when}")
                    rows.append((f"urn:uuid:{own}", page, r["URL"], when, len(payload), sha1_base32(payload))
                                + ((payload,) if with_payload else ()))
                    if with_payload and sum(x[4] for x in rows[-64:]) > RUN_BYTES:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)],
                                          [n for n, _ in columns])

    columns = [("row", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("time", pa.string()), ("bytes", pa.int64()),
               ("digest", pa.string())] + [("payload", pa.binary())] * with_payload
    schema = "row string, page_id long, url string, time string, bytes long, digest string" + ", payload binary" * with_payload
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


# ---- WARC -----------------------------------------------------------------------------------------------------------------

def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block


def warc_record(row: str, page: int | None, url: str, when: str, digest: str, payload: bytes, size: int, refers: int | None,
                refers_row: str | None) -> bytes:
    """One record; a revisit if ``refers_row`` is given."""
    block = _http(page, size) + (payload if refers_row is None else b"")
    fields = [("WARC-Type", "response" if refers_row is None else "revisit"), ("WARC-Record-ID", f"<{row}>"), ("WARC-Date", when),
              ("WARC-Target-URI", url), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if refers_row is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_row}>"),
                   ("WARC-Refers-To-Page", str(refers)), ("WARC-Truncated", "length")]
    return _warc(fields, block)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record; blocks are found by their declared length."""
    at = 0
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(fields["content-length"])
        at = stop + 4 + size
        if at > len(content):
            raise ValueError("a WARC record ends before its declared length")
        yield fields, content[stop + 4:at]


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """All records of the ARC files as WARC files; equal payloads of at least ``least`` bytes are stored once."""
    # a page id first, then the record that has it: order of the struct decides
    first = F.max(F.when(F.col("bytes") >= least, F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), F.col("row")))).alias(
        "max_first")
    index = read_arc(spark, arc_path, with_payload=False).select("row", "page_id", "bytes", "digest")
    kept = (salted_lookup(index, "digest", [first], "row")
            .select(F.col("row").alias("__row"), F.col("max_first.row").alias("__to_row"), F.col("max_first.p").alias("__to"),
                    (F.coalesce(F.col("max_first.p") != F.coalesce("page_id", F.lit(-(1 << 63))), F.lit(False))).alias("__revisit"))
            .filter("__revisit"))
    records = read_arc(spark, arc_path, with_payload=True).join(kept, F.col("row") == F.col("__row"), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces_of_batches(batches, "payload", RUN_BYTES):
            for row, page, url, when, n, digest, payload, to_row, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held:
                    info = b"software: tabreg\r\nformat: WARC File Format 1.1\r\n"
                    own = uuid.uuid5(uuid.NAMESPACE_URL, f"info {row}")
                    held.append(_warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", when),
                                       ("Content-Type", "application/warc-fields")], info))
                    size = len(held[0])
                held.append(warc_record(row, page, url, when, digest, payload or b"", n, to, to_row))
                size += len(held[-1])
                if size >= RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["value"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["value"])

    slim = records.select("row", "page_id", "url", "time", "bytes", "digest",
                          F.when(F.col("__row").isNull(), F.col("payload")).alias("payload"), F.col("__to_row"), F.col("__to"))
    (slim.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.option("maxRecordsPerFile", RUNS_PER_FILE).option("compression", "gzip").option("lineSep", "\r\n\r\n").text(warc_path))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit record; digests of responses are taken anew from the stored payload."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for fields, block in parse_warc(zlib.decompress(content, 31)):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = _split_http(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and sha1_base32(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                    rows.append((int(head["x-page-id"]) if "x-page-id" in head else None, _plain_url(fields["warc-target-uri"]),
                                 int(head["content-length"]), digest, fields["warc-type"],
                                 int(fields["warc-refers-to-page"]) if revisit else None, None if revisit else payload))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)],
                                                 [n for n, _ in columns])

    columns = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
               ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema + ", payload binary" * with_payload)


def archive_digests(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC to (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc)
    convert_arc(spark, arc, warc, least)
    return read_warc(spark, warc, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
