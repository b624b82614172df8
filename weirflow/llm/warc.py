"""Legacy archive converter: ARC files of either version to WARC.

``write_arc`` stores pages as ARC archives, ``read_arc`` parses archives by their version blocks, header lines
and declared lengths, ``write_warc`` writes equivalent WARC records with identifiers, dates, types and digests
of their own, and ``read_warc`` parses those. Archives are pieces of about ``CHUNK`` bytes, each a file that
Spark's text writer commits (gzip), so a lost executor leaves no half archive and any file system that Spark
writes to will do. Only digests and ids are shuffled to find equal payloads; the records themselves are not,
unless more than ``BROADCAST_REVISITS`` payloads occur twice.

Of records with equal payloads of ``REVISIT_BYTES`` or more, the one with the least page id is a response
and the others are revisits, which carry headers only. Defined results: null html is an empty payload; a null
id stays null, is never the response others refer to unless all ids of the payload are null, and is then a
response; rows with equal id and payload are all responses or all revisits of a smaller id; a null URL is
written as "-"; spaces and control characters of URLs are written as percent codes; other columns are ignored.
A record that ends before its declared length raises ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.arrow import shared_dir, slices

CHUNK = 8 << 20
LEVEL = 4
REVISIT_BYTES = 100
BROADCAST_REVISITS = 200_000
#: Pages carry no date of their own.
DATE = "20000101000000"

# The version blocks of the ARC format.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:weirflow:arc")


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def http_response(page_id: object, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_header(version: int, url: str, date: str, mime: str, block: bytes) -> bytes:
    if version == 1:
        return f"{url} 0.0.0.0 {date} {mime} {len(block)}\n".encode()
    return f"{url} 0.0.0.0 {date} {mime} 200 {hashlib.md5(block).hexdigest()} - 0 - {len(block)}\n".encode()


def arc_description(version: int, name: str) -> bytes:
    """The record that an archive begins with: its name and version block."""
    about = f"{version} 0 weirflow\n{FIELDS[version]}\n".encode()
    rest = f" {len(about)}\n" if version == 1 else f" 200 - - 0 {name} {len(about)}\n"
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain{rest}".encode() + about


def zipped(records: list[bytes], end: bytes) -> bytes:
    """A gzip member for each record and what ends it."""
    return b"".join([gzip.compress(x + end, LEVEL, mtime=0) for x in records])


def chunked(batches: Iterator[pa.RecordBatch], column: str, records) -> Iterator[list[bytes]]:
    """Lists of records of about CHUNK bytes. records: those of a slice."""
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for part in slices(batch, column):
            for x in records(part):
                held.append(x)
                size += len(x)
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def one_file(content: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([content], pa.binary())], names=["value"])


def store(files: DataFrame, folder: str) -> None:
    """Each row of ``files`` as a file of its bytes and a zero byte."""
    files.select(F.col("value").cast("string")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", "\x00").text(folder)


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of both versions by turns, as old collections hold them."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1

        def records(part: pa.RecordBatch) -> Iterator[bytes]:
            for i, u, h in zip(*(part.column(c).to_pylist() for c in ("id", "url", "html")), strict=True):
                block = http_response(i, h.encode("utf-8"))
                yield arc_header(version, safe_url(u), DATE, "text/html", block) + block

        for held in chunked(batches, "html", records):
            # a piece is filled under one version, as the generator reads it anew for each record
            yield one_file(zipped([arc_description(version, "pages.arc"), *held], b"\n"))
            version = 3 - version

    store(rows.mapInArrow(run, "value binary"), folder)


def opened(content: bytes) -> bytes:
    """An archive's bytes; members are read through a buffer, as gzip.decompress copies all that is left for each."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)).read() if content[:2] == b"\x1f\x8b" else content


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record; a version block in front of records says what their headers hold."""
    at, names = 0, FIELDS[1].split()
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        length = int(line.rpartition(" ")[2])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"the ARC record at byte {at} declares {length} bytes and has {len(block)}")
        at = end + 1 + length
        if line.startswith("filedesc:"):
            names = FIELDS[2 if block[:1] == b"2" else 1].split()
        parts = line.split(" ")
        extra = len(parts) - len(names)  # blanks within the content type, or a filedesc of the other version
        if extra > 0:
            parts[3 : 4 + extra] = [" ".join(parts[3 : 4 + extra])]
        yield dict(zip(names, parts, strict=False)), block


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, the header bytes and the payload of an HTTP response; else all is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    end = m.end() if m else len(block)
    lines = block[:end].decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, block[:end], block[end:]


RECORD = "id string, url string, date string, mime string, head binary, payload binary, bytes long, digest string"
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record but the file descriptions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                size = 0
                for fields, block in parse_arc(opened(content.as_py())):
                    if fields["URL"].startswith("filedesc:"):
                        continue
                    http, head, payload = split_http(block)
                    rows.append((http.get("x-page-id"), fields["URL"], fields["Archive-date"], fields["Content-type"], head, payload, len(payload), hashlib.sha256(payload).hexdigest()))
                    size += len(block)
                    if size >= CHUNK // 4:
                        yield table_of(rows)
                        rows, size = [], 0
                if rows:
                    yield table_of(rows)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.binary()] * 2 + [pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


def iso(date: str) -> str:
    d = (date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, page: str | None) -> str:
    """The same for the same record, however often a task runs."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((url, date, digest, page or '')))}>"


def warc_record(r: dict) -> bytes:
    revisit = r["refers_to"] is not None
    http = bool(r["head"])
    kind = "revisit" if revisit else "response" if http else "resource"
    block = (r["head"] or b"") + (b"" if revisit else r["payload"])
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(r["url"], r["date"], r["digest"], r["id"])), ("WARC-Date", iso(r["date"])), ("WARC-Target-URI", r["url"]),
        ("WARC-Payload-Digest", "sha256:" + r["digest"]), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("Content-Type", "application/http; msgtype=response" if http else r["mime"]), ("Content-Length", str(len(block))), ("X-Payload-Length", str(r["bytes"])),
    ]
    if r["id"] is not None:
        fields.append(("X-Page-Id", r["id"]))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(r["first_url"], r["first_date"], r["digest"], r["refers_to"])), ("WARC-Refers-To-Target-URI", r["first_url"]), ("X-Refers-To-Page-Id", r["refers_to"])]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8") + block


def with_revisits(records: DataFrame, id_type: str) -> DataFrame:
    """refers_to, first_url and first_date of the records that revisit another."""
    shared_dir(records.sparkSession)
    long = records.where(F.col("bytes") >= REVISIT_BYTES)
    first = F.min(F.when(F.col("id").isNotNull(), F.struct(F.col("id").cast(id_type).alias("number"), "id", "url", "date"))).alias("f")
    twice = long.groupBy("digest").agg(F.count("*").alias("n"), first).where("n > 1 and f is not null").select(F.col("digest").alias("_digest"), F.col("f.id").alias("_id"), F.col("f.url").alias("first_url"), F.col("f.date").alias("first_date")).checkpoint()
    if twice.count() <= BROADCAST_REVISITS:
        twice = F.broadcast(twice)
    found = records.join(twice, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= REVISIT_BYTES), "left")
    other = ~F.col("id").eqNullSafe(F.col("_id"))
    return found.select(*NAMES, F.when(other, F.col("_id")).alias("refers_to"), "first_url", "first_date")


def write_warc(records: DataFrame, folder: str, id_type: str = "bigint") -> None:
    """Records as read_arc gives them, converted. ``id_type`` orders the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"software: weirflow\r\nformat: WARC File Format 1.1\r\nconforms-to: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
        for held in chunked(batches, "payload", lambda part: map(warc_record, part.to_pylist())):
            digest = hashlib.sha256(b"".join(x[:400] for x in held)).hexdigest()
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id('warcinfo', DATE, digest, None)}\r\nWARC-Date: {iso(DATE)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n".encode() + about
            yield one_file(zipped([info, *held], b"\r\n\r\n"))

    store(with_revisits(records, id_type).mapInArrow(run, "value binary"), folder)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"the WARC record at byte {at} declares {length} bytes and has {len(block)}")
        at = end + 4 + length
        yield fields, block


WARC_ROW = "id string, url string, date string, record_type string, record_id string, refers_to string, refers_to_record string, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each record but warcinfo; the digest of a response is computed from its payload again and must agree."""
    names = [x.split()[0] for x in WARC_ROW.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for f, block in parse_warc(opened(content.as_py())):
                    if f["warc-type"] == "warcinfo":
                        continue
                    payload = split_http(block)[2]
                    declared = f["warc-payload-digest"].removeprefix("sha256:")
                    n, digest = int(f["x-payload-length"]), declared
                    if f["warc-type"] != "revisit":
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != declared:
                            raise ValueError(f"the payload of {f['warc-record-id']} has another digest than declared")
                    rows.append((f.get("x-page-id"), f["warc-target-uri"], f["warc-date"], f["warc-type"], f["warc-record-id"], f.get("x-refers-to-page-id"), f.get("warc-refers-to"), n, digest, payload if with_payload else None))
                    size += len(payload) * with_payload + 500
                    if size >= CHUNK // 4:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, WARC_ROW)


def convert(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages through both archives under ``folder``; the rows of read_warc."""
    spark = pages.sparkSession
    write_arc(pages, f"{folder}/arc", id_col, url_col, html_col)
    write_warc(read_arc(spark, f"{folder}/arc"), f"{folder}/warc", pages.schema[id_col].dataType.simpleString())
    return read_warc(spark, f"{folder}/warc", with_payload=False)


def digest(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The columns of the query. Without a folder the archives go to a new one under the shared folder."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType
    return convert(pages, folder).select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.when(F.col("record_type") == "revisit", "revisit").otherwise("response").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first, count(*) AS n FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= {REVISIT_BYTES}"""
