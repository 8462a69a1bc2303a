r"""WARC archives and revisit resolution.

``write_archives`` writes records as WARC 1.1 (gzip) with Spark's text sink;
``read_archives`` parses archives back, payloads only on request.
``deduplicate`` resolves revisits: the records' *headers* are shuffled by
payload digest, of equal payloads the record with the largest page id stays a
response, the others are joined to it as their original and are written as
revisits (header only, ``WARC-Refers-To``) with fresh headers.

A record's block is an HTTP response of a fixed head and the payload.  Equal
payloads are those equal in SHA-1, SHA-256 and length.

*Scale.*  Payloads move once, to be joined with the decisions by record id,
which is unique, so no group of copies gathers anywhere; winners are found
by a map-side combined maximum.  Headers are written once as a small table; the joins by payload and by
original deal the rows of a commonest payload to several tasks.
Archives are bounded in bytes: records are written by size class, each class with so many
records per archive that about ``ARCHIVE_BYTES`` of payload come together (a larger page is an archive of its own).
A reader unpacks its archive as a stream, record by record, so it holds the packed bytes, one record and
``READ_BYTES`` of rows.

Defined results: a null payload is empty; a null page id or URL has no header
and reads back as null (a null id ranks lowest); control characters and
``%`` of a URL are percent-coded in the header and decoded again; payloads may hold anything, line ends and record
heads included; rows that repeat page and payload are records of their own;
no rows give an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lotlens.session import scratch_path

from .common import materialised, whole_text
from .components import spread_join

VERSION = "WARC/1.1"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of the smallest class in an archive, and payload bytes that they have at most.
RECORDS_PER_ARCHIVE = 10_000
ARCHIVE_BYTES = 256 << 20
#: Each class of records is so many times as large as the one before, with so many times fewer to an archive.
CLASS_STEP = 8
#: Hadoop's name of the gzip level: between the fastest, which fill the disk, and the default, which takes half as long again.
GZIP_LEVEL = "FIVE"
#: Payload bytes that a reading task gathers before it hands rows on.
READ_BYTES = 4 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

HEADER_SCHEMA = ("record_id string, record_type string, url string, page_id bigint, payload_bytes bigint, "
                 "payload_digest string, payload_sha256 string, refers_to_record string")


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: each five hex digits are four characters of five bits."""
    digits = F.sha1(payload)
    groups = []
    for g in range(8):
        value = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
        groups += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1))
                   for shift in (15, 10, 5, 0)]
    return F.concat(*groups)


def page_records(pages: DataFrame) -> DataFrame:
    """A response record per row of ``pages`` (page_id, url, html): HEADER_SCHEMA and payload."""
    payload = whole_text("html")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"),
                        payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    digest = F.sha2(F.col("payload"), 256)
    name = F.sha2(F.concat_ws("|", "row", F.col("page_id").cast("string"), digest), 256)
    urn = F.concat(F.lit("urn:uuid:"), *[
        x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        for x in ([F.lit("-")] if k else []) + [F.substring(name, a, n)]])
    return rows.select(
        urn.alias("record_id"), F.lit("response").alias("record_type"), "url", "page_id",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"), digest.alias("payload_sha256"),
        F.lit(None).cast("string").alias("refers_to_record"), "payload")


def _url_coded(url: Column) -> Column:
    """Control characters and ``%`` percent-coded, so that a header is one line."""
    coded = F.replace(url, F.lit("%"), F.lit("%25"))
    for code in [*range(32), 127]:
        coded = F.replace(coded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.regexp_like(url, F.lit(r"[\x00-\x1F\x7F%]")), coded).otherwise(url)


def _record_text(date: str) -> Column:
    """A record of HEADER_SCHEMA and payload as text, without the line ends that close it."""
    nl = F.lit("\r\n")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), nl, nl)
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.octet_length(whole_text("payload")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, nl), F.lit(""))

    return F.concat(
        F.lit(VERSION), nl,
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _url_coded(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-SHA256", F.col("payload_sha256")),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_record"), F.lit(">"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")),
        nl, http, F.when(revisit, F.lit("")).otherwise(whole_text("payload")))


def size_classes(per_archive: int = RECORDS_PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES) -> list[tuple[int, int | None]]:
    """(records per archive, most payload bytes of a record or None) from small records to any size."""
    out: list[tuple[int, int | None]] = []
    while per_archive > 1:
        out.append((per_archive, archive_bytes // per_archive))
        per_archive = max(1, per_archive // CLASS_STEP)
    return [*out, (1, None)]


def write_archives(records: DataFrame, path: str, date: str = DATE, per_archive: int = RECORDS_PER_ARCHIVE,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Records of HEADER_SCHEMA and payload as gzipped WARC files below ``path``.

    The first job writes the small records and counts those of the other classes; there are
    more jobs only for classes that occur.
    """
    # of revisits nothing but the header is written
    size = F.when(F.col("record_type") == "revisit", 0).otherwise(F.octet_length(whole_text("payload")))
    classes, low, counted = size_classes(per_archive, archive_bytes), -1, Observation("size-classes")
    bounds = []
    for _, most in classes:
        bounds.append((size > low) if most is None else (size > low) & (size <= most))
        low = most
    seen = records.observe(counted, *[F.count_if(b).alias(f"c{k}") for k, b in enumerate(bounds)])
    for k, (n, _) in enumerate(classes):
        if k == 0 or counted.get[f"c{k}"]:
            (seen if k == 0 else records).filter(bounds[k]).select(_record_text(date).alias("value")).write.mode("append") \
                .option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL) \
                .option("maxRecordsPerFile", n).text(path)


def _parse(stream: io.BufferedReader) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of each record, one at a time."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not the head of a WARC record: {version[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("ascii")] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(len(END)) != END.encode():
            raise ValueError("a WARC record does not end where its length says")
        yield fields, block


def _records(content: pa.Buffer, payloads: bool) -> Iterator[tuple]:
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BufferedReader(pa.BufferReader(content))), 1 << 18)
    for fields, block in _parse(stream):
        text = lambda name: fields[name].decode() if name in fields else None  # noqa: E731, B023
        kind, digest = text("warc-type"), text("warc-payload-digest").removeprefix("sha1:")
        payload = None
        if kind == "response":
            payload = block[block.index(END.encode()) + len(END):]
            # bodies are checked where they are handed on
            if payloads and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {text('warc-record-id')} does not have its digest")
        url, page, refers = fields.get("warc-target-uri"), text("x-page-id"), text("warc-refers-to")
        row = (text("warc-record-id").strip("<>"), kind, None if url is None else unquote_to_bytes(url).decode(),
               None if page is None else int(page), None if payload is None else len(payload), digest,
               text("x-payload-sha256"), refers and refers.strip("<>"))
        yield (*row, None if payload is None else payload.decode()) if payloads else row


def _reader(payloads: bool):
    names = [x.split()[0] for x in HEADER_SCHEMA.split(", ")] + ["payload"] * payloads
    types = [pa.int64() if " bigint" in x else pa.string() for x in HEADER_SCHEMA.split(", ")] + [pa.string()] * payloads

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for k in range(files.num_rows):
                rows, held = [], 0
                for row in _records(files.column(0)[k].as_buffer(), payloads):
                    rows.append(row)
                    held += 300 + (len(row[-1] or "") if payloads else 0)
                    if held >= READ_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return read


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives below ``path``: HEADER_SCHEMA, and payload if asked for.

    A revisit has no payload of its own: payload_bytes and payload are null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_reader(payloads), HEADER_SCHEMA + ", payload string" * payloads)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """record_id, original (record id) of each response of ``headers`` (a written table) that repeats another one's payload.

    The original is the equal record with the largest page id (of equal page
    ids, the largest record id).  Payloads under ``min_bytes`` stay responses.
    """
    same = F.concat_ws(":", "payload_sha256", "payload_digest", F.col("payload_bytes").cast("string"))
    responses = headers.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes)).select(
        "record_id", "page_id", same.alias("payload_key"))
    originals = responses.groupBy(F.col("payload_key").alias("original_key")).agg(
        F.max(F.struct("page_id", "record_id")).alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (spread_join(responses, "payload_key", originals, "original_key")
            .filter("record_id != original.record_id")
            .select("record_id", F.col("original.record_id").alias("original")))


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = 0, date: str = DATE) -> None:
    """The archives below ``source`` written to ``target``, repeated payloads as revisits."""
    headers = materialised(read_archives(spark, source).select(
        "record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "payload_sha256"), "warc-headers")
    repeats = resolve_revisits(headers, min_bytes)
    records = read_archives(spark, source, payloads=True).join(repeats, "record_id", "left")
    again = F.col("original").isNotNull()
    write_archives(records.select(
        "record_id", F.when(again, F.lit("revisit")).otherwise(F.col("record_type")).alias("record_type"),
        "url", "page_id", "payload_bytes", "payload_digest", "payload_sha256",
        F.coalesce("original", "refers_to_record").alias("refers_to_record"),
        F.when(~again, F.col("payload")).alias("payload")), target, date)


def resolved(archives: DataFrame) -> DataFrame:
    """Records (a written table of headers) with revisits completed from their originals: page_id, payload_bytes,
    payload_digest, record_type, refers_to (the original's page id)."""
    originals = archives.filter("record_type = 'response'").select(
        "record_id", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes"))
    responses = archives.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    revisits = archives.filter("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to_record")
    revisits = spread_join(revisits, "refers_to_record", originals, "record_id").select(
        "page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)


def archive_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages archived, deduplicated and read back, all below the shared folder."""
    raw, final = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_archives(page_records(pages), raw)
    deduplicate(spark, raw, final, min_bytes)
    return resolved(materialised(read_archives(spark, final).select(
        "record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_to_record"), "warc-final"))
