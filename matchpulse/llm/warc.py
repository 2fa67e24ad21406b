"""WARC archives with revisit resolution.

Headers only (page_id, payload digest, size) are grouped by digest to find the original of each payload
held by several pages: the smallest page_id. Pages are then joined with these originals, and
archives are written with fresh headers: the payload once, as response, and a revisit record
without payload for each other page. The join ends in the writer, so Spark may split a hot digest.

Archives are gzip files written by Spark's text writer, on any file system that Spark reaches. Pages are written by
classes of size (``CLASSES``), so that an archive holds some 64 MB of payloads or one longer record. They are read
back file by file, by Content-Length.

A null html is an empty payload. Payloads under ``least`` bytes are always responses. Rows
of one payload that share the smallest page_id are all responses; pages without page_id are
never originals unless all are, and then all are responses. Control characters and spaces in urls
are written as %20. Empty tables give empty archives.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchpulse.sources.staging import staged

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes from which a class begins, and the records in one of its archives.
CLASSES = ((0, 2_000), (32_000, 64), (1_000_000, 1))
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def originals(pages: DataFrame, least: int) -> DataFrame:
    """payload_digest and the smallest page_id, for each payload of several pages."""
    headers = pages.select("page_id", F.sha2(payload(), 256).alias("payload_digest"), F.octet_length(payload()).alias("size"))
    return (
        headers.where(F.col("size") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("copies"))
        .where("copies > 1 AND original IS NOT NULL")
        .drop("copies")
    )


def _record_id(page_id: str) -> Column:
    digest = F.md5(F.concat_ws("/", F.coalesce(F.col(page_id).cast("string"), F.lit("none")), "payload_digest").cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, known: DataFrame, date: str) -> DataFrame:
    """The text of each record, without its last newline. ``known``: the originals of all pages."""
    rows = pages.select("page_id", "url", "html", F.sha2(payload(), 256).alias("payload_digest"))
    joined = rows.join(known, "payload_digest", "left")
    size = F.octet_length(payload()).cast("string")
    revisit = F.col("original").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("original")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("html", F.lit(""))))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    fields = [
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id("page_id")),
        line("WARC-Date", date),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("page_id").isNotNull(), line("Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", PROFILE),
                line("WARC-Refers-To", _record_id("original")),
                line("Refers-To-Page-ID", F.col("original").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
    ]
    return joined.select(F.concat(F.lit(f"{VERSION}\r\n"), *fields, F.lit("\r\n"), block, F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, folder: str, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per page into gzip archives in a new folder."""
    size = F.octet_length(payload())
    ends = [begin for begin, _ in CLASSES[1:]] + [None]
    counts = [F.count(F.when((size >= begin) & (F.lit(True) if end is None else size < end), 1)) for (begin, _), end in zip(CLASSES, ends)]
    held = pages.agg(*counts).first()
    known = staged(originals(pages, least), "warc-originals")
    for at, ((begin, most), end) in enumerate(zip(CLASSES, ends)):
        if held[at] or not at:
            own = pages.where(size >= begin) if end is None else pages.where((size >= begin) & (size < end))
            writer = records(own, known, date).write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", most)
            writer.text(folder, compression="gzip")


def parse(data: bytes):
    """(page_id, url, payload bytes, digest, type, refers_to) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"no record at byte {at}")
        field = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        at = start + int(field["Content-Length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {at} is not closed")
        body = data.index(b"\r\n\r\n", start) + 4
        size = int(data[start:body].rsplit(b"Content-Length: ", 1)[1])
        digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
        if field["WARC-Type"] == "response" and (at - body != size or hashlib.sha256(data[body:at]).hexdigest() != digest):
            raise ValueError(f"the payload of {field['WARC-Record-ID']} differs from its header")
        at += 4
        numbers = (int(field[name]) if name in field else None for name in ("Page-ID", "Refers-To-Page-ID"))
        page_id, refers_to = numbers
        yield page_id, field["WARC-Target-URI"], size, digest, field["WARC-Type"], refers_to


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record, checked."""

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                rows = list(parse(gzip.decompress(content.as_py())))
                if rows:
                    yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(run, RECORDS)
