"""WARC archives with revisit records for repeated payloads, written and read with Spark.

Only headers (page, digest, size) are shuffled to find repeats; the payload is
written once, by the record with the smallest page id, and the others become
revisit records that refer to it.  A record always ends in an empty line pair,
which is what the text sink puts after each row, so the files are plain WARC.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, first_row, freed_shuffles
from corpusloom.session import ensure_checkpoint_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ARCHIVE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's bytes: five hexadecimal digits make four characters."""
    groups = [F.conv(F.substring(F.sha1(text.cast("binary")), 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    digit = lambda v, shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, 1)
    whole = F.transform(F.array(*groups), lambda v: F.concat(*[digit(v, s) for s in (15, 10, 5, 0)]))
    return F.array_join(whole, "")


def resolve_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, refers_to, refers_to_url`` of every row.

    ``refers_to`` is null for responses: payloads of fewer than ``least_bytes``
    bytes, first occurrences, and rows that repeat the response itself.  A null
    html is empty; a row with a null id is a response and never referred to.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = ["payload_digest", "payload_bytes"]
    headers = cut(rows.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", *keys))
    firsts = headers.groupBy(*keys).agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.max("page_id").alias("last"))
    repeats = headers.join(firsts.filter("first < last").drop("last"), keys).filter("page_id > first")
    repeats = cut(repeats.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("first").alias("refers_to"),
                                 F.col("first_url").alias("refers_to_url")).distinct())
    return rows.join(repeats, (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_page", "_digest")


def _urn(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(resolved: DataFrame, date: str) -> Column:
    """The record of a row, without the line pairs that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    when = lambda cond, value: F.when(cond, value).otherwise(F.lit(""))
    clean = lambda c: F.regexp_replace(c, r"[\r\n]+", "")
    again = F.col("refers_to").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(page)), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.coalesce(clean(F.col("url")), F.concat(F.lit("urn:page:"), page))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), line("X-Page-ID", page),
        when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to").cast("string"))),
                             line("WARC-Refers-To-Target-URI", F.coalesce(clean(F.col("refers_to_url")), F.concat(F.lit("urn:page:"), F.col("refers_to").cast("string")))),
                             line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, date: str = "2025-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Write a record per row of ``pages(page_id, url, html)`` to WARC files of about 16 MB under ``path``."""
    resolved = resolve_revisits(pages, least_bytes)
    mean = first_row(pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))))[0] or 0
    per_file = max(1, int(ARCHIVE_BYTES / (mean + 600)))
    with freed_shuffles(pages.sparkSession):
        (resolved.select(records(resolved, date).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path))


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def _parse(name: str, content: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8").split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"{name}: no record at byte {at}")
        h = dict(x.split(": ", 1) for x in lines)
        begin, size = end + 4, int(h["Content-Length"])
        block = content[begin:begin + size]
        body = block.index(b"\r\n\r\n") + 4
        if content[begin + size:begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at byte {at} does not end where it says")
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response":
            n, own = size - body, base64.b32encode(hashlib.sha1(block[body:]).digest()).decode()
            if own != digest:
                raise ValueError(f"{name}: the payload at byte {at} has another digest")
        else:
            n = next(int(x[16:]) for x in block[:body].split(b"\r\n") if x.startswith(b"Content-Length: "))
        number = lambda key: int(h[key]) if h.get(key) else None
        yield number("X-Page-ID"), n, digest, h["WARC-Type"], number("X-Refers-To-Page-ID"), h["WARC-Target-URI"], name
        at = begin + size + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = list(_parse(path.rsplit("/", 1)[-1], content.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``; payload digests are computed anew and compared."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, _READ)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back.

    An empty table gives no archive and no row; repeated rows are records of
    their own; other columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes=least_bytes)
    return read_archives(spark, path)
