"""WARC archives with revisit records in place of repeated payloads."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import Scratch, prepare

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes up to which a file has so many records: a file's payloads have
#: 128 MB at most, or it has one record, so that one task can read it whole.
RECORDS_PER_FILE = ((1 << 16, 2000), (1 << 22, 32), (1 << 62, 1))
_BASE32_DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
SCHEMA = (
    "page_id long, url string, record_type string, record_id string, payload_bytes long, payload_digest string, "
    "refers_to long, refers_to_uri string, payload binary"
)
_ARROW = pa.schema([
    pa.field(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t])
    for n, t in (c.split() for c in SCHEMA.split(", "))
])


def base32_sha1(column):
    """The bare upper-case base32 SHA-1 of a binary or string column."""
    digits = F.upper(F.sha1(column))
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), *_BASE32_DIGITS)


def keyed(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with payload, its size and its digest."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    return pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        F.coalesce(pages["page_id"].cast("long"), F.lit((1 << 63) - 1)).alias("key"),
        F.regexp_replace(F.coalesce(pages["url"].cast("string"), F.lit("")), r"[\x00-\x20]+", "%20").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )


def resolve(headers: DataFrame, min_bytes: int, scratch: Scratch) -> DataFrame:
    """The original of each page and payload (key, payload_digest) of the headers
    (key, page_id, url, payload_bytes, payload_digest); none for payloads below
    ``min_bytes``. Headers are shuffled by payload digest with a partial minimum
    before, and the join back can be split where a digest is hot, as both of its
    sides are tables."""
    least = F.min(F.struct("key", "page_id", "url")).alias("original")
    originals = scratch.keep(headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(least), "originals")
    return headers.select("key", "payload_digest").distinct().join(originals, "payload_digest")


def record_id(key, digest, nth):
    digits = F.md5(F.concat_ws("/", F.lit("page"), key.cast("string"), digest, nth.cast("string")))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(date: str = DATE):
    """The text of one record, without its last line feed."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    again = F.col("original").isNotNull() & ((F.col("original.key") != F.col("key")) | (F.col("nth") > 1))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("key"), F.col("payload_digest"), F.col("nth"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", record_id(F.col("original.key"), F.col("payload_digest"), F.lit(1))),
                line("WARC-Refers-To-Target-URI", F.col("original.url")),
                line("WARC-Refers-To-Date", F.lit(date)),
                line("X-Refers-To-Page", F.coalesce(F.col("original.page_id").cast("string"), F.lit(""))),
            ),
        ).otherwise(F.lit("")),
        line("X-Page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", size),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, scratch: Scratch | None = None) -> None:
    """Writes gzipped WARC files of ``pages`` (page_id, url, html) to a new folder.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the
    least page_id is a response with the payload and the others are revisits of
    it, with fresh headers only; smaller payloads are all responses. A null html
    is an empty payload, a null page_id comes last, and of rows with one page_id
    and payload one is the response. White space in a URL becomes ``%20``. Pages
    of a size class are written together, so that files are bounded in bytes;
    an empty table makes a folder without records, other columns are ignored.
    Spark commits the files, so a lost executor leaves no half of one.
    """
    spark = prepare(pages.sparkSession)
    scratch = scratch or Scratch(spark, "warc")
    rows = keyed(pages)
    headers = scratch.keep(rows.drop("payload"), "headers")
    found = scratch.keep(resolve(headers, min_bytes, scratch), "found")
    least = -1
    for most, records in RECORDS_PER_FILE:
        fits = (F.col("payload_bytes") > least) & (F.col("payload_bytes") <= most)
        # the first write makes the folder, even of an empty table
        if least < 0 or not headers.where(fits).isEmpty():
            same = Window.partitionBy("key", "payload_digest").orderBy("url")  # as the join's, so payloads are shuffled once
            some = rows.where(fits).join(found, ["key", "payload_digest"], "left").withColumn("nth", F.row_number().over(same))
            text = some.select(record(date).alias("value"))
            text.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        least = most


def parse(data: bytes):
    """Records of one gzipped file, by their Content-Length. Raises ValueError
    where a response's payload has another digest than its header."""
    data = zlib.decompress(data, 31)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        begin = end + 4
        block = data[begin : begin + int(head["content-length"])]
        at = begin + len(block) + 4
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        payload = None
        if head["warc-type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload digest of record {head['warc-record-id']} differs")
        number = lambda name: int(head[name]) if head.get(name) else None
        yield (
            number("x-page"), head["warc-target-uri"], head["warc-type"], head["warc-record-id"], number("x-payload-length"),
            digest, number("x-refers-to-page"), head.get("warc-refers-to-target-uri"), payload,
        )


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of a folder that ``write`` made, payload null for revisits (and
    for all unless ``payloads``)."""
    prepare(spark)

    def run(arrow_batches):
        for batch in arrow_batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse(content.as_py()):
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(rows[-1][-1] or b"")
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
