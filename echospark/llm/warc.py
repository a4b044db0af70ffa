"""Operator 7: WARC archives with revisit resolution.

Method. Every page gives a header (page_id, payload digest, length). Headers are shuffled
by digest; of equal payloads of at least `MIN_BYTES` bytes the smallest page_id becomes the
response and the others are revisits of it. Archives are written with fresh headers:
a response carries its payload, a revisit names its original and has no body. Reading
back parses the records by Content-Length, takes bytes and digest of a response from its
payload, and joins revisit records to their originals by digest.

Scale. Headers alone (id, url, digest, length) decide; they are made by one pass over the
payloads and written. A bit set of fixed size marks the digests
that occur more than once: pages without such a digest are written where they are read; of
the others the headers are joined with the originals, and only the payloads of responses
among them (one of each repeated payload) are shuffled. Headers of a frequent payload
meet its original as one row of a written table, which adaptive execution can split.
Archives are the part files of one gzipped `text` write whose line separator is the record
separator, so that any store works; each holds about `FILE_BYTES` of records, and
`MAX_RECORDS` at most.

Records. A response holds an HTTP head and the payload, a revisit the HTTP head alone. The
payload digest is that of the payload. A record's id is made of its page id and digest,
so rows that repeat both have one id.

Edge cases. A null or empty html is an empty payload, always a response. Rows that repeat
a page_id and a payload are all responses if theirs is the smallest id, else all revisits.
A null page_id sorts last; pages without any id are responses. Control characters of
a url are percent-encoded in headers. An empty table writes no records.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bit_set, by_bit_set, slot_of, table

MIN_BYTES = 100
#: Bytes of payload and records of one archive.
FILE_BYTES, MAX_RECORDS = 64 << 20, 100_000
RECORD_END = "\r\n\r\n"
_NO_ID = 2**63 - 1


def headers(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, payload_bytes, payload_digest."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )


def originals(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """payload_digest, original: the smallest page_id of every payload that occurs more than once."""
    big = heads.filter(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id")
    return (
        big.groupBy("payload_digest")
        .agg(F.min(F.coalesce("page_id", F.lit(_NO_ID))).alias("original"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("payload_digest", "original")
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest).cast("binary"), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _records(heads: DataFrame, date: str, revisit: bool) -> DataFrame:
    """Records, without their end, of headers(page_id, url, payload_bytes, payload_digest) with payload, or with original for revisits."""
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n")
    )
    length = F.octet_length(http) if revisit else F.octet_length(http) + F.col("payload_bytes")
    refers = [
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", _record_id(F.col("original"), F.col("payload_digest"))),
        line("X-Refers-To-Page", F.col("original").cast("string")),
    ]
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.lit("revisit" if revisit else "response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        *(refers if revisit else []),
        line("X-Page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )
    return heads.select((head if revisit else F.concat(head, F.col("payload"))).alias("record"))


def records(ws: Workspace, pages: DataFrame, bare: DataFrame, date: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One WARC record per page, without its end: record. bare: the headers of pages without their payloads, a written table."""
    heads = headers(pages.select("page_id", "url", "html"))
    repeated = ws.write(originals(bare, min_bytes), "originals")
    bits = bit_set(repeated.select(slot_of("payload_digest").alias("slot")))
    may, single = by_bit_set(heads, "payload_digest", bits)
    told = ws.write(by_bit_set(bare, "payload_digest", bits)[0].join(repeated, "payload_digest", "left"), "decisions")
    again = F.col("original").isNotNull() & (F.coalesce("page_id", F.lit(_NO_ID)) != F.col("original"))
    key = lambda df: df.withColumn("key", F.struct(F.coalesce("page_id", F.lit(_NO_ID)).alias("page"), F.col("page_id").isNull().alias("none"), "payload_digest"))
    first = key(told.filter(~again)).select("key").distinct()
    rows = key(may)
    rows = by_bit_set(rows, "key", bit_set(first.select(slot_of("key").alias("slot"))))[0].join(first, "key", "left_semi").drop("key")
    return _records(single, date, False).union(_records(rows, date, False)).union(_records(told.filter(again), date, True))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = MIN_BYTES, max_records: int = MAX_RECORDS) -> None:
    """Writes pages as deduplicated WARC archives, several files, into the folder `path`."""
    ws = Workspace(pages.sparkSession, "warc")
    bare = ws.write(headers(pages.select("page_id", "url", "html")).drop("payload"), "headers")
    mean = bare.agg(F.avg("payload_bytes")).first()[0] or 0
    each = max(1, min(max_records, int(FILE_BYTES / (mean + 512))))
    out = records(ws, pages, bare, date, min_bytes)
    out.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", each).option("compression", "gzip").text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole archives -> their records; bytes and digest are those of the body that is there."""
    names = ["page_id", "url", "record_type", "refers_to", "stated_digest", "body_bytes", "body_digest"]
    for batch in batches:
        for content in batch.column("content"):
            at, rows, whole = 0, [], content.as_buffer().to_pybytes()
            whole = gzip.decompress(whole) if whole[:2] == b"\x1f\x8b" else whole
            data = memoryview(whole)
            while at < len(whole):
                end = whole.index(b"\r\n\r\n", at)
                lines = whole[at:end].decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"no WARC record at byte {at}")
                head = dict(x.split(": ", 1) for x in lines[1:])
                n, block = int(head["Content-Length"]), end + 4
                body = whole.index(b"\r\n\r\n", block) + 4
                refers = head.get("X-Refers-To-Page")
                rows.append(
                    (
                        int(head["X-Page"]) if head["X-Page"] else None,
                        head["WARC-Target-URI"],
                        head["WARC-Type"],
                        int(refers) if refers else None,
                        head["WARC-Payload-Digest"].removeprefix("sha256:"),
                        block + n - body,
                        hashlib.sha256(data[body : block + n]).hexdigest(),
                    )
                )
                if whole[block + n : block + n + 4] != b"\r\n\r\n":
                    raise ValueError(f"record at byte {at} does not end where its length says")
                at = block + n + 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in `path`, with revisits joined to their originals.

    page_id, url, record_type, refers_to, payload_bytes and payload_digest of the full payload.
    """
    schema = "page_id long, url string, record_type string, refers_to long, stated_digest string, body_bytes long, body_digest string"
    parsed = Workspace(spark, "warc").write(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, schema), "parsed")
    first = (
        parsed.filter("record_type = 'response'")
        .groupBy(F.col("body_digest").alias("stated_digest"))
        .agg(F.max("body_bytes").alias("full_bytes"))
    )
    revisits = parsed.filter("record_type = 'revisit'").join(first, "stated_digest", "left")
    bare = parsed.filter("record_type <> 'revisit'")
    return bare.select(
        "page_id", "url", "record_type", "refers_to", F.col("body_bytes").alias("payload_bytes"), F.col("body_digest").alias("payload_digest")
    ).unionByName(
        revisits.select("page_id", "url", "record_type", "refers_to", F.col("full_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"))
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "warc").path("archives")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}

ORACLE = {
    "op7_warc": """
WITH h AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
o AS (SELECT d, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN o.first IS NULL OR page_id = o.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> o.first THEN o.first END AS refers_to
FROM h LEFT JOIN o USING (d)
"""
}
