r"""WARC archives with revisit resolution.

Only headers (page, digest, length, address) are shuffled by payload digest: the smallest page of each digest
is its original, found by a partial aggregate, and the other pages join it by digest (a hot digest is a skewed
join that Spark may split; no group is gathered). Payloads are shuffled once, by page, to meet that decision,
and go into gzipped WARC/1.1 files as ``response`` records with fresh headers; a ``revisit`` record has the
HTTP headers only and names its original.

Archives are written with Spark's text sink, whose line separator is the blank lines that end a record, so any
Hadoop file system will do; they are read back as binary files and cut by each record's Content-Length.
A file holds ``ARCHIVE_BYTES`` of payload on average, which bounds what a reading task holds.

Cases: a null html is an empty payload; of several rows with the smallest page_id of their payload each is a
response; a row without page_id is always a response and never an original; line breaks in addresses are
percent-encoded; the empty table gives no archive and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, table

ARCHIVE_BYTES = 64 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_url string"


def base32(hex40: Column) -> Column:
    """Upper-case base 32 of 40 hexadecimal digits: five digits are four letters."""
    out = []
    for i in range(8):
        v = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), digest).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def resolved(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The pages (page_id, url, payload, bytes, digest) with ``first`` and ``first_url`` for revisits, null for responses."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    own = own.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha1(F.col("payload").cast("binary")).alias("digest"))
    heads = own.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    firsts = heads.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = heads.select("page_id", "digest").join(firsts, "digest").filter(F.col("page_id") > F.col("o.page_id"))
    again = again.select(F.col("page_id").alias("rev_page"), F.col("digest").alias("rev_digest"), F.col("o.page_id").alias("first"), F.col("o.url").alias("first_url")).distinct()
    return own.join(again, (F.col("page_id") == F.col("rev_page")) & (F.col("digest") == F.col("rev_digest")), "left").drop("rev_page", "rev_digest")


def records(rows: DataFrame) -> DataFrame:
    """One WARC record per row of ``resolved``, as a string without its closing blank lines."""
    digest = base32(F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("first").isNotNull()
    block_bytes = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("b32"))),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", record_id(F.col("first"), F.col("digest"))),
            line("WARC-Refers-To-Target-URI", F.col("first_url")),
            line("Refers-To-Page", F.col("first").cast("string")),
        )).otherwise(F.lit("")),
        line("Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit("\r\n"),
    )
    rows = rows.select("*", digest.alias("b32"), http.alias("http"), revisit.alias("revisit"))
    return rows.select(F.concat(head, F.col("http"), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    size = pages.agg(F.coalesce(F.avg(F.octet_length("html")), F.lit(0.0)).alias("b")).first()["b"]
    rows = records(resolved(pages, min_bytes))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(archive_bytes / (size + 500)))).text(folder)


def parse(archive: bytes):
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        a = end + 4
        b = a + int(head["Content-Length"])
        if lines[0] != "WARC/1.1" or archive[b : b + 4] != b"\r\n\r\n":
            raise ValueError(f"no record at byte {at}")
        yield head, archive[a:b]
        at = b + 4


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record; digests and lengths of responses are taken from the payload that was read."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for file in b.column("content"):
            for head, block in parse(gzip.decompress(file.as_py())):
                cut = block.index(b"\r\n\r\n") + 4
                length = int(next(x for x in block[:cut].decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response":
                    body = block[cut:]
                    length, found = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    if found != digest:
                        raise ValueError(f"digest of {head['WARC-Record-ID']} differs")
                page, first = head["Page-Id"], head.get("Refers-To-Page")
                rows.append((int(page) if page else None, length, digest, kind, int(first) if first else None, head["WARC-Target-URI"], head["WARC-Record-ID"], head.get("WARC-Refers-To-Target-URI")))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=[x.split()[0] for x in SCHEMA.split(", ")])

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return arrow_map(files.filter("length > 0").select("content"), kernel, SCHEMA)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
SELECT p.page_id, p.n AS payload_bytes, p.b32 AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, d,
             list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) FOR i IN range(32)], lambda a, b: a || b) AS b32
      FROM (SELECT page_id, html, sha1(coalesce(html, '')) AS d FROM pages)) p
JOIN (SELECT sha1(coalesce(html, '')) AS d, min(page_id) AS first FROM pages GROUP BY 1) f ON f.d = p.d
"""
