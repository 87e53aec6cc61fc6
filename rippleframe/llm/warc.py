"""Content-addressed WARC archive.

An archive is a folder in the shared store with two tables.  ``payloads`` holds each distinct payload once, under its
SHA-256.  ``headers`` holds, for every record, its exact header bytes (WARC named fields, and the HTTP header of a
response) and the digest of its payload.  A record is rebuilt by a join on the digest; the stored bytes are hashed again
on every read, and a payload that does not have its digest stops the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, table

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 (32 characters), from hexadecimal digits in groups of 20 bits."""
    hexa = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def write_archive(pages: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC record for every row into a new archive at ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those with the smallest ``record_id`` are
    ``response`` records and the others ``revisit`` records that refer to it; rows with smaller payloads are all
    responses.  A null payload is empty; a null url gives an empty target; a null record id never is the smallest while
    another exists.  The payload table is filled by one aggregation on the digest, which keeps one copy in each map task
    before anything is shuffled; the digests' smallest ids are another narrow aggregation.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(record_id).alias("record_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    facts = rows.select("record_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n"), sha1_base32(F.col("payload")).alias("sha1"))
    rows.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    facts.groupBy("digest").agg(F.min("record_id").alias("first_id")).write.parquet(f"{path}/firsts")
    firsts = spark.read.parquet(f"{path}/firsts")
    joined = facts.join(firsts, "digest", "left")
    again = (F.col("n") >= min_revisit_bytes) & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    uri = lambda c: F.concat(F.lit("<urn:x-record:"), F.url_encode(F.coalesce(c.cast("string"), F.lit(""))), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    fields = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), uri(F.col("record_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uri(F.col("first_id")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))).cast("string"),
        F.lit("\r\n\r\n"),
    )
    joined.select(
        "record_id", F.concat(fields, http).cast("binary").alias("header"), "digest"
    ).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: record_id, record_type and refers_to, header and payload bytes, payload_bytes and payload_digest.

    The type and what a revisit refers to are read from the header that was stored.

    ``header`` then ``payload`` (of a response) then two line ends are the record's exact bytes; a revisit's payload is
    that of the record it refers to.  Columns that are not used are not read: without ``payload``, the join is narrow.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary"))
    stored = stored.select("digest", checked.alias("payload"))
    stored = stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    headers = spark.read.parquet(f"{path}/headers")
    named = lambda field: F.regexp_extract(F.col("header").cast("string"), rf"(?s)^WARC/1\.1\r\n(?:[^\r]*\r\n)*?{field}: ([^\r]*)\r\n", 1)
    first = F.url_decode(F.regexp_extract(named("WARC-Refers-To"), "^<urn:x-record:(.*)>$", 1))
    refers_to = F.when(first != "", first).cast(headers.schema["record_id"].dataType)
    return headers.select("record_id", refers_to.alias("refers_to"), named("WARC-Type").alias("record_type"), "header", "digest").join(stored, "digest", "left")


def rebuilt_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id and the exact bytes of every record, rebuilt by the join."""
    end = F.lit(b"\r\n\r\n")
    return read_archive(spark, path).select("record_id", F.when(F.col("record_type") == "response", F.concat("header", "payload", end)).otherwise(F.concat("header", end)).alias("record"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive of all pages, read it back, and return the digest columns of every record."""
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first_id FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p
"""
