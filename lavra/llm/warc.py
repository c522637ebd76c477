"""A content-addressed WARC archive.

``payloads`` holds each distinct payload once, deflated, under its SHA-256; ``headers`` holds every record's exact
header bytes and the digest of its payload.  Joining the two gives the original records back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm.common import new_folder

#: Stands for the capture time, which the tables do not have; fixed, so that archives can be compared.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight digits from each ten hexadecimal ones."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header(page: Column, url: Column, sha1: Column, n: Column, response: Column) -> Column:
    """A record's header, its closing empty line included.

    Line ends inside an address are percent-encoded; such an address also stands in a field of its own, in base64.
    """
    exact = F.when(F.coalesce(url, F.lit("")).rlike("[\r\n]"), F.concat(F.lit("X-Exact-URI: "), F.base64(url.cast("binary"))))
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = ~page.eqNullSafe(response)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(page)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.regexp_replace(exact, "[\r\n]+", ""),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(response))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(n)),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes ``pages`` to ``folder``.

    Of records with equal payloads that with the largest id is the response, the others revisit it.  Null payload is
    empty; a null id counts as smaller than any other; rows with equal ids and payloads are one record written twice.
    Copies meet in a partial aggregate before the shuffle, so a payload that a third of all pages share moves once a
    task; the join that spreads the response's id is one that Spark can split.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    hashed = base.withColumn("digest", F.unhex(F.sha2("payload", 256)))

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = pa.array([zlib.compress(x.as_py(), 4) for x in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), body], ["digest", "response", "body"])

    single = hashed.groupBy("digest").agg(F.max("page_id").alias("response"), F.first("payload").alias("payload"))
    stored = single.select("digest", "response", "payload").mapInArrow(deflate, "digest binary, response long, body binary")
    stored.write.option("compression", "none").parquet(f"{folder}/payloads")
    owners = spark.read.schema("digest binary, response long").parquet(f"{folder}/payloads")
    facts = hashed.select("page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    header = _header(F.col("page_id"), F.col("url"), F.col("sha1"), F.col("n"), F.col("response"))
    facts.join(owners, "digest").select("digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All records: ``page_id, url, record_type, refers_to, payload_digest, record_header, payload``; a null address is empty.

    Each payload's SHA-256 is computed again and must be its address; a damaged one stops the read.
    """
    headers = spark.read.schema("digest binary, header string").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest binary, body binary").parquet(f"{folder}/payloads")

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, last = [], (None, b"")
            for digest, body in zip(b.column(0), b.column(2), strict=True):
                address = digest.as_py()
                if address != last[0]:
                    payload = zlib.decompress(body.as_py())
                    if hashlib.sha256(payload).digest() != address:
                        raise ValueError(f"payload {address.hex()} is damaged")
                    last = address, payload
                out.append(last[1])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], ["header", "payload"])

    joined = headers.join(payloads, "digest").select("digest", "header", "body").mapInArrow(inflate, "header string, payload binary")
    field = lambda name: F.regexp_extract("header", rf"(?md)^{name}: (.*?)\r$", 1)
    page = lambda name: F.regexp_extract(field(name), "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return joined.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        F.when(field("X-Exact-URI") != "", F.unbase64(field("X-Exact-URI")).cast("string")).otherwise(field("WARC-Target-URI")).alias("url"),
        field("WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract("header", "(?md)^WARC-Payload-Digest: sha1:([A-Z2-7]+)\r$", 1).alias("payload_digest"),
        F.col("header").alias("record_header"),
        "payload",
    )


def records(archive: DataFrame) -> DataFrame:
    """The records as a WARC file has them: header, block (none for a revisit), two line ends."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return archive.select("*", F.concat(F.col("record_header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives all pages and returns per page what the archive says; digest and size come from the payload read back.

    ``record_sha256`` is the digest of the rebuilt record's bytes.  Null payload or address is empty; a null id counts as
    smaller than any other; rows with equal ids and payloads are one record written twice; payloads may be of any length;
    an empty table gives no rows.  Other columns are not read, so their names cannot clash.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archive(pages, folder)
    back = records(read_archive(spark, folder))
    digest, size = base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    return back.select("page_id", size, digest, "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))
