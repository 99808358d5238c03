"""Content-addressed web archive.

An archive is two tables. ``blobs`` holds every distinct payload once under its SHA-256
address; ``records`` holds the exact header block of every record and the address of its
payload. Reading joins them on the address; every payload is hashed again when it is read,
and a blob that does not match its address fails the job.

Records follow WARC 1.1: every one has a date and an id of its own, a UUID made from page_id, address,
target and copy number, so repeated rows and missing ids stay apart. The page_id itself, and that
of the response a revisit refers to, travel in extension headers.

Defined results: a null html is an empty payload, a null url gives no target header, a null
page_id sorts last; repeated rows stay separate records, of which one is the response; an
empty table gives an empty archive; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.common import new_path, utf8_bytes
from kbspark.session import salted_join

# Digits of base 32 as conv() writes them and as RFC 4648 names them.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hex digits are eight base-32 digits."""
    digest = F.sha1(payload)
    eight = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eight), CONV_DIGITS, RFC_DIGITS)


def _id(page_id: Column, url: Column, address: Column, copy: Column) -> Column:
    """Record id: a name-based UUID (version 3 layout) in angle brackets."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    h = F.md5(F.concat_ws("\n", text(page_id), text(url), address, copy.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-a"), part(18, 3),
                    F.lit("-"), part(21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def page_records(pages: DataFrame, min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """One row per page: its exact header block, and the address of its payload.

    Of the records with equal payloads of at least ``min_bytes`` bytes the first by page_id
    is the response, the others revisit it. Only digests are shuffled, and equal ones are
    combined before that. ``date`` is the time of capture, which the table does not tell.
    """
    payload = utf8_bytes("html")
    facts = pages.select(
        "page_id", F.regexp_replace("url", r"[\x00-\x1F]", "").alias("url"),
        F.sha2(payload, 256).alias("address"), F.octet_length(payload).cast("long").alias("bytes"),
        base32_sha1(payload).alias("sha1"),
    ).groupBy("page_id", "url", "address", "bytes", "sha1").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    first = facts.groupBy("address").agg(F.min(place).alias("first"))
    # one row per address, copied to every salt: pages that share a payload are dealt out
    rows = salted_join(facts, first, ["address"], "page_id").select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    revisit = (F.col("bytes") >= min_bytes) & ~((place == F.col("first")) & (F.col("copy") == 1))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _id(F.col("page_id"), F.col("url"), F.col("address"), F.col("copy"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _id(F.col("first.page_id"), F.col("first.url"), F.col("address"), F.lit(1)))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-ID", F.when(revisit, F.col("first.page_id").cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit(CRLF), http,
    )
    return rows.select(head.alias("head"), "address")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Write both tables of the archive below ``path``; each distinct payload is stored once."""
    page_records(pages, min_bytes, date).write.option("compression", "zstd").parquet(f"{path}/records")
    payload = utf8_bytes("html")
    pages.select(F.sha2(payload, 256).alias("address"), payload.alias("payload")).groupBy("address").agg(
        F.first("payload").alias("payload")
    ).write.option("compression", "zstd").parquet(f"{path}/blobs")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Payloads by verified address, with the length and digest of the bytes read."""
    found = F.sha2("payload", 256)
    verified = F.when(found == F.col("address"), found).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload at "), F.col("address"))))
    return spark.read.schema("address string, payload binary").parquet(f"{path}/blobs").select(
        verified.alias("address"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record as it was written, with its own payload: one row per archived page.

    ``record`` is the exact record (a revisit carries no payload), ``original`` the full
    response it stands for. Columns that are not asked for are pruned below the join, so a
    query for digests does not shuffle payloads.
    """
    field = lambda name, value: F.regexp_extract("head", rf"\r\n{name}: {value}\r\n", 1)
    number = lambda name: F.nullif(field(name, "(-?\\d+)"), F.lit("")).cast("long")
    heads = spark.read.schema("head string, address string").parquet(f"{path}/records").select(
        "head", "address", field("WARC-Type", "(\\w+)").alias("record_type"),
        number("X-Page-ID").alias("page_id"), number("X-Refers-To-Page-ID").alias("refers_to"))
    http = F.substring_index("head", CRLF + CRLF, -2)
    end = F.lit(CRLF + CRLF).cast("binary")
    head = F.col("head").cast("binary")
    return heads.join(read_blobs(spark, path), "address").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload",
        F.when(F.col("record_type") == "revisit", F.concat(head, end)).otherwise(
            F.concat(head, F.col("payload"), end)).alias("record"),
        F.concat(http.cast("binary"), F.col("payload")).alias("original"))


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the records back."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
