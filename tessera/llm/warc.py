"""A content-addressed web archive.

Method: each payload's bytes are stored once, under their SHA-256, and checked against it whenever they are read; the exact record headers are
kept apart, in a narrow table; original records come back by joining the two on the digest.

Defined results: null html is an empty payload; a null url is written as `-`; a null page_id comes last among equals; of repeated rows
one is the response and the others revisit it; an empty table gives an empty archive; other columns are not read. Line ends in a url are percent-encoded, so that no header can be forged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, sha256 string, header binary"
PAYLOADS = "sha256 string, payload binary"


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1: twenty bits, so five hex digits, are four letters."""
    h = F.sha1(payload)
    number = lambda k: F.conv(F.substring(h, F.floor(k / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda k: F.substring(F.lit(ALPHABET), (F.floor(number(k) / F.pow(F.lit(2), 15 - 5 * (k % 4))) % 32 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _payload() -> F.Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def _http(n: F.Column) -> F.Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes path/records and path/payloads. Of records with equal payloads of at least `least` bytes the first page's is a response. `date` is when the
    pages were captured, which every record has to state; nothing here reads the clock."""
    payload = _payload()
    page = F.col("page_id").cast("long")
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("-")), "\r", "%0D"), "\n", "%0A")
    known = common.save(
        pages.select(page.alias("page_id"), url.alias("url"), F.sha2(payload, 256).alias("sha256"), base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n"))
        .withColumn("record", F.monotonically_increasing_id())
    )
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record")).alias("first")
    leaders = common.save(known.groupBy("sha256").agg(first).select("sha256", "first.page_id", "first.record"))
    r = known.join(leaders.select("sha256", F.col("page_id").alias("_leader"), F.col("record").alias("_record")), "sha256")
    own = (F.col("n") < least) | (F.col("record") == F.col("_record"))
    name = lambda page, record: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("-")), F.lit(":"), record.cast("string"), F.lit(">"))
    length = F.octet_length(_http(F.col("n").cast("string"))) + F.when(own, F.col("n")).otherwise(0)
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(own, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: "), name(F.col("page_id"), F.col("record")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(~own, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("_leader"), F.col("_record")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), _http(F.col("n").cast("string")),
    )
    r.select("page_id", "sha256", header.cast("binary").alias("header")).write.parquet(f"{path}/records")
    # A payload travels with its page, so copies of one payload do not meet in one task; only the leader's is kept.
    held = pages.select(page.alias("page_id"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    lead = leaders.select("sha256", F.coalesce("page_id", F.lit(-1)).alias("_key"), F.col("page_id").isNull().alias("_none"))
    held = held.select("sha256", F.coalesce("page_id", F.lit(-1)).alias("_key"), F.col("page_id").isNull().alias("_none"), "payload")
    held.join(lead, ["sha256", "_key", "_none"], "left_semi").dropDuplicates(["sha256", "_key", "_none"]).select("sha256", "payload").write.parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload, and the payload's own bytes and digest as read; a payload that doesn't match its address raises an error."""
    read = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("sha256"))))
    return read.withColumn("payload", sound).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: its exact header, its fields, and its payload joined by digest (only read where it is used)."""
    text = F.col("header").cast("string")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    number = lambda name: F.nullif(F.regexp_extract(field(name), r"^<urn:page:(-|-?\d+):", 1), F.lit("-")).cast("long")
    records = spark.read.schema(RECORDS).parquet(f"{path}/records").select(
        number("WARC-Record-ID").alias("page_id"), "sha256", "header", field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("url"),
        F.replace(field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("_digest"), number("WARC-Refers-To").alias("refers_to"),
    )
    first = F.regexp_extract(text, r"WARC-Type: ([^\r\n]*)", 1)
    joined = records.withColumn("record_type", first).join(payloads(spark, path), "sha256")
    same = F.when(F.col("_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's digest differs from its payload's")))
    return joined.withColumn("payload_digest", same).drop("_digest")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records' bytes: header, the payload of a response, and the closing line ends."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read_archive(spark, path).select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))
