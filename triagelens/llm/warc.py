"""WARC archives with revisit records.

Writing: every page is one record. Pages with equal payloads of at least
``MIN_REVISIT`` bytes share the record of the one with the largest id: it is written as
``response``, the others as ``revisit`` records that carry headers only. Which is which
is decided on headers alone: digests are shuffled, payloads are not moved by digest.

Archives are gzip files of a bounded number of records.

Reading: Spark's text reader streams the files and splits them at record starts. A
record's start is recognised by its version line together with
the id of the archive set, a random UUID that no payload can contain. Record heads are
parsed, payloads are cut by their content length, and revisits are joined, by payload
digest, to the response they refer to.

Deduplicating archives is reading, deciding anew which records are revisits, and
writing with fresh headers.

Defined results: a null payload is empty; a null or odd address is written with
everything but visible ASCII percent-encoded; of equal payloads whose ids are all null
none is a revisit, and rows that repeat the largest id are all responses; repeated rows
are records of their own; an empty table gives an archive without records and an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.llm.common import shared_folder, written

MIN_REVISIT = 1000  # bytes
RECORDS_PER_FILE = 50_000  # a compressed file is read by one task, record by record
CRLF = "\r\n"
BREAK = CRLF + CRLF
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def heads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, payload`` of every row."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
        payload.alias("payload"),
    )


def decide(records: DataFrame) -> DataFrame:
    """``page_id, payload_digest, refers_to`` of the records that are revisits."""
    large = records.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest")
    original = (
        large.groupBy("payload_digest")
        .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least"), F.count("*").alias("_n"), F.count("page_id").alias("_known"))
        .where("_n > 1 and _known > 0 and (_least < refers_to or _known < _n)")
        .select("payload_digest", "refers_to")
    )
    return large.join(original, "payload_digest").where("not page_id <=> refers_to").distinct()


def record_id(page_id: Column, digest: Column, archive: str) -> Column:
    """A record's id, made from what identifies the page within the archive set."""
    h = F.md5(F.concat_ws("/", F.lit(archive), F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """A header line, empty if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def uri(url: Column) -> Column:
    """``url`` with all but visible ASCII percent-encoded, so that it fits one line."""
    out = F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
    for mark in "/:?=&#@,":
        out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return out


def first_lines(archive: str) -> str:
    return f"{VERSION}{CRLF}WARC-Warcinfo-ID: <urn:uuid:{archive}>{CRLF}"


def record_text(archive: str, now: str = DATE) -> Column:
    """The record of a row of ``heads`` with ``refers_to`` (null: a response)."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        header("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(CRLF),
    )
    digest = F.col("payload_digest")
    return F.concat(
        F.lit(first_lines(archive)),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", record_id(F.col("page_id"), digest, archive)),
        header("WARC-Date", F.lit(now)),
        header("WARC-Target-URI", uri(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), digest, archive))),
        header("X-Page-ID", F.col("page_id").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        header("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit(CRLF),
        http,
        body,
    )


def write_archives(records: DataFrame, path: str, now: str = DATE) -> str:
    """Writes rows of ``heads`` as archives below ``path``; the id of the archive set.

    Only digests and ids are shuffled to find the revisits; payloads move once, by page.
    """
    archive = str(uuid.uuid4())
    revisits = decide(records.drop("payload")).select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to")
    marked = records.join(revisits, F.expr("page_id <=> _id and payload_digest = _digest"), "left")
    lines = marked.select(record_text(archive, now).alias("value"))
    writer = lines.write.option("lineSep", BREAK).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return archive


def read_archives(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Records: ``page_id, url, record_type, payload_digest, payload``.

    The payload of a revisit is null.
    """
    # A line break before the separator would be ambiguous: records end in one themselves,
    # and where the line reader refills its buffer it does not go back into the old one to
    # match anew. The bytes before a start are a break, which the start does not contain,
    # so no earlier match can run into it. Content lengths cut the break off.
    raw = spark.read.option("lineSep", first_lines(archive)).text(path).where(F.length("value") > 0)
    # Everything before the body of the HTTP response is ASCII, so positions in the text are
    # positions in the bytes.
    split = raw.select(F.col("value").alias("text")).withColumn("cut", F.locate(BREAK, F.col("text")))
    rows = split.select(
        F.concat(F.lit("\n"), F.substring(F.col("text"), F.lit(1), F.col("cut") + 1)).alias("head"),
        F.expr("substring(text, cut + 4)").alias("rest"),
    )

    def field(name: str) -> Column:
        found = F.regexp_extract("head", rf"\n{name}: ([^\r]*)", 1)
        return F.when(found != "", found)

    body_at = F.locate(BREAK, F.col("rest")) + 4
    body = F.substring(F.col("rest").cast("binary"), body_at, field("Content-Length").cast("int") - body_at + 1)
    return rows.select(
        field("X-Page-ID").cast("long").alias("page_id"),
        F.url_decode(field("WARC-Target-URI")).alias("url"),
        field("WARC-Type").alias("record_type"),
        F.substring(field("WARC-Payload-Digest"), 6, 40).alias("payload_digest"),
        F.when(field("WARC-Type") == "response", body).alias("payload"),
    )


def resolve(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    Bytes and digest of responses are taken from the payload that was read; revisits
    get those of the response with their digest.
    """
    heads_only = records.select(
        "page_id",
        "record_type",
        F.octet_length("payload").cast("long").alias("_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
    )
    heads_only = written(heads_only, "warc-heads")
    responses = heads_only.where("record_type = 'response'").where(F.col("_bytes") >= MIN_REVISIT)
    originals = responses.groupBy("payload_digest").agg(F.max("page_id").alias("_original"), F.first("_bytes").alias("_full"))
    whole = heads_only.where("record_type = 'response'").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    revisits = heads_only.where("record_type = 'revisit'").drop("_bytes").join(originals, "payload_digest", "left")
    return whole.unionByName(
        revisits.select("page_id", F.col("_full").alias("payload_bytes"), "payload_digest", "record_type", F.col("_original").alias("refers_to"))
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as deduplicated archives and reads them back, revisits resolved."""
    path = shared_folder(spark, "warc")
    archive = write_archives(heads(pages), path)
    return resolve(read_archives(spark, path, archive))


def deduplicate(spark: SparkSession, path: str, archive: str, out: str) -> str:
    """Reads archives, decides anew which records are revisits, writes them with fresh
    headers below ``out``; the new archive id.

    A payload moves by digest only where its new response was a revisit before.
    """
    records = read_archives(spark, path, archive)
    known = records.where("payload is not null").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    sizes = known.groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    referring = records.where("payload is null").join(sizes, "payload_digest")
    rows = known.unionByName(referring.select(known.columns))
    revisits = decide(rows.select("page_id", "payload_digest", "payload_bytes"))
    bare = referring.drop("payload").join(revisits, ["page_id", "payload_digest"], "left_anti")
    lent = known.select("payload_digest", "payload").join(bare.select("payload_digest").distinct(), "payload_digest", "left_semi")
    lent = lent.groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    still = referring.join(revisits, ["page_id", "payload_digest"], "left_semi")
    full = known.unionByName(still.select(known.columns)).unionByName(bare.join(lent, "payload_digest").select(known.columns))
    return write_archives(full.withColumn("payload", F.col("payload").cast("string")), out)
