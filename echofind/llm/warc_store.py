"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables.  ``payloads`` holds the bytes of every distinct
payload once, under its SHA-256; a second, independent digest and the length are compared
before payloads of one SHA-256 count as one.  ``headers`` holds the exact header of every
record and the SHA-256 of its payload.  Records, revisits included, come back through a join.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the largest page id
is the response and the others are revisits that refer to it.

Cases: a null html is an empty payload; a null url leaves out its header line; a record with a
null page id has no page line and revisits the others of its payload, is a response if all
have none; of repeated rows with the largest id each is a response; an empty table gives an
empty archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spread
from .scratch import stored

REVISIT_BYTES = 1000
#: Copies up to this many are named to all tasks; more are joined.
BROADCAST_ROWS = 200_000
VERSION, BREAK = "WARC/1.1", "\r\n"
#: Capture time of records whose pages carry none.
DATE = "1970-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    """A header line, or none where the value is null; line breaks in a value are percent-encoded."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), text, F.lit(BREAK)), F.lit(""))


def _record_id(page: Column) -> Column:
    h = F.md5(F.coalesce(page.cast("string"), F.lit("")))  # rows that share a page id share it: they are captures of one record
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _records(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)}
    )


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as an archive at ``path``."""
    records = _records(pages)
    second = F.xxhash64("payload")
    same = (F.min(second) == F.max(second)) & (F.min("bytes") == F.max("bytes"))
    groups = records.groupBy("sha256").agg(F.max("page_id").alias("holder"), F.count("*").alias("rows"), same.alias("same"))
    checked = F.when(~F.col("same"), F.raise_error(F.lit("payloads of one digest differ"))).otherwise(F.col("sha256"))
    groups = stored(groups.select(checked.alias("sha256"), "holder", "rows"), "warc-groups")
    named, sizes = groups.select("sha256", "holder"), groups.select("sha256", "rows")

    placed = spread.joined(records.drop("payload"), named, ["sha256"], F.xxhash64("page_id", "url"), sizes)
    revisit = (F.col("bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = F.concat(
        F.lit(VERSION + BREAK),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("holder"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("X-Refers-To-Page", F.col("holder")))).otherwise(""),
        _line("X-Page", F.col("page_id")),
        _line("X-Payload-Length", F.col("bytes")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, 0).otherwise(F.col("bytes"))),
        F.lit(BREAK),
    )
    placed.select(header.alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")

    # the holder's row brings the bytes
    several = groups.where("rows > 1")
    narrow = records.select("page_id", "sha256")
    copies = spread.joined(narrow, several.select("sha256", "holder"), ["sha256"], F.col("page_id"), several.select("sha256", "rows"))
    copies = stored(copies.where(~F.col("page_id").eqNullSafe(F.col("holder"))).select("page_id", "sha256").distinct(), "warc-copies")
    repeats = pages.groupBy("page_id").count().where("count > 1").limit(1).count()
    if not repeats and copies.count() <= BROADCAST_ROWS:
        named = copies.select(F.col("page_id").alias("p"), F.col("sha256").alias("s"))
        once = records.join(F.broadcast(named), (F.col("sha256") == F.col("s")) & F.col("page_id").eqNullSafe(F.col("p")), "left_anti")
    else:  # a group of copies has one holder, so its rows spread over the tasks
        holders = groups.select(F.col("sha256").alias("s"), F.col("holder").alias("p"))
        once = records.join(holders, (F.col("sha256") == F.col("s")) & F.col("page_id").eqNullSafe(F.col("p")), "left_semi").dropDuplicates(["sha256", "page_id"])
    once.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.instr("header", f"\n{name}: ") > 0, found)


def read_archive(spark: SparkSession, path: str, page_type: str = "bigint") -> DataFrame:
    """The records of an archive: ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, header, payload``.

    Every payload is verified, once, against its SHA-256, and its SHA-1 and length against every
    record; a mismatch fails the query.
    """
    headers = spark.read.schema("header string, sha256 string").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    own = F.when(F.sha2("payload", 256) == F.col("sha256"), F.sha1("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    payloads = payloads.select("sha256", own.alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), "payload")
    records = headers.select(
        _field("X-Page").cast(page_type).alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        _field("X-Refers-To-Page").cast(page_type).alias("refers_to"),
        F.substring(_field("WARC-Payload-Digest"), 6, 40).alias("payload_digest"),
        _field("X-Payload-Length").cast("long").alias("payload_bytes"),
        "header",
        "sha256",
    )
    found = spread.joined(records, payloads, ["sha256"], F.xxhash64("header"), headers.groupBy("sha256").agg(F.count("*").alias("rows")))
    good = (F.col("sha1") == F.col("payload_digest")) & (F.col("bytes") == F.col("payload_bytes"))
    checked = F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not match its record")))
    return found.withColumn("payload_digest", checked).select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "header", "payload")


def record_text(records: DataFrame) -> DataFrame:
    """The records as they stand in a WARC file, one string each; revisits have no block."""
    block = F.when(F.col("record_type") == "revisit", "").otherwise(F.decode("payload", "UTF-8"))
    return records.select("page_id", F.concat("header", block, F.lit(BREAK + BREAK)).alias("record"))


def export_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one per partition."""
    # the writer ends each row with a line feed, the last byte of a record
    record_text(records).select(F.expr("substring(record, 1, length(record) - 1)").alias("value")).write.text(path)
