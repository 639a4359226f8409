"""Content-addressed WARC archive.

A record is its exact header bytes and its payload. Payload bytes are stored once per strong digest (SHA-256), each deflated by itself as
in a compressed WARC file; headers are stored for every record with the digest of their payload; the original record is header + payload + CRLF CRLF, rebuilt by joining the two on the digest.

Of records with equal payloads of ``min_bytes`` or more, the one with the largest id is a ``response`` and the others are ``revisit``
records that refer to it; smaller payloads are all ``response``. The ``WARC-Payload-Digest`` of a header is the base-32 SHA-1 that the
format prescribes. Digests are verified when stored (one length and one check sum per digest) and again when read (length, SHA-1, SHA-256);
a mismatch fails the job.

Defined cases: a null html is an empty payload; a null url gives an empty target; repeated page ids make records of their own that share a
record id, and copies with one page id refer to that id; an empty table makes an empty archive; other columns are ignored.

Plan: deciding who responds is a partial aggregate by digest, so a hot payload shuffles one row per task. Equal digests are equal bytes, so
any copy can be stored: every batch deflates each digest once, and a partial aggregate sends one deflated payload per digest and task.
Reading joins headers to deflated payloads by digest: Spark splits a hot digest's headers, which are small, and a payload is copied only
to records that ask for it, where it is inflated. Nothing is broadcast by choice, and the plan is the same at every size.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.llm.storage import shared_dir

MIN_BYTES = 1000
SLICE_BYTES = 16 << 20
CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(hex_digest: Column) -> Column:
    """The 32 base-32 characters of a SHA-1 given in hex: 4 blocks of 10 hex digits, 40 bits, 8 characters each."""
    out = []
    for k in range(4):
        block = F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 10).cast("long")
        for j in range(8):
            index = F.shiftright(block, 35 - 5 * j).bitwiseAND(F.lit(31))
            out.append(F.substring(F.lit(BASE32), (index + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def record_id(page: Column) -> Column:
    """A urn:uuid made of the first 128 bits of a digest of the page id, so that reruns give the same records."""
    h = F.sha2(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _headers(pages: DataFrame) -> DataFrame:
    """The exact header bytes of every record: WARC header block, then for a response the HTTP header that begins its block."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    response = F.col("refers_to").isNull()
    fields = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {EPOCH}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("sha1"))),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.length(http) + F.when(response, F.col("payload_bytes")).otherwise(F.lit(0))).cast("string")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(~response, F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string"))),
    ]
    return pages.withColumn("header", F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF * 2), http).cast("binary"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write ``path/payloads`` (digest, packed; one row per digest) and ``path/headers`` (page_id, header, digest, stored)."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    slim = base.select("page_id", "url", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.crc32("payload").alias("crc"))
    facts = f"{path}/facts"
    slim.write.parquet(facts)
    slim = pages.sparkSession.read.parquet(facts)
    owners = slim.groupBy("digest").agg(F.max("page_id").alias("owner"), F.min("crc").alias("c0"), F.max("crc").alias("c1"), F.min("payload_bytes").alias("n0"), F.max("payload_bytes").alias("n1"))
    verified = F.when((F.col("c0") == F.col("c1")) & (F.col("n0") == F.col("n1")), F.col("owner")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("long"))
    owners = owners.select("digest", F.when(F.col("n0") >= 0, verified).alias("owner"))
    joined = slim.join(owners, "digest")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    _headers(joined.withColumn("refers_to", F.when(revisit, F.col("owner")))).select("page_id", "header", "digest", "payload_bytes").write.parquet(f"{path}/headers")
    packed = base.select(F.sha2("payload", 256).alias("digest"), "payload").mapInArrow(_deflate, PACKED)
    packed.dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")


PACKED = "digest string, packed binary"
RECORD = "header binary, digest string, payload binary"


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``digest, packed``: the first payload of each digest in a batch, deflated."""
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        first = {d: i for i, d in reversed(list(enumerate(digests)))}
        payloads = batch.column("payload")
        packed = [zlib.compress(payloads[i].as_py()) for i in first.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array(packed, pa.binary())], ["digest", "packed"])


def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``header, digest, payload`` of headers joined to their deflated payloads, in slices of about ``SLICE_BYTES``; a missing payload stays null."""
    for batch in batches:
        header, digest = batch.column("header").cast(pa.binary()), batch.column("digest").cast(pa.string())
        begin, held, payloads = 0, 0, []
        for i, packed in enumerate(batch.column("packed")):
            payloads.append(None if not packed.is_valid else zlib.decompress(packed.as_py()))
            held += len(payloads[-1] or b"")
            if held >= SLICE_BYTES or i + 1 == batch.num_rows:
                n = len(payloads)
                yield pa.RecordBatch.from_arrays([header.slice(begin, n), digest.slice(begin, n), pa.array(payloads, pa.binary())], ["header", "digest", "payload"])
                begin, held, payloads = i + 1, 0, []


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``header, digest, payload, record``: every record as it was, rebuilt and verified. A revisit's record ends with its header."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    both = headers.select("header", "digest").join(payloads, "digest", "left").select("header", "digest", "packed").mapInArrow(_inflate, RECORD)
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is missing or does not match its digest")).cast("binary"))
    both = both.withColumn("payload", checked)
    return both.withColumn("_revisit", F.col("header").cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}"))


def record_bytes(records: DataFrame) -> Column:
    """The bytes of a WARC record as they stand in a file."""
    return F.concat("header", F.when(F.col("_revisit"), F.lit("").cast("binary")).otherwise(F.col("payload")), F.lit(CRLF * 2).cast("binary"))


def parse_records(records: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` from rebuilt records; lengths and digests are verified."""
    head = F.split(F.col("header").cast("string"), CRLF * 2)
    fields = F.str_to_map(F.regexp_replace(F.get(head, 0), f"^{VERSION}{CRLF}", ""), F.lit(CRLF), F.lit(": "))
    r = records.withColumn("_f", fields).withColumn("_http", F.str_to_map(F.regexp_replace(F.get(head, 1), f"^HTTP/1.1 200 OK{CRLF}", ""), F.lit(CRLF), F.lit(": ")))
    r = r.withColumn("_n", F.length("payload").cast("long")).withColumn("_sha1", F.sha1("payload"))
    http_bytes = F.length(F.get(head, 1)) + 4
    ok = (F.col("_http")["Content-Length"].cast("long") == F.col("_n")) & (F.concat(F.lit("sha1:"), base32_sha1(F.col("_sha1"))) == F.col("_f")["WARC-Payload-Digest"])
    ok = ok & (F.col("_f")["Content-Length"].cast("long") == http_bytes + F.when(F.col("_revisit"), F.lit(0)).otherwise(F.col("_n")))
    digest = F.when(ok, F.col("_sha1")).otherwise(F.raise_error(F.lit("a record does not match its header")).cast("string"))
    number = lambda k: F.when(F.col("_f")[k] != "", F.col("_f")[k].cast("long"))
    return r.select(number("X-Page-ID").alias("page_id"), F.col("_f")["WARC-Target-URI"].alias("url"), F.col("_n").alias("payload_bytes"), digest.alias("payload_digest"), F.col("_f")["WARC-Type"].alias("record_type"), number("X-Refers-To-Page").alias("refers_to"))


def export_files(records: DataFrame, path: str) -> None:
    """Plain WARC files for other tools: text files whose line separator is the end mark of a record."""
    block = F.concat(F.col("header").cast("string"), F.when(F.col("_revisit"), F.lit("")).otherwise(F.col("payload").cast("string")))
    records.select(block.alias("value")).write.option("lineSep", CRLF * 2).text(path)


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive of ``pages`` and read every record back from it."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return parse_records(read_records(spark, path))
