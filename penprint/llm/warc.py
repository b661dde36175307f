"""WARC archives with revisit records for repeated payloads.

Headers (id, digest, length) are grouped by payload digest with partial sums before the shuffle; of equal
payloads the record of the largest id is the response, and the others become revisit records that refer to it.
The table of repeated digests and the headers meet in an equi-join of two tables, which Spark can split where a
payload is shared by a large part of all records. Payloads move once, by id, to the file they are written to.

Archives are written by Spark's text writer (a record's bytes are UTF-8, and the blank lines after a record are
the line separator), so they lie in any store that Spark writes to, in files of about FILE_BYTES, one gzip
member each. A task writes TASK_BYTES, and more than that where MOST_TASKS of them wouldn't do. They are read back with Spark's binary reader and parsed by Content-Length; digests are computed anew.

Defined results: a null payload is empty; a null id is always a response; rows of one id and payload have one
verdict each, and rows of one id with two payloads have the verdict of each payload; equal ids of one payload are all responses if
they are its largest; a null url has no WARC-Target-URI; control characters in a url are percent-encoded; a page larger than
a file has a file of its own; other columns aren't written, so none can clash; empty tables give no archive and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm.common import tidy, written

FILE_BYTES, TASK_BYTES, MOST_TASKS = 16 << 20, 64 << 20, 1 << 15
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits, eight letters each."""
    digits = F.sha1(data)
    letters = []
    for group in range(4):
        value = F.conv(F.substring(digits, 10 * group + 1, 10), 16, 10).cast("bigint")
        letters += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*letters)


def resolved(headers: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_digest, refers_to of the revisits. headers: a table of page_id, payload_digest, payload_bytes."""
    same = headers.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    repeated = written(same.filter("n > 1").select(F.col("payload_digest").alias("_digest"), "original"), "repeated")
    met = headers.filter(F.col("payload_bytes") >= least).join(repeated, F.col("payload_digest") == F.col("_digest"))
    return met.filter("page_id < original").select("page_id", "payload_digest", F.col("original").alias("refers_to")).distinct()


def record(page_id: Column, url: Column, payload: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    """The text of a WARC record without the blank lines that end it."""
    revisit = refers_to.isNotNull()
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    urn = lambda i: F.concat(F.lit(f"<{URN}"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    clean = F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    safe = F.when(F.rlike(url, F.lit("[\r\n]")), clean).otherwise(url)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", urn(page_id)),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(refers_to)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Archives of all pages under path; equal payloads of at least ``least`` bytes are written once."""
    body = F.coalesce(F.col(html), F.lit(""))
    whole = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    described = whole.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    headers = written(described.select("page_id", "payload_digest", "payload_bytes"), "headers")
    n, total = headers.agg(F.count(F.lit(1)), F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()
    revisits = written(resolved(headers, least).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to"), "revisits")
    tasks = min(MOST_TASKS, max(1, -(-total // max(file_bytes, min(TASK_BYTES, 4 * file_bytes)))))
    # An id may have two payloads, of which one is a revisit.
    dealt = described.repartition(tasks, "page_id", "payload_digest")
    placed = dealt.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    lines = placed.select(record(*(F.col(c) for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to"))).alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, n * file_bytes // max(1, total))).text(path)


def parsed(data: bytes) -> Iterator[dict]:
    """Records of an archive's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block)
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record doesn't end at byte {at}")
        at += 4
        http, payload = block.split(b"\r\n\r\n", 1)
        size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        response = head["WARC-Type"] == "response"
        if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} isn't what its header says")
        number = lambda urn: None if urn is None or urn.endswith(":null>") else int(urn[len(URN) + 1 : -1])
        yield {
            "page_id": number(head["WARC-Record-ID"]),
            "url": head.get("WARC-Target-URI"),
            "record_type": head["WARC-Type"],
            "refers_to": number(head.get("WARC-Refers-To")),
            "payload_bytes": size,
            "payload_digest": digest,
            "payload": payload if response else None,
        }


def _record_batches(payloads: bool):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
    schema = pa.schema(list(kinds.items()))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = parsed(gzip.decompress(content.as_py()))
                yield pa.RecordBatch.from_pylist([r if payloads else r | {"payload": None} for r in rows], schema)

    return records


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of archives under path; without payloads, they are checked but not returned."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(tidy(_record_batches(payloads)), RECORDS)
