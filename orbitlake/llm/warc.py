"""WARC archives: written as request, response or revisit, and metadata records; read back and assembled.

A capture is a transaction of several records that name each other through ``WARC-Concurrent-To``. Records are built
from column expressions and written by Spark's text writer, whose line separator is the two line ends that close a
record. Reading streams every archive through one parser that trusts nothing but ``Content-Length``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.workspace import write_through

# Fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_DIGITS_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "path string, position long, type string, record_id string, headers map<string,string>, "
    "payload binary, payload_bytes long, payload_digest string"
)
BATCH_BYTES = 8 << 20


# --- writing -----------------------------------------------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column: 20 bits, so 4 digits, at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX_DIGITS_32, BASE32)


def _urn(*parts: Column) -> Column:
    """A record id that only depends on the parts."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column, record_id: Column, content: Column, content_type: str, *more: tuple[str, Column]) -> Column:
    """One record without the line ends that close it; headers with null values are left out."""
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", F.lit(DATE)),
        *more,
        ("Content-Type", F.lit(content_type)),
        ("Content-Length", F.octet_length(content).cast("string")),
    ]
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in headers]
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines), F.lit("\r\n\r\n"), content)


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """Adds payload, digest, and first_id: the least id among rows of an equal payload of at least ``least_bytes``
    bytes (null for shorter ones)."""
    pages = pages.select("*", F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("_payload"))
    pages = pages.withColumn("_digest", base32_sha1(F.col("_payload")))
    long_enough = F.octet_length("_payload") >= least_bytes
    firsts = pages.where(long_enough).groupBy(F.col("_digest").alias("_d")).agg(F.min(id_col).alias("_first_id"))
    # written, so that the join below is one over plain tables, whose hot digests Spark can split
    return pages.join(write_through(firsts, "payload-firsts"), long_enough & (F.col("_digest") == F.col("_d")), "left").drop("_d")


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit_bytes: int = 0
) -> None:
    """Write every row as a request, a response or revisit, and a metadata record into gzipped archives below ``path``.

    The payload is the text in UTF-8, empty for null. Of rows with equal payloads of at least ``least_revisit_bytes``
    bytes the one with the least id is the response, the others are revisits of it; rows that repeat an id with the
    same payload are equal records. Null ids come after all others. Null urls are named after the id.
    """
    rows = with_revisits(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")), "id", "html", least_revisit_bytes)
    is_response = F.col("_first_id").isNull() | F.col("id").eqNullSafe(F.col("_first_id"))
    kind = F.when(is_response, "response").otherwise("revisit")
    own = _urn(F.col("id"), F.col("_digest"), kind)
    first = F.when(~is_response, _urn(F.col("_first_id"), F.col("_digest"), F.lit("response")))
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), "[\r\n]+", " ")
    length = F.octet_length("_payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    request = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n"))
    fields = F.concat(F.lit("id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n"))
    target, together = ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own)
    capture = _record(
        kind,
        own,
        F.when(is_response, F.concat(http, F.col("_payload"))).otherwise(http),
        "application/http;msgtype=response",
        target,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        ("WARC-Refers-To", first),
        ("WARC-Profile", F.when(~is_response, REVISIT_PROFILE)),
    )
    others = (
        _record(F.lit("request"), _urn(own, F.lit("request")), request, "application/http;msgtype=request", target, together),
        _record(F.lit("metadata"), _urn(own, F.lit("metadata")), fields, "application/warc-fields", target, together),
    )
    records = rows.select(F.explode(F.array(others[0], capture, others[1])).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


# --- reading -----------------------------------------------------------------------------------------------------------


class Damaged(Exception):
    """An archive that ends early or breaks the format."""


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged(f"no header: {line[:40]!r}")
        found[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return found


def records_of(archive: bytes):
    """(position in the unpacked archive, headers, content) of every record."""
    stream = io.BytesIO(archive)
    if archive[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18)
    position = 0
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            position += len(line)
            continue
        if not line.startswith(b"WARC/"):
            raise Damaged(f"no record at {position}")
        headers = _headers(stream)
        length = headers.get("content-length", "")
        if not length.isdigit():
            raise Damaged(f"no length at {position}")
        content = stream.read(int(length))
        if len(content) < int(length):
            raise Damaged(f"cut short at {position}")
        yield position, headers, content
        position = stream.tell()


def _payload(headers: dict[str, str], content: bytes) -> tuple[bytes, int]:
    """The payload and its full length, which a revisit only states in the response's own header."""
    if not headers.get("content-type", "").startswith("application/http"):
        return content, len(content)
    head, end, body = content.partition(b"\r\n\r\n")
    if headers.get("warc-type") != "revisit":
        return body if end else content, len(body if end else content)
    stated = [v for n, _, v in (line.partition(b":") for line in head.split(b"\r\n")) if n.strip().lower() == b"content-length"]
    return b"", int(stated[0]) if stated and stated[0].strip().isdigit() else 0


def _parsed(batches):
    for batch in batches:
        for path, archive in zip(batch["path"].to_pylist(), batch["content"]):
            rows, size = [], 0
            try:
                for position, headers, content in records_of(archive.as_py()):
                    payload, length = _payload(headers, content)
                    kind = headers.get("warc-type", "")
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if kind == "revisit":  # without a body of its own it has the digest it states
                        digest = headers.get("warc-payload-digest", "").rpartition(":")[2]
                    rows.append((path, position, kind, headers.get("warc-record-id"), list(headers.items()), payload, length, digest))
                    size += len(payload)
                    if size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            except (Damaged, EOFError, OSError, zlib.error) as error:
                rows.append((path, -1, "damaged", None, [("reason", str(error))], b"", 0, None))
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]
    names = ["path", "position", "type", "record_id", "headers", "payload", "payload_bytes", "payload_digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, gzipped or not: path, position, type, record_id, headers (lower-case
    names), payload, payload_bytes and payload_digest (base32 SHA-1). A damaged archive gives its records up to the
    damage and one of type ``damaged`` with the reason. An archive is unpacked by one task as a stream."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_parsed, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: the record itself, and the request and metadata record of the same
    transaction, null where the archives hold none; of several, the one of least record id."""
    linked = F.col("headers").getItem("warc-concurrent-to")
    heads = records.where(F.col("type").isin("response", "revisit"))
    found = heads.select(
        "record_id",
        F.col("headers").getItem("warc-refers-to").alias("refers_to"),
        F.struct("type", F.col("headers").getItem("warc-target-uri").alias("uri"), "payload", "payload_bytes", "payload_digest").alias("response"),
    )
    for kind in ("request", "metadata"):
        own = records.where(F.col("type") == kind).select(linked.alias("_to"), F.struct("record_id", "payload").alias(kind))
        found = found.join(own.groupBy("_to").agg(F.min(kind).alias(kind)), F.col("record_id") == F.col("_to"), "left").drop("_to")
    return found
