"""Archives written and read back, and records as other writers make them."""

import base64
import gzip
import hashlib

import pytest

from orbitlake.llm import queries, warc
from orbitlake.workspace import fresh_path

PAGES = [
    (1, "http://a", "<p>one</p>"),
    (2, "http://b", "<p>one</p>"),
    (3, "http://c", None),
    (4, None, ""),
    (5, "http://e\r\nWARC-Type: evil", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
    (6, "http://f", "ümläut 日本\n"),
    (7, "http://g", "y" * 300_000),
    (None, "http://h", "alone"),
    (None, "http://i", "<p>one</p>"),
    (1, "http://a", "<p>one</p>"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, _, html in pages:
        payload = html or ""
        own = len(payload.encode()) < least or first.get(payload, i) == i
        yield i, len(payload.encode()), digest(html), "response" if own else "revisit", None if own else first[payload]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages.selectExpr("*", "1 as id", "'x' as payload", "2 as _digest").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op6_warc(spark, str(tmp_path)).collect()
    assert sorted(map(repr, expected(PAGES))) == sorted(repr(tuple(r)) for r in got)


def test_payloads_come_back_whole(spark):
    pages = spark.createDataFrame(PAGES[:7], "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_warc(pages, path, least_revisit_bytes=5000)
    found = warc.captures(warc.read_warc(spark, path)).collect()
    assert sorted(r.response.payload.decode() for r in found) == sorted(p[2] or "" for p in PAGES[:7])
    assert all(r.response.type == "response" and r.request.payload is not None and r.metadata.payload.startswith(b"id: ") for r in found)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op6_warc(spark, str(tmp_path)).count() == 0


def record(kind, name, content, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"Content-Length: {len(content)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    response = record("response", "r1", http, Content_Type="application/http")
    parts = [record("warcinfo", "i", b"software: x\r\n"), record("request", "q1", b"GET /", warc_concurrent_to="<r1>"), response]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))  # a member per record
    (tmp_path / "plain.warc").write_bytes(record("response", "r2", http, Content_Type="application/http"))
    whole = gzip.compress(b"".join(parts) * 50)
    (tmp_path / "cut.warc.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "noise.warc").write_bytes(b"hello")
    (tmp_path / "short.warc").write_bytes(response[:-20])
    (tmp_path / "empty.warc").write_bytes(b"")
    records = warc.read_warc(spark, str(tmp_path))
    by_file = {}
    for r in records.collect():
        by_file.setdefault(r.path.rsplit("/", 1)[1], []).append(r.type)
    assert by_file["members.warc.gz"] == ["warcinfo", "request", "response"] and by_file["plain.warc"] == ["response"]
    assert all(by_file[f][-1] == "damaged" for f in ("cut.warc.gz", "noise.warc", "short.warc")) and "empty.warc" not in by_file
    found = {r.record_id: r for r in warc.captures(records.where("path like '%members%' or path like '%plain%'")).collect()}
    assert found["<r1>"].request.payload == b"GET /" and found["<r2>"].request is None
    assert bytes(found["<r1>"].response.payload) == b"body"


@pytest.mark.parametrize("text", ["", "a", "é" * 100])
def test_base32(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(warc.base32_sha1("t")).first()[0]
    assert got == digest(text)
