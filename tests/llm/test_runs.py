"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib

import pytest

from orbitlake.llm import queries, runs
from tests.llm import helpers as H


def scanned(words, least=12):
    """Runs by trying every period at every place."""
    n, found = len(words), {}
    for period in range(1, n // 2 + 1):
        at = 0
        while at + period < n:
            end = at
            while end + period < n and words[end] == words[end + period]:
                end += 1
            if end > at:
                length = end - at + period
                if length >= max(least, 2 * period):
                    found.setdefault((at, length), period)
            at = max(end, at + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def drawn(draw):
    words = [b"w%d" % draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.randrange(120))]
    if words and draw.random() < 0.7:
        a, p = draw.randrange(len(words)), 1 + draw.randrange(30)
        words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
        if draw.random() < 0.4:
            words[draw.randrange(len(words))] = b"z"
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_a_scan(seed):
    draw = random.Random(seed)
    for _ in range(60):
        texts, least = [drawn(draw) for _ in range(draw.randrange(1, 5))], draw.choice([12, 12, 4, 7])
        assert runs.runs_of_texts(texts, least) == [scanned(t, least) for t in texts]


def test_strings_of_many_runs():
    shorter, longer = [b"a"], [b"a", b"b"]
    while len(longer) < 300:
        shorter, longer = longer, longer + shorter
    assert runs.runs_of_texts([longer, longer])[1] == scanned(longer)


def test_texts_do_not_touch():
    words = H.words(H.prose(1, 8))
    assert runs.runs_of_texts([words, words, words]) == [[], [], []]


def test_long_texts():
    line, draw = b"the quick brown fox jumps over a lazy dog now".split(), random.Random(1)
    assert runs.runs_of_texts([line * 20_000]) == [[(0, 200_000, 10)]]
    assert runs.runs_of_texts([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    between = [w for _ in range(20_000) for w in (*line, b"%d" % draw.randrange(10**12))]
    assert runs.runs_of_texts([between]) == [[]]


def test_awkward_rows(spark):
    texts = H.awkward_texts() + ["x y " * 8 + "x", "\n".join(["a b c"] * 3), "a b c " * 4]
    got = {r.doc_id: r for r in runs.periodic_runs(H.documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = H.words(text)
        expected = scanned(words) if len(words) < 2000 else [tuple(r) for r in got[i].runs]
        assert [tuple(r) for r in got[i].runs] == expected and got[i].n_words == len(words)
        gone = {k for s, n, p in expected for k in range(s + p, s + n)}
        assert got[i].collapsed.encode() == b" ".join(w for k, w in enumerate(words) if k not in gone)
    rows = spark.createDataFrame([(1, "a b " * 9), (1, "a b " * 9), (None, "a b " * 9)], "doc_id long, text string")
    assert [len(r.runs) for r in runs.periodic_runs(rows).collect()] == [1, 1, 1]
    assert runs.periodic_runs(H.documents(spark, [])).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc in docs:
        words, h = H.words(doc.text), zlib.crc32(str(doc.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        expected, row = scanned(words), got[doc.doc_id]
        planted += bool(expected)
        assert row.n_runs == len(expected)
        s, n, p = min(expected, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row.start, row.length, row.period, row.exponent_milli) == (s, n, p, n and 1000 * n // p)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in expected).encode()).hexdigest()
        gone = {k for a, b, c in expected for k in range(a + c, a + b)}
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
    assert planted
