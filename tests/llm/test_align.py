"""Alignment against sets of ends, and counts over the whole corpus."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orbitlake.llm import align, bpe, queries
from tests.llm import helpers as H


@pytest.mark.parametrize("lane", [1, 7, 512])
@pytest.mark.parametrize("seed", range(3))
def test_common_ends(seed, lane, monkeypatch):
    monkeypatch.setattr(align, "LANE", lane)
    draw = random.Random(seed)
    for _ in range(200):
        n = draw.randrange(1, 400)
        share = draw.choice([0.1, 0.5, 0.95, 1])
        a, b = (np.array(sorted({n, *(i for i in range(1, n) if draw.random() < share)})) for _ in range(2))
        in_a, in_b = align.common_ends(a, b)
        common = np.intersect1d(a, b)
        assert a[in_a].tolist() == common.tolist() == b[in_b].tolist()


def test_no_tokens():
    assert [x.tolist() for x in align.common_ends(np.zeros(0, int), np.zeros(0, int))] == [[], []]


def expected(docs):
    """(id → row without counts) and the links, by plain Python."""
    library = Tokenizer.from_file(bpe.vocabulary())
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=align.pieces_vocabulary())
    letters = bpe.byte_of_letter()
    rows, links = [], []
    for key, text in docs:
        a = library.encode(f" {text}", add_special_tokens=False) if text else None
        ids_a, ids_b = (a.ids, pieces.encode(text)) if text else ([], [])
        spelled_a = [bytes(letters[c] for c in t) if i != 50256 else b"<|endoftext|>" for i, t in zip(ids_a, a.tokens if a else [])]
        spelled_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [pieces.id_to_piece(i)]]
        whole = f" {text}".encode() if text else b""
        if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            ids_a, ids_b = [], []
        ends_a, ends_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
        if not ids_a:
            ends_a, ends_b = [], []
        groups, own, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, ids_a[i:m])) + "|" + ",".join(map(str, ids_b[j:n])))
            own.append((ids_a[m - 1], ids_b[n - 1]))
            i, j = m, n
        rows.append((key, len(ids_a), len(ids_b), len(groups), ";".join(groups)))
        links.append(own)
    counts = collections.Counter(x for own in links for x in own)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(*row[:4], len(own), sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), row[4]) for row, own in zip(rows, links)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def shown(df):
    return sorted((tuple(r[c] for c in COLUMNS) + (r.groups or "",) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [4 << 20, 200])
def test_awkward_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK_BYTES", chunk)
    texts = [*H.awkward_texts(), "▁odd▁ mark", " <unk> <s> <0x41>", "\x00 nul", "ﬁ ligature é", "unassigned ՘ \U00010d40", "same", "same"]
    docs = [*enumerate(texts), (3, "a repeated id"), (None, "no id"), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1L as chunk", "'x' as groups", "1 as id", "2 as links")
    assert shown(align.align(frame)) == sorted(expected(docs), key=repr)


def test_counts_too_many_to_broadcast(spark, monkeypatch):
    docs = [(i, H.prose(i % 7, 60)) for i in range(40)]
    monkeypatch.setattr("orbitlake.llm.sizes.BROADCAST_ROWS", 0)
    monkeypatch.setattr(align, "CHUNK_BYTES", 500)
    assert shown(align.align(spark.createDataFrame(docs, "doc_id long, text string"))) == sorted(expected(docs), key=repr)


def test_no_documents(spark):
    assert align.align(H.documents(spark, [])).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in [*COLUMNS, "groups_sha256"]) for r in queries.op13_token_alignment(spark, folder).collect())
    assert got == sorted((*row[:7], hashlib.sha256(row[7].encode()).hexdigest() if row[1] else "") for row in expected(docs))
