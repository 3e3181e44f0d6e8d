"""Tokens against the tokenizers library, packing against its own rules."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orbitlake.llm import packing, tokens
from tests.llm import helpers as H

MORSE = "a"
for _ in range(10):
    MORSE += MORSE.translate(str.maketrans("ab", "ba"))
#: Two words of 1,024 letters that polynomials modulo 2**64 do not tell apart, and added tokens.
ODD = [MORSE, MORSE.translate(str.maketrans("ab", "ba")), f"{MORSE} x", "hello <|endoftext|> there", "<|endoftext|><|endoftext|>\n", "<|endoftext>", "a\nb  c", " x y ", "\n\na", "a \n b", "x\n", "\n", "a'll b's", "it 's 12 3a\nB.. ..", "a\n'll b", "\nab c\nab", "日本 語\n日", "a\xa0b", "a\xa0", "x　y", "\x85", "​ z", "🙂 🙂\n🙂"]


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_the_tokenizers_library(reference):
    texts = [t or "" for t in H.awkward_texts()] + ODD
    encoder = tokens.encoder(tokens.vocabulary())
    for _ in range(2):  # the second time from what is kept
        got = encoder.ids(pa.array(texts, pa.large_string()))
        assert [g.tolist() for g in got] == [reference(t) for t in texts]


def test_ids_of_documents(spark, reference):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = tokens.encoder(tokens.vocabulary()).ids(pa.array([t or "" for t in texts], pa.large_string()))
    assert [g.tolist() for g in got] == [reference(t) for t in texts]


@pytest.mark.parametrize("max_tokens", [16, 1024])
def test_pieces_and_places(spark, reference, max_tokens):
    texts = H.awkward_texts()
    rows = packing.pack(H.documents(spark, texts), max_tokens=max_tokens).collect()
    by_document, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32
    assert len(by_document) == len(texts)
    for i, text in enumerate(texts):
        pieces = sorted(by_document[i], key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces])
        assert ids.tolist() == [*reference(text), 2]
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert all(r.length == max_tokens for r in pieces[1:]) and 1 <= pieces[0].length <= max_tokens
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= max_tokens


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_a_best_fit(seed):
    """As few sequences as item-by-item best fit of the pieces by falling length."""
    draw = random.Random(seed)
    capacity = 100
    counts = {draw.randint(1, capacity): draw.randint(1, 60) for _ in range(draw.randint(1, 40))}
    gaps, opened = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                opened += 1
                gaps.append(capacity - length)
    placed, sequences = collections.Counter(), collections.defaultdict(list)
    for length, first, end, per, sequence, offset in packing.best_fit_runs(counts, capacity):
        for j in range(end - first):
            sequences[sequence + j // per].append((offset + j % per * length, length))
            placed[length] += 1
    assert placed == counts and len(sequences) == opened
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def test_nothing_to_pack(spark):
    assert packing.pack(H.documents(spark, [])).count() == 0


def test_rows_that_repeat_and_rows_without_id(spark):
    rows = spark.createDataFrame([(1, "same"), (1, "same"), (None, "other")], "doc_id long, text string")
    got = packing.pack(rows).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
