"""Substring dedup and the Jaccard join against brute force, and the components under both."""

import random

import pytest

from orbitlake.llm import components, jaccard_join, substring_dedup
from tests.llm import helpers as H


def test_substring_dedup_matches_brute_force(spark):
    texts = H.awkward_texts()
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(H.documents(spark, texts)).collect()}
    for i, (n, removed, kept) in enumerate(H.repeated_spans(texts, substring_dedup.WINDOW)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept.encode()) == (n, removed, kept)
        assert sum(s.end - s.start for s in got[i].spans) == removed


@pytest.mark.parametrize("window", [1, 2, 7])
def test_short_windows(spark, window):
    draw = random.Random(window)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(12))) for _ in range(30)]
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(H.documents(spark, texts), window).collect()}
    for i, (n, removed, kept) in enumerate(H.repeated_spans(texts, window)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept.encode()) == (n, removed, kept)


def test_substring_dedup_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup.X, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup.X, "BUCKET_MARKS", 300)
    passage = H.prose(50, 45)
    texts = [H.prose(i, 60, 3000) + (" " + passage if i % 3 == 0 else "") for i in range(60)]
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(H.documents(spark, texts)).collect()}
    for i, (n, removed, kept) in enumerate(H.repeated_spans(texts, 35)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept.encode()) == (n, removed, kept)


def test_substring_dedup_of_nothing_and_of_rows_without_ids(spark):
    assert substring_dedup.repeated_spans(H.documents(spark, [])).count() == 0
    text = H.prose(1, 40)
    rows = spark.createDataFrame([(None, text), (None, text), (1, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.repeated_spans(rows).collect()) == [0, 40, 40]


def test_jaccard_join_matches_brute_force(spark):
    texts = H.awkward_texts()
    sets = [H.shingle_set(t) for t in texts]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(H.documents(spark, texts)).collect()}
    assert got == {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, H.jaccard_roots(sets)))}


def test_jaccard_join_near_the_threshold(spark, monkeypatch):
    """Families of copies edited more and more, over many chunks and buckets."""
    monkeypatch.setattr(jaccard_join.X, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(jaccard_join.X, "BUCKET_MARKS", 500)
    texts = []
    for family in range(12):
        base = H.prose(1000 + family, [6, 9, 14, 25, 60, 150][family % 6], 5000)
        texts += [base] + [H.edited(base, 7 * family + e, e // 2) for e in range(9)]
    texts += [" ".join(t.split(" ")[:-1]) for t in texts[::5]]
    sets = [H.shingle_set(t) for t in texts]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(H.documents(spark, texts)).collect()}
    assert got == {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, H.jaccard_roots(sets)))}


def test_jaccard_join_of_nothing_and_of_rows_without_ids(spark):
    assert jaccard_join.similar_documents(H.documents(spark, [])).count() == 0
    text = H.prose(1, 40)
    rows = spark.createDataFrame([(None, text), (3, text), (5, text), (5, text), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in jaccard_join.similar_documents(rows).collect()), key=repr)
    assert got == [(0, None), (3, 3), (5, 3), (5, 3), (7, 7)]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 9, 20, 57, 300, 2500, 40_000])
def test_bands_and_plans_cover_every_partner(size):
    starts = jaccard_join.bands(75, 2 * size)
    band = max(i for i, s in enumerate(starts) if s <= size)
    largest = size * 100 // 75
    assert largest < starts[band + 2]
    plan = jaccard_join.plan(75, starts[band], starts[band + 1])
    for other in range(size, largest + 1):
        overlap = -(-75 * (size + other) // 175)  # least overlap of a link
        assert size + other - 2 * overlap < plan.need
    assert plan.segments + plan.wide >= plan.need


def test_components_of_paths_stars_and_repeats(spark):
    draw = random.Random(5)
    nodes = list(range(300))
    draw.shuffle(nodes)
    links = list(zip(nodes[:100], nodes[1:100])) + [(nodes[150], n) for n in nodes[151:250]] + [(nodes[260], nodes[261])] * 3 + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    expected = H.roots(300, links)
    assert got == {i: r for i, r in enumerate(expected) if r != i}


def test_components_of_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
