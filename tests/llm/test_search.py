"""Top-k search and decontamination against brute force."""

import random

import numpy as np
import pytest

from orbitlake.llm import decontaminate, topk_search
from tests.llm import helpers as H


def brute(rows, queries, k):
    for q, own in queries:
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q)
        for rank, (score, i) in enumerate(scored[:k], 1):
            yield q, rank, i, -score


@pytest.mark.parametrize("count,dim,spread", [(1, 3, 5), (6, 2, 1), (700, 8, 40), (400, 4, 1)])
def test_top_k_matches_brute_force(spark, monkeypatch, count, dim, spread):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk_search, "LEAF_ROWS", 16)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 8)
    draw = np.random.default_rng(count)
    rows = [(i, [float(x) for x in draw.integers(-spread, spread + 1, dim)]) for i in range(count)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as least")
    got = topk_search.top_k(df, df.where("vec_id % 10 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, [r for r in rows if r[0] % 10 == 0], 5))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0]), (1, [3.0, 1.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, df, 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 5.0), (0, 2, 8, 0.0), (1, 1, 0, 5.0), (1, 2, 8, 0.0), (8, 1, 0, 0.0), (8, 2, 1, 0.0)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk_search.top_k(df, df, 5).count() == 0


def test_copies_with_substitutions_are_found(spark):
    draw = random.Random(2)
    items = [H.prose(100 + i, n, 5000) for i, n in enumerate([40, 25, 18, 13, 9, 3, 1])]
    texts = []
    for k, item in enumerate(items):
        for edits in (0, 1, 2):
            copy = H.edited(item, 10 * k + edits, edits if len(item.split()) > 12 else 0)
            texts.append(H.prose(draw.randrange(10**6), 30, 5000) + " " + copy.upper() + "\n" + H.prose(draw.randrange(10**6), 20, 5000))
    texts += [None, "", H.prose(9, 200, 5000)]
    benchmark = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string").selectExpr("*", "1 as item", "2 as id")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(H.documents(spark, texts), benchmark).collect()}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            doc, words = [w.lower() for w in H.words(text)], [w.lower() for w in H.words(item)]
            expected = longest_overlap(doc, words, min(13, len(words)))
            if expected and len(words) >= 12:  # seeds may miss what is barely over the threshold, never a copy
                assert (d, i) in got or d // 3 != i, (d, i)
            if (d, i) in got:
                assert got[d, i].n_words == expected and got[d, i].n_agreeing >= 0.8 * expected
    assert all((3 * k, k) in got for k in range(len(items)))


def test_planted_benchmark_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    whole = {r.item_id: " ".join(r.text.lower().split()) for r in items.collect()}
    texts = {r.doc_id: f" {' '.join((r.text or '').lower().split())} " for r in docs.collect()}
    planted = {(d, i) for i, t in whole.items() for d, x in texts.items() if f" {t} " in x}
    assert planted and planted <= got and len(got) <= 1.3 * len(planted)


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    items = [H.prose(100 + i, 20, 5000) for i in range(30)]
    docs = H.documents(spark, [f"{H.prose(i, 10, 5000)} {item}" for i, item in enumerate(items)])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_SPANS", 2000)
    assert sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect())) == whole and len(whole) >= 30


def test_empty_sides(spark):
    docs, none = H.documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    benchmark = spark.createDataFrame([(1, H.prose(1, 20))], "item_id long, text string")
    assert decontaminate.contaminated(H.documents(spark, []), benchmark).count() == 0


def longest_overlap(doc, item, least):
    """Words of the longest stretch of which 4 in 5 agree, by trying every place, start and end."""
    best = 0
    for at in range(-len(item) + 1, len(doc)):
        low, high = max(at, 0), min(at + len(item), len(doc))
        same = [doc[i] == item[i - at] for i in range(low, high)]
        best = max([best, *(b - a for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 5 * sum(same[a:b]) >= 4 * (b - a))])
    return best if best >= least else 0


def test_one_substitution_anywhere(spark):
    """Whole items of which one word differs, at every place."""
    items = [H.prose(200 + n, n, 5000) for n in (13, 15, 20)]
    texts, wanted = [], {}
    for i, item in enumerate(items):
        for k in range(len(item.split())):
            words = item.split()
            words[k] = "other"
            wanted[len(texts), i] = longest_overlap(words, item.split(), 13)
            texts.append(" ".join(words))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_words for r in decontaminate.contaminated(H.documents(spark, texts), benchmark).collect()}
    assert got == wanted


def test_longest_stretch_of_a_diagonal():
    """The longest stretch over random agreements against every start and end."""
    import pyarrow as pa

    draw = random.Random(5)
    for _ in range(300):
        n = draw.randrange(13, 40)
        item = [f"w{i}" for i in range(n)]
        doc = [w if draw.random() < 0.8 else f"x{i}" for i, w in enumerate(item)]
        block = decontaminate.Block([0], [" ".join(item)], decontaminate.MASKS, 13)
        words = decontaminate.W.split(pa.array([" ".join(doc)], pa.large_string()), lower=True)
        found = block._stretch(words, 0, 0, 0, 0.8)
        assert (found[0] if found else 0) == longest_overlap(doc, item, 13)
        assert not found or (5 * found[1] >= 4 * found[0] and sum(doc[i] == item[i] for i in range(-found[2], -found[2] + found[0])) == found[1])


def test_tasks_follow_the_work():
    """Shards times blocks would be 120,000 tasks for ten million vectors of 64 numbers, 12 million for ten times as many."""
    for points in (10**3, 10**5, 10**7, 10**8, 10**9):
        asked = points // 50
        shards, blocks = -(-points // topk_search.SHARD_ROWS), -(-asked // topk_search.BLOCK_QUERIES)
        for pairs in (topk_search.TASK_PAIRS, topk_search.TASK_PAIRS * topk_search.FIRST_PASS):
            groups, parts = topk_search._grid(shards, blocks, points, asked, 64, pairs, 8)
            assert groups <= shards and parts <= blocks and groups * parts <= 2 * topk_search.MOST_TASKS
            assert groups * parts >= min(8, shards * blocks) and -(-asked // parts) * 64 * 8 <= 1.1 * topk_search.TASK_BYTES


def test_ties_repeated_ids_and_fractions(spark, monkeypatch):
    """Over several cells: very many equal vectors, ids of two vectors, and numbers that are not whole."""
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk_search, "LEAF_ROWS", 16)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(topk_search, "TASK_PAIRS", 2000)
    monkeypatch.setattr(topk_search, "FIRST_PASS", 2)
    draw = np.random.default_rng(5)
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(300)] + [(i, [float(x) for x in draw.integers(-9, 9, 3)]) for i in range(200, 500)]
    thirds = [(i, [float(x) for x in draw.integers(-99, 99, 3) / 3]) for i in range(500)]
    for own, twice in ((rows, True), (thirds, False)):
        df = spark.createDataFrame(own, "vec_id long, embedding array<double>")
        got = topk_search.top_k(df, df.where("vec_id % 10 = 0"), 5).collect()
        asked = [r for r in own if r[0] % 10 == 0]
        scored = {}
        for q, of in asked:
            scored.setdefault(q, set()).update((-sum(a * b for a, b in zip(of, v)), i) for i, v in own if i != q)
        wanted = [(q, rank, i, -score) for q, each in scored.items() for rank, (score, i) in enumerate(sorted(each)[:5], 1)]
        assert [tuple(r)[:3] for r in sorted(got)] == [w[:3] for w in sorted(wanted)]
        assert all(abs(a.score - b[3]) <= 1e-9 * (1 - twice) for a, b in zip(sorted(got), sorted(wanted)))


def test_queries_meet_all_trees_in_few_tasks(spark, monkeypatch):
    """Fifty shards and eleven blocks, as many tasks as the session has cores."""
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk_search, "LEAF_ROWS", 8)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 10)
    draw = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(x) for x in draw.integers(-50, 50, 4)]) for i in range(1000)], "vec_id long, embedding array<double>")
    found = topk_search.top_k(df, df.where("vec_id < 110"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in __import__("re").findall(r"Exchange [^\n]*?, (\d+)\)?, REPARTITION_BY_NUM", plan)]
    assert dealt and max(dealt) <= 2 * spark.sparkContext.defaultParallelism and found.count() == 330
