"""Operators that learn: personal data, toxicity, importance weights."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbitlake.llm import boosting, importance, pii, queries, toxicity
from tests.llm import helpers as H

SMALL = "/root/testdata/sf0.01"


def base_by_pattern(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        found += [(m.start(), 1, m.end())] * all(int(p) <= 255 for p in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
        found += [(m.start(), 2, m.end())] * (14 <= len(digits) <= 19 and total % 10 == 0)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [(m.start(), 3, m.end())] * (10 <= sum(c.isdigit() for c in m[0]) <= 15)
    return sorted(found)


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(1)
    for alphabet in ("a1.@+-( )5 9:%_é\n", "0123456789 -.+", "ab@.-"):
        for _ in range(20_000):
            text = "".join(draw.choice(alphabet) for _ in range(50))
            assert pii.base_spans(text) == base_by_pattern(text), text


def test_personal_data_of_documents(spark):
    got = {r.doc_id: r for r in queries.op8_pii(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base_by_pattern(d.text or "")]
        spans = got[d.doc_id].spans.split(",") if got[d.doc_id].spans else []
        assert set(base) <= set(spans)
        counts = [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]
        assert [got[d.doc_id][f"n_{k}"] for k in pii.KINDS] == counts


def test_personal_data_in_awkward_texts(spark):
    docs = H.documents(spark, [*H.awkward_texts(), "call +1 (212) 555-0123 now", "a@b.co, 1.2.3.4"])
    rows = {r.doc_id: r.spans for r in pii.find(docs, pii.fit(docs)).collect()}
    assert len(rows) == len(H.awkward_texts()) + 2 and rows[0] == []
    assert [s.kind for s in rows[max(rows)]] == ["email", "ip"]
    assert pii.find(H.documents(spark, []), None).count() == 0
    assert pii.redact("mail a@b.co!", [{"kind": "email", "start": 5, "end": 11}]) == "mail <email>!"


def test_the_trees_find_loose_spellings():
    """Numbers that look like the ones that pass, next to a cue, score above numbers that do not."""
    draw = random.Random(3)
    rows, labels = [], []
    for _ in range(2000):
        good = draw.random() < 0.5
        text = f"call {draw.randint(200, 999)} 555 {draw.randint(1000, 9999)} ." if good else f"sum {draw.randint(10, 99)} {draw.randint(10, 99)} {draw.randint(100, 999)} ."
        (span,) = [c for c in pii.candidates(text) if c[1] == 3]
        rows.append(pii.features(text, span))
        labels.append(float(good))
    x, y = np.array(rows), np.array(labels)
    trees = boosting.fit(x[:1500], y[:1500])
    p = trees.probability(x[1500:])
    assert ((p > 0.5) == (y[1500:] == 1)).mean() > 0.98
    threshold = boosting.least_threshold(p, y[1500:], 0.97)
    assert y[1500:][p >= threshold].mean() >= 0.97 and (p >= threshold).sum() >= 0.9 * y[1500:].sum()
    assert boosting.least_threshold(np.array([0.2, 0.9]), np.zeros(2), 0.97) > 1


def test_toxicity_on_held_out_documents(spark):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.1")
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    held = rows.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in held)
    assert hits >= 0.85 * sum(r.toxic for r in held) and hits >= 0.93 * sum(r.predicted for r in held)
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)


def kinds(text):
    """Kinds of match of the first clause, with the seed lexicon."""
    array = pa.array([text.lower()], pa.large_string())
    values = toxicity.features(array, toxicity.Lexicon.of({}))[0]
    return {k for i, k in enumerate(toxicity.KINDS) if values[2 * i] > 0}


@pytest.mark.parametrize(
    "text,found",
    [
        ("You are an idiot.", {"aimed"}),
        ("What an idiot.", {"plain"}),
        ("An idiot, you.", {"aimed"}),
        ("You are not an idiot.", {"negated"}),
        ("She said that he is an idiot.", {"reported"}),
        ("She said hello. He is an idiot.", {"aimed"}),
        ("I will kill you.", {"threat"}),
        ("They kill time", {"threat"}),
        ("To kill time.", set()),
        ("Never kill you", {"negated"}),
        ("not one two three four five idiot", {"plain"}),
        ("A quiet day.", set()),
        ("", set()),
    ],
)
def test_clauses(text, found):
    assert kinds(text) == found


def test_toxicity_without_labels_and_in_awkward_texts(spark):
    docs = H.documents(spark, [*H.awkward_texts(), "You are a worthless idiot, you pathetic scum."])
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, nothing)).collect()}
    assert len(scores) == len(H.awkward_texts()) + 1 and all(0 <= s <= 1 for s in scores.values())
    assert scores[0] == scores[1] < 0.5 < scores[max(scores)]
    one_label = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, one_label)).count() == len(scores)
    assert toxicity.score(H.documents(spark, []), toxicity.fit(docs, nothing)).count() == 0


def test_importance_weights_match_brute_force(spark):
    texts = H.awkward_texts()
    docs, target = H.documents(spark, texts), H.documents(spark, texts[9:16])
    ratio = importance.log_ratio(importance.cell_counts(target), importance.cell_counts(docs))
    got = {r.doc_id: r.log_weight for r in importance.weigh(docs, ratio).collect()}
    for i, text in enumerate(texts):
        cells, _ = importance._cells(pa.array([text or ""], pa.large_string()), importance.CELLS)
        assert got[i] == pytest.approx(ratio[cells].sum())
    assert got[0] == 0


def test_importance_draws_the_share_with_the_largest_keys(spark):
    docs = H.documents(spark, [H.prose(i, 20 + i) for i in range(200)])
    target = docs.where("doc_id < 50")
    ratio = importance.log_ratio(importance.cell_counts(target), importance.cell_counts(docs))
    keys = {r.doc_id: r.key for r in importance.weigh(docs, ratio).collect()}
    drawn = importance.resample(docs, target, share=0.3).collect()
    assert sorted(r.place for r in drawn) == list(range(1, 61))
    assert {r.doc_id for r in drawn} == set(sorted(keys, key=lambda i: (-keys[i], i))[:60])


def test_importance_of_nothing(spark):
    docs = H.documents(spark, ["a", None, "b"])
    assert importance.resample(H.documents(spark, []), docs).count() == 0
    assert importance.resample(docs, H.documents(spark, []), share=1.0).count() == 3


def test_importance_prefers_good_documents(spark):
    kept = {r.doc_id for r in queries.op4_importance_resampling(spark, SMALL).collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(F.col("quality").isNotNull()).collect()
    share = {q: np.mean([r.doc_id in kept for r in labels if r.quality == q]) for q in (0, 1)}
    assert share[1] > share[0] + 0.3


def test_number_regions_equal_one_pattern():
    """Regions found by whole runs are those of a single pattern that tries every start."""
    draw = random.Random(8)
    pattern = re.compile(r"[0-9(+][0-9 ().+/\[\]-]{5,}[0-9]")
    for _ in range(3000):
        text = "".join(draw.choice("01 ().+/[]-x") for _ in range(draw.randrange(40)))
        assert pii._numbers(text) == [m.span() for m in pattern.finditer(text)], text


def test_very_long_texts_of_personal_data():
    """Time by length, not by its square: runs of any one character the patterns look at."""
    size = 1_000_000
    began = time.process_time()
    for part in ("7", "(", "[", ".", "1.", "+", "+1", "@", "a@", " at ", "a ", "-"):
        text = part * (size // len(part))
        base = pii.base_spans(text)
        assert pii.candidates(text) is not None and base == sorted(base), part
    assert time.process_time() - began < 120


def numbered_texts(count):
    """Calls and look-alikes: what a candidate is shows in its context, and no two texts are alike."""
    draw = random.Random(5)
    texts = []
    for i in range(count):
        digits = "".join(draw.choice("0123456789") for _ in range(11))
        call = f"call +{digits[:2]} {digits[2:5]} {digits[5:]}" if i % 2 else f"part {digits[:3]} {digits[3:6]} {digits[6:]}"
        texts.append(f"{'w' * (i % 50)} {call} {H.prose(i, 1 + i % 7)}")
    return texts


def test_trees_and_thresholds_see_every_candidate(spark, monkeypatch):
    """The counts the trees start from are those of all candidates outside the held-out quarter, however many there are."""
    texts = numbered_texts(300)
    seen = []
    grow = boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda edges, share, sums, *more: (seen.append((edges, share)), grow(edges, share, sums, *more))[1])
    pooled = []
    threshold = boosting.threshold_of
    monkeypatch.setattr(boosting, "threshold_of", lambda blocks, precision: (pooled.append(sum(b[1] for b in blocks)), threshold(blocks, precision))[1])
    for constant in ("SAMPLE_DOCUMENTS", "SAMPLE_CANDIDATES"):
        monkeypatch.setattr(pii, constant, 30, raising=False)
    model = pii.fit(H.documents(spark, texts))
    rows = {True: [], False: []}
    for text in texts:
        base = pii.base_spans(text)
        rows[zlib.crc32(text.encode()) % 4 == 0] += [(pii.passes(text, c, base), pii.features(text, c)) for c in pii.candidates(text)]
    x, y = np.array([f for _, f in rows[False]]), np.array([float(p) for p, _ in rows[False]])
    ((edges, share),) = seen
    assert share == pytest.approx(y.mean()) and sum(pooled) == len(rows[True])
    expected = boosting.fit(x, y)
    assert all(np.allclose(a, b) for a, b in zip(edges, expected.edges))
    assert np.allclose(model.trees.probability(x), expected.probability(x))


def test_trees_grown_in_spark_equal_those_of_the_driver(spark, monkeypatch):
    docs = H.documents(spark, numbered_texts(120)).repartition(3)
    grow = boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda edges, share, sums: grow(edges, share, sums, rounds=3))
    one = pii.fit(docs)
    monkeypatch.setattr(pii, "FEW_CELLS", 0)
    two = pii.fit(docs)
    assert one.thresholds == two.thresholds and len(two.trees.trees) == 3
    for a, b in zip(one.trees.trees, two.trees.trees):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_rows_of_equal_probability_stand_or_fall_together():
    p, y = np.array([0.2] * 3 + [0.8] * 200), np.array([0.0] * 103 + [1.0] * 100)
    assert boosting.least_threshold(p, y, 0.97) > 1
    assert boosting.least_threshold(p, (p > 0.5) * 1.0, 0.97) == 0.8
