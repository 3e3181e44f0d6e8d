"""Fuzzy line dedup against brute force over all pairs of lines."""

import random
import re

from pyspark.sql import functions as F

from orbitlake.llm import line_dedup
from tests.llm import helpers as H

def shingles(line: str) -> set[str]:
    """Runs of eight characters from every character; a shorter line is one."""
    return {line.lower()[i : i + 8] for i in range(max(1, len(line) - 7))}


def expected(texts, first: int = 0):
    lines = [(i, j, line) for i, t in enumerate(texts) if t is not None for j, line in enumerate(t.split("\n")) if line.strip()]
    distinct = list(dict.fromkeys(line for _, _, line in lines))
    root = dict(zip(distinct, H.jaccard_roots([shingles(line) for line in distinct])))
    seen, gone = set(), set()
    for i, j, line in lines:
        if root[line] in seen:
            gone.add((i, j))
        seen.add(root[line])
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in enumerate(texts)]


def page(seed: int) -> str:
    """Lines of which some repeat elsewhere, exactly or with an edit."""
    draw = random.Random(seed)
    lines = []
    for _ in range(draw.randrange(1, 12)):
        line = H.prose(draw.randrange(40), 30, 9000)
        lines.append(draw.choice([line, line, H.edited(line, draw.randrange(99), 1), "", H.prose(draw.randrange(10**6), 20, 9000)]))
    return "\n".join(lines)


def test_line_dedup_matches_brute_force(spark):
    texts = H.awkward_texts() + [page(i) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(H.documents(spark, texts)).collect()}
    assert got == dict(enumerate(expected(texts)))


def test_all_columns_stay(spark):
    docs = H.documents(spark)
    made = line_dedup.dedup_lines(docs)
    assert made.columns == docs.columns and made.dtypes == docs.dtypes


def test_emptied_rows_go_on_request(spark):
    docs = H.documents(spark, ["same line here", "same line here", "", None])
    assert sorted(r.doc_id for r in line_dedup.dedup_lines(docs, drop_emptied=True).collect()) == [0, 2, 3]


def test_removed_lines(spark):
    texts = ["first line of all\nsecond line of all\n\nfirst line of all", None, "second line of all"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in line_dedup.removed_lines(H.documents(spark, texts)).collect()}
    assert got == {0: (4, 1, [3]), 1: (0, 0, []), 2: (1, 1, [0])}


def test_rows_that_repeat_and_rows_without_id(spark):
    rows = spark.createDataFrame([(1, "a line"), (1, "a line"), (None, "a line"), (2, "a line")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(rows).collect()))
    assert got == [(0, "a line"), (1, ""), (1, ""), (2, "")]


def test_empty_table(spark):
    assert line_dedup.dedup_lines(H.documents(spark, [])).count() == 0


def test_recall_of_pairs_over_the_threshold(spark):
    lines = []
    for i in range(150):
        line = H.prose(i, 40, 20_000)
        lines += [line, H.edited(line, i, 1 + i % 3)]
    sets = {line: shingles(line) for line in lines}
    pairs = {frozenset((a, b)) for a, b in zip(lines[::2], lines[1::2]) if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    texts = H.documents(spark, lines)
    line_of = {r.id: r.text for r in texts.selectExpr("text", "xxhash64(text) as id").collect()}
    found = {frozenset((line_of[r.a], line_of[r.b])) for r in line_dedup.line_links(texts).collect()}
    assert len(pairs) > 60 and len(pairs & found) >= 0.97 * len(pairs)


def test_only_column_functions(spark):
    plan = line_dedup.dedup_lines(H.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def all_pairs_of_bands(spark, texts):
    """Roots over the distinct lines, from every pair that shares a band and reaches the threshold."""
    docs = H.documents(spark, texts).selectExpr("null as key", "doc_id as id", "text")
    split = line_dedup._lines(docs)
    ids = {r.id: r.line for r in split.selectExpr("xxhash64(line) as id", "line").collect()}
    bands = {}
    for r in line_dedup._signatures(split).collect():
        for band in r.bands:
            bands.setdefault(band, set()).add(r.line_id)
    order = sorted(ids)
    place = {i: k for k, i in enumerate(order)}
    sets = [{s for s in spark_shingles} for spark_shingles in shingle_rows(spark, [ids[i] for i in order])]
    links = [
        (place[a], place[b])
        for held in bands.values()
        for a in held
        for b in held
        if a < b and 100 * len(sets[place[a]] & sets[place[b]]) >= 75 * len(sets[place[a]] | sets[place[b]])
    ]
    return order, H.roots(len(order), links)


def shingle_rows(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, line string").select("k", line_dedup.shingles(F.col("line")).alias("s"))
    return [r.s for r in sorted(rows.collect())]


def test_near_copies_in_a_family_of_one_template(spark):
    """Every line shares a band with many that it does not resemble; its near copy is seldom the least or the greatest."""
    lines = []
    for i in range(150):
        line = H.prose(1, 20, 9000) + " " + H.prose(1000 + i, 6, 9000)
        lines += [line, H.edited(line, i, 1)]
    order, expected_roots = all_pairs_of_bands(spark, lines)
    links = [(r.a, r.b) for r in line_dedup.line_links(H.documents(spark, lines)).collect()]
    place = {i: k for k, i in enumerate(order)}
    got = H.roots(len(order), [(place[a], place[b]) for a, b in links])
    assert got == expected_roots and 1 < len(set(got)) < len(order) - 50


def test_shingles_start_at_every_character(spark):
    lines = ["a", "1234567", "12345678", "  Lead and trail  ", "ab\r", "é ß 日本語 😀 " * 30, "x" * 200, *(H.prose(n, 60)[: n + 60] for n in range(90))]
    assert [set(s) for s in shingle_rows(spark, lines)] == [shingles(line) for line in lines]


def test_one_character_more_in_lines_without_spaces(spark):
    """Candidates are MinHash, so nearly all pairs, and no others."""
    lines = []
    for i in range(30):
        for n in (60, 120, 300):
            line = H.prose(50 + 1000 * n + i, 90, 9000).replace(" ", ",")[:n]
            lines += [line, line[:9] + "q" + line[9:]]
        page = f"//example.org/a/long/path/{H.prose(i, 12, 9000)}".replace(" ", "/")
        lines += ["http:" + page, "https:" + page]
    pairs = list(zip(lines[::2], lines[1::2]))
    assert all(100 * len(shingles(a) & shingles(b)) >= 75 * len(shingles(a) | shingles(b)) for a, b in pairs)
    texts = H.documents(spark, lines)
    ids = [r.id for r in texts.selectExpr("doc_id", "xxhash64(text) as id").sort("doc_id").collect()]
    links = {frozenset(r) for r in line_dedup.line_links(texts).collect()}
    wanted = {frozenset(ids[i : i + 2]) for i in range(0, len(ids), 2)}
    assert links <= wanted and len(links) >= 0.97 * len(wanted)


def test_sets_of_shingles_stay_off_the_disk(spark, monkeypatch):
    """A set takes eight bytes a character: neither intermediate tables nor shuffles may hold one."""
    written = []
    keep = line_dedup.write_through

    def watched(df, label):
        written.append((label, df.dtypes, df._jdf.queryExecution().optimizedPlan().toString()))
        return keep(df, label)

    monkeypatch.setattr(line_dedup, "write_through", watched)
    lines = [H.prose(1, 20, 9000) + " " + H.prose(1000 + i // 2, 6, 9000) + " end" * (i % 2) for i in range(60)]
    assert not line_dedup.line_links(H.documents(spark, lines)).isEmpty()
    assert "line-links" in {label for label, _, _ in written}
    for label, columns, plan in written:
        assert not any(kind == "array<bigint>" for name, kind in columns if name != "bands"), label
        made = [step.lstrip(" :+-").split(" ")[0] for step in plan.splitlines() if "array_distinct" in step]
        assert set(made) <= {"Join", "Filter"} or label == "line-sketches", label


def test_a_family_of_one_template_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Long lines that share their bands and three fifths of their shingles: sketches rule their pairs out, and a pair
    that is left is made in one band only."""
    pairs = {}
    keep = line_dedup.write_through

    def watched(df, label):
        made = keep(df, label)
        if label == "other-pairs":
            pairs["others"] = [(r.a, r.b) for r in made.collect()]
        return made

    monkeypatch.setattr(line_dedup, "write_through", watched)
    lines = [H.prose(1, 60, 9000) + " " + H.prose(1000 + i, 20, 9000) for i in range(120)]
    line_dedup.line_links(H.documents(spark, lines)).collect()
    assert len(pairs["others"]) < 2 * len(lines) and len(set(pairs["others"])) == len(pairs["others"])


def test_signatures_are_the_minima_of_all_shingles(spark):
    """Also where a long line has few different shingles, and where characters take one to four bytes."""
    lines = ["a", "x" * 3000, "é" * 900, "ab" * 700, "1234567", "日本語😀", " tail é", *(H.prose(n, 20 * n, 9000) for n in range(1, 20))]
    lines += ["é ß 日本語 😀 İ " * 70, *(H.prose(n, 150, 9000).replace("a", "ä").replace("o", "😀") for n in range(9))]
    rows = spark.createDataFrame([(None, i, line) for i, line in enumerate(lines)], "key long, id long, text string")
    split = line_dedup._lines(rows)
    each = split.select(F.xxhash64("line").alias("line_id"), F.explode(line_dedup.shingles(F.col("line"))).alias("s"))
    minima = each.groupBy("line_id").agg(*(F.min(F.hash("s").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(line_dedup.MASKS)))
    bands = [F.xxhash64(F.lit(b), *(f"m{b * line_dedup.ROWS + r}" for r in range(line_dedup.ROWS))) for b in range(line_dedup.BANDS)]
    wanted = {r.line_id: r.bands for r in minima.select("line_id", F.array(*bands).alias("bands")).collect()}
    found = [(r.line_id, r.bands) for r in line_dedup._signatures(split).collect()]
    assert len(found) == len(wanted) == len(lines) and dict(found) == wanted
    assert {r.sure for r in line_dedup._minima(split, line_dedup.DEPTHS).collect()} == {True, False}


def test_few_hashes_meet_the_masks_and_no_shingle_is_decoded(spark, monkeypatch):
    plans = {}
    keep = line_dedup.write_through

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, label)

    monkeypatch.setattr(line_dedup, "write_through", watched)
    lines = [H.prose(i // 2, 200, 9000) + " é" * (i % 2) for i in range(20)]
    line_dedup.line_links(H.documents(spark, lines)).collect()
    assert "getbit" in plans["line-signatures"] and "decode(" not in plans["line-signatures"] and "UTF-32" not in plans["line-signatures"]
    words = [step for step in plans["line-sketches"].splitlines() if "Aggregate" in step and "word" in step]
    assert len(words) == 2  # a hash is added to one word, not to each
    assert plans["line-sketches"].count("array_distinct") == 1  # and made once, not in a filter before, too
