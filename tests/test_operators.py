"""Operators against brute force on random rows, with one value holding a third of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orbitlake.operators.exact import exact_mean, exact_sum
from orbitlake.operators.keyed import (
    append_missing,
    duplicates,
    latest_per_key,
    missing_from,
    percent_of_max,
    upsert,
    with_days,
)
from orbitlake.operators.numbering import global_dense_rank, global_row_number, systematic_sample, top_dense_rank
from orbitlake.operators.skyline import skyline, skyline_of


def points(seed, n=300, span=12):
    chance = random.Random(seed)
    made = [(i, chance.randrange(span), float(chance.randrange(span))) for i in range(n)]
    return [(i, 3, r) if i % 3 == 0 else (i, c, r) for i, c, r in made]


def undominated(made):
    def beaten(p):
        return any(
            q[1] is not None and q[2] is not None and p[1] is not None and p[2] is not None
            and q[1] >= p[1] and q[2] >= p[2] and (q[1] > p[1] or q[2] > p[2])
            for q in made
        )

    return sorted(p for p in made if not beaten(p))


@pytest.mark.parametrize("seed", range(4))
def test_skyline_equals_pairwise_comparison(spark, seed):
    made = points(seed)
    df = spark.createDataFrame(made, "id int, n int, risk double").repartition(5)
    assert sorted(tuple(r) for r in skyline(df, "n", "risk").collect()) == undominated(made)


def test_skyline_keeps_a_whole_falling_staircase(spark):
    made = [(i, i, float(500 - i)) for i in range(500)]
    df = spark.createDataFrame(made, "id int, n int, risk double")
    assert skyline(df, "n", "risk").count() == 500


def test_skyline_keeps_rows_without_a_measure(spark):
    made = [(1, 5, 5.0), (2, None, 1.0), (3, 1, None), (4, 1, 1.0)]
    df = spark.createDataFrame(made, "id int, n int, risk double")
    assert sorted(r.id for r in skyline(df, "n", "risk").collect()) == [1, 2, 3]


def undominated_in(made, first):
    """Brute force over the columns from ``first`` on."""
    full = [p[first:] for p in made if None not in p[first:]]
    return sorted(
        (p for p in made if None in p[first:] or not any(q != p[first:] and all(a >= b for a, b in zip(q, p[first:])) for q in full)),
        key=repr,
    )


@pytest.mark.parametrize("span", [4, 1000])
def test_skyline_of_three_measures_equals_pairwise_comparison(spark, span):
    draw = random.Random(span)
    made = [(i, 2 if i % 3 == 0 else draw.randrange(span), draw.randrange(span), float(draw.randrange(span))) for i in range(600)]
    made += [(600, None, 1, 1.0), (601, 5, 5, None), (602, *made[7][1:])]
    df = spark.createDataFrame(made, "id int, a int, b bigint, _m0 double").repartition(5)
    assert sorted((tuple(r) for r in skyline_of(df, "a", "b", "_m0").collect()), key=repr) == undominated_in(made, 1)


def test_skyline_of_points_that_all_survive(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(1000), draw.randrange(1000)) for _ in range(800)]
    df = spark.createDataFrame([(a, b, 2000 - a - b) for a, b in pairs], "a int, b int, c int")
    assert skyline_of(df, "a", "b", "c").count() == 800


@pytest.mark.parametrize("measures", [("a",), ("a", "b"), ("a", "b", "c", "d")])
def test_skyline_of_other_numbers_of_measures(spark, measures):
    draw = random.Random(len(measures))
    made = [tuple(draw.randrange(30) for _ in measures) for _ in range(200)]
    df = spark.createDataFrame(made, ", ".join(f"{m} int" for m in measures))
    assert sorted((tuple(r) for r in skyline_of(df, *measures).collect()), key=repr) == undominated_in(made, 0)


def test_skyline_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b int, c date")
    assert skyline_of(df, "a", "b", "c").collect() == []


def test_exact_means_do_not_depend_on_order(spark):
    draw = random.Random(4)
    made = [(k, draw.choice([draw.random(), 0.1, 1e-9, -draw.random() * 100, None])) for k in range(5) for _ in range(300)]
    made += [(10, 0.3)] * 3 + [(11, 0.3)] * 7 + [(12, x) for x in (0.1, 0.2, 0.6)] + [(13, 0.3 + 1e-12)] + [(14, None)]
    means = []
    for parts in (1, 7, 40):
        draw.shuffle(made)
        df = spark.createDataFrame(made, "k int, x double").repartition(parts)
        grouped = df.groupBy("k").agg(exact_mean(exact_sum(F.col("x")), F.count("x")).alias("mean"))
        means.append({r.k: r["mean"] for r in grouped.collect()})
    assert means[0] == means[1] == means[2]
    got = means[0]
    assert got[10] == got[11] == got[12] == 0.3 < got[13] < 0.3 + 2e-12 and got[14] is None
    for k in range(5):
        values = [x for i, x in made if i == k and x is not None]
        assert abs(got[k] - math.fsum(values) / len(values)) < 1e-13


def test_row_numbers_follow_the_order_across_partitions(spark):
    df = spark.range(2000).select((F.hash("id") % 7).alias("k"), "id").repartition(9)
    numbered = global_row_number(df, [F.col("k").desc(), F.col("id")], "n").collect()
    want = sorted(((r.k, r.id) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r.k, r.id) for r in sorted(numbered, key=lambda r: r.n)] == want
    assert sorted(r.n for r in numbered) == list(range(1, 2001))


def test_row_numbers_continue_and_empty_input_stays_empty(spark):
    df = spark.range(3)
    numbered = global_row_number(df, [F.col("id")], "n", F.lit(10))
    assert [r.n for r in numbered.orderBy("id").collect()] == [11, 12, 13]
    assert global_row_number(df.where("id > 9"), [F.col("id")]).count() == 0


def test_dense_ranks(spark):
    made = [("a", 5), ("b", 7), ("c", 5), ("d", None), ("e", 1)]
    df = spark.createDataFrame(made, "k string, n int")
    ranked = {r.k: r["rank"] for r in global_dense_rank(df, "n").collect()}
    assert ranked == {"b": 1, "a": 2, "c": 2, "e": 3, "d": 4}
    top = [(r.k, r["rank"]) for r in top_dense_rank(df, "n", ["k"], 3).collect()]
    assert top == [("b", 1), ("a", 2), ("c", 2)]


@pytest.mark.parametrize("n,kept", [(0, 0), (1, 1), (359, 359), (719, 719), (720, 360), (1000, 500)])
def test_sample_step(spark, n, kept):
    sampled = systematic_sample(spark.range(n), [F.col("id")])
    assert sampled.count() == kept
    assert n == 0 or sampled.agg(F.min("id")).first()[0] == 0


def test_latest_per_key(spark):
    made = [(1, 5, 1), (1, 7, 2), (1, 7, 3), (2, None, 1), (2, 1, 2)]
    df = spark.createDataFrame(made, "k int, t int, id int")
    got = latest_per_key(df, ["k"], [F.col("t").desc_nulls_last(), F.col("id")])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, 2), (2, 1, 2)]


def test_null_keys_are_always_missing(spark):
    have = spark.createDataFrame([(1, 1), (None, 2)], "a int, b int")
    new = spark.createDataFrame([(1, 1), (None, 2), (3, 3)], "a int, b int")
    assert missing_from(new, have, ["a", "b"]).count() == 2
    assert append_missing(have, new, ["a", "b"]).count() == 4


def test_upsert_updates_inserts_and_keeps(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, name string, fixed string")
    source = spark.createDataFrame([(2, None, "z"), (3, "c", "w")], "k int, name string, fixed string")
    merged = sorted(tuple(r) for r in upsert(target, source, "k", ["name"]).collect())
    assert merged == [(1, "a", "x"), (2, None, "y"), (3, "c", "w")]
    with pytest.raises(Exception, match="k repeated in the source: 2"):
        upsert(target, source.unionByName(source), "k", ["name"]).collect()


def test_percent_of_max_is_held_within_bounds(spark):
    df = spark.createDataFrame([("a", 200), ("b", 1), ("c", None)], "k string, n int")
    got = {r.k: r.percent for r in percent_of_max(df, "n", 2).collect()}
    assert got == {"a": 100.0, "b": 2.0, "c": 2.0}
    assert [r.percent for r in percent_of_max(df.where("n is null"), "n", 2).collect()] == [0.0]


def test_duplicates_and_days(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k int")
    assert sorted(map(str, ((r.k, r.duplicate_count) for r in duplicates(df, ["k"]).collect()))) == ["(1, 2)", "(None, 2)"]
    one = spark.sql("select 1 as k, date'2024-02-27' as a, date'2024-03-01' as b")
    assert with_days(one, F.col("a"), F.col("b")).count() == 4
