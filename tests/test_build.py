"""Warehouse builds on hand-made staging rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orbitlake import schemas
from orbitlake.plans import analytics as A
from orbitlake.plans import dimensions as D
from orbitlake.plans import facts, quality

AS_OF = dt.date(2024, 3, 31)
AT = dt.datetime(2024, 3, 31, 4)


def gp(spark, *made):
    """(norad_id, group, epoch, eccentricity, mean motion)"""
    full = [(f"OBJ {n}", n, e, 50.0, ecc, mm, g, AT) for n, g, e, ecc, mm in made]
    return spark.createDataFrame(full, schemas.STG_GP)


def reg(spark, *made):
    """(norad_id, operator, class, status)"""
    full = [(n, "S", f"C{n}", o, None, c, s, None, AT) for n, o, c, s in made]
    return spark.createDataFrame(full, schemas.STG_REGISTRY)


def day(n, hour=6):
    return dt.datetime(2024, 3, n, hour)


@pytest.fixture
def staging(spark):
    elements = gp(
        spark,
        (1, "active", day(30), 0.0, 15.0),
        (1, "active", day(30), 0.2, 15.0),
        (2, "debris", day(29), 0.0, 11.0),
        (2, "geo", day(29), 0.0, 11.0),
        (3, "debris", day(28), 0.1, 12.0),
        (3, "active", day(28), 0.1, 12.0),
        (4, "unlisted", day(27), 0.05, 12.0),
        (5, "geo", None, 0.05, 1.0),
        (None, "geo", day(27), 0.05, 1.0),
        (6, None, day(27), 0.05, 1.0),
    )
    registry = reg(
        spark,
        (1, "Beta", "MEO", "Inactive"),
        (1, "Alpha", "HEO", None),
        (2, None, "Elliptical", None),
        (3, "Gamma", None, None),
        (None, "Nobody", "LEO", "x"),
    )
    return elements, registry


def dims(staging):
    elements, registry = staging
    operators = D.build_dim_operator(registry)
    return operators, D.build_dim_space_object(elements, registry, operators)


def test_operators(spark, staging, rows):
    operators, _ = dims(staging)
    # a name that never wins for its id has no row; the missing name is UNKNOWN
    assert rows(operators, "operator_id", "operator_name", "operator_type", "country") == [
        (1, "Beta", "UNKNOWN", "C1"),
        (2, "Gamma", "UNKNOWN", "C3"),
        (3, "UNKNOWN", "UNKNOWN", "C2"),
    ]


def test_objects(spark, staging):
    _, objects = dims(staging)
    got = {r.object_id: (r.object_type, r.operational_status, r.operator_id) for r in objects.collect()}
    assert got == {
        1: ("SATELLITE", "Inactive", 1),
        2: ("SATELLITE", None, 3),  # geo sorts after debris
        3: ("DEBRIS", "ACTIVE", 2),  # active sorts before debris
        4: ("SATELLITE", None, 3),  # no registry row: the UNKNOWN operator
        5: ("SATELLITE", None, 3),
        6: ("SATELLITE", None, 3),
    }


def test_no_unknown_operator_leaves_null(spark):
    elements, registry = gp(spark, (9, "active", day(1), 0.0, 1.0)), reg(spark, (1, "Op", "LEO", None))
    operators = D.build_dim_operator(registry)
    assert D.build_dim_space_object(elements, registry, operators).first().operator_id is None


def no_facts(spark):
    return spark.createDataFrame([], schemas.FACT_OBSERVATION)


def test_observations(spark, staging):
    elements, registry = staging
    _, objects = dims(staging)
    new = facts.new_observations(no_facts(spark), elements, objects, D.build_dim_source(spark), registry)
    got = [
        (r.observation_id, r.object_id, r.source_id, r.orbit_band_id, r.debris_risk_score)
        for r in new.orderBy("observation_id").collect()
    ]
    # unknown group, missing epoch, id or group are left out; the lexically largest class decides the band
    assert got == [(1, 1, 1, 2, 0.75), (2, 2, 2, None, 0.9), (3, 2, 4, 3, 0.25), (4, 3, 1, None, 0.75), (5, 3, 2, None, 0.9)]
    assert new.where("altitude_km is not null or velocity_km_s is not null").count() == 0


def test_second_append_adds_nothing_and_ids_continue(spark, staging):
    elements, registry = staging
    _, objects = dims(staging)
    sources = D.build_dim_source(spark)
    first = facts.new_observations(no_facts(spark), elements, objects, sources, registry)
    assert facts.new_observations(first, elements, objects, sources, registry).count() == 0
    more = elements.unionByName(gp(spark, (1, "geo", day(30), 0.0, 1.0)))
    added = facts.new_observations(first, more, objects, sources, registry).collect()
    assert [(r.observation_id, r.object_id, r.source_id) for r in added] == [(6, 1, 4)]


def test_derived_fill(spark, staging):
    elements, registry = staging
    _, objects = dims(staging)
    real = facts.new_observations(no_facts(spark), elements, objects, D.build_dim_source(spark), registry)
    derived = facts.new_derived_observations(real, objects, registry, elements, AS_OF)
    got = derived.groupBy("object_id").agg(
        F.count("*").alias("n"), F.max("orbit_band_id").alias("band"), F.max("debris_risk_score").alias("risk"), F.max("altitude_km").alias("km")
    )
    assert {r.object_id: tuple(r)[1:] for r in got.collect()} == {
        1: (27, 4, 0.75, 42000.0),  # classes mapped first: HEO is the largest id
        2: (27, 3, 0.25, 35786.0),
        3: (27, None, 0.9, None),
        4: (28, None, 0.5, None),
        5: (28, 3, 0.25, 35786.0),
        6: (28, None, 0.25, None),
    }
    ids = [r.observation_id for r in derived.orderBy("object_id", "observation_timestamp").collect()]
    assert ids == list(range(6, 6 + 165))
    both = real.unionByName(derived)
    assert facts.new_derived_observations(both, objects, registry, elements, AS_OF).count() == 0
    assert facts.new_derived_observations(both, objects, registry, elements, AS_OF + dt.timedelta(days=1)).count() == 6


def fact_rows(spark, *made):
    """(id, object, source, timestamp)"""
    full = [(i, o, None, s, t, None, None, None, None, None, 1, 0.25) for i, o, s, t in made]
    return spark.createDataFrame(full, schemas.FACT_OBSERVATION)


def test_prune(spark):
    made = fact_rows(
        spark,
        (1, 1, 900, dt.datetime(2024, 3, 4)),  # first day of the window stays
        (2, 1, 900, dt.datetime(2024, 3, 3)),  # before the window
        (3, 1, 1, dt.datetime(2024, 3, 10, 5)),
        (4, 1, 900, dt.datetime(2024, 3, 10)),  # replaced by the real row of the day
        (5, 2, 900, dt.datetime(2024, 3, 10)),
        (6, 2, None, dt.datetime(2024, 3, 10)),  # unknown source replaces nothing
        (7, 2, 1, dt.datetime(2020, 1, 1)),
        (8, 3, 900, None),
        (9, None, 900, dt.datetime(2024, 3, 10)),
    )
    assert sorted(r.observation_id for r in facts.prune_derived(made, AS_OF).collect()) == [1, 3, 5, 6, 7, 8, 9]


def launches(spark, *made):
    full = [(i, k, s, t, "n", None, None, None, None, None, None, None) for i, k, s, t in made]
    return spark.createDataFrame(full, schemas.FACT_LAUNCH)


def test_launch_weeks(spark):
    made = launches(
        spark,
        (7, "real", 200, dt.datetime(2024, 3, 14, 9)),  # 17 days back
        (8, "old", 900, dt.datetime(2024, 1, 1)),
        (9, "odd", None, dt.datetime(2024, 3, 7)),
    )
    after = facts.refresh_derived_launches(made, AS_OF)
    got = [(r.launch_event_id, r.launch_id, r.launch_name[-1]) for r in after.where("source_id = 900").orderBy("launch_event_id").collect()]
    assert got == [
        (10, "abgeleitete-daten-launch-20240307", "1"),
        (11, "abgeleitete-daten-launch-20240321", "3"),
        (12, "abgeleitete-daten-launch-20240328", "4"),
    ]
    again = facts.refresh_derived_launches(after, AS_OF)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, after.collect()), key=repr)


def test_launches_take_maxima(spark):
    staged = spark.createDataFrame(
        [("a", "n1", None, None, None, None, "Failure", 1, AT), ("a", "n2", AT, "p", None, None, "Partial Success", None, AT), (None, "x", AT, None, None, None, None, None, AT)],
        schemas.STG_LAUNCH,
    )
    new = facts.new_launches(launches(spark, (4, "z", 200, AT)), staged).collect()
    assert [(r.launch_event_id, r.launch_id, r.source_id, r.launch_name, r.provider_name, r.payload_count, r.success_count, r.launch_site) for r in new] == [
        (5, "a", 200, "n2", "p", 1, 1, None)
    ]


def star(spark, observations, objects=None, operators=None):
    return A.Star(
        observations=observations,
        objects=objects if objects is not None else spark.createDataFrame([], schemas.DIM_SPACE_OBJECT),
        operators=operators if operators is not None else spark.createDataFrame([], schemas.DIM_OPERATOR),
        bands=D.build_dim_orbit_band(spark),
        sources=D.build_dim_source(spark),
        launches=spark.createDataFrame([], schemas.FACT_LAUNCH),
        stg_gp=spark.createDataFrame([], schemas.STG_GP),
        stg_registry=spark.createDataFrame([], schemas.STG_REGISTRY),
        stg_launch=spark.createDataFrame([], schemas.STG_LAUNCH),
    )


def test_reports_over_empty_tables(spark):
    empty = star(spark, no_facts(spark))
    assert tuple(A.dashboard_summary(empty).first()) == (0, 0, 0, None)
    assert A.source_coverage(empty).where("observation_count = 0 and last_observation_timestamp is null").count() == 9
    assert A.source_latest_import(empty).count() == 9
    for report in (A.daily_trend, A.operator_ranking, A.orbit_statistics, A.skyline_risk, A.purpose_distribution, A.latest_position, A.launch_activity, A.orbit_rollup):
        assert report(empty).count() == 0


def test_presentation_fills_text_and_counts_only(spark):
    shown = A.present(spark.sql("select cast(null as string) t, cast(null as bigint) n, cast(null as double) m")).first()
    assert tuple(shown) == ("", 0, None)


def test_rollup_tells_missing_from_total(spark):
    made = fact_rows(spark, (1, 1, 1, day(1)), (2, 2, 1, day(1)))
    got = {(r.orbit_class, r.object_type, r.all_orbits, r.all_object_types): r.object_count for r in A.orbit_rollup(star(spark, made)).collect()}
    assert got == {("ALL_ORBITS", "ALL_OBJECT_TYPES", o, t): 2 for o, t in ((0, 0), (0, 1), (1, 1))}


def test_trend_counts_rows_not_days(spark):
    made = fact_rows(spark, *((i, 1, 1, day(n)) for i, n in enumerate([1, 1, 2, 20])), (9, 1, 1, None))
    got = [(r.observation_date.day, r.object_count, round(r.moving_average_object_count, 6)) for r in A.daily_trend(star(spark, made)).collect()]
    assert got == [(20, 1, 1.333333), (2, 1, 1.5), (1, 2, 2.0)]


def test_latest_position_prefers_real_rows(spark):
    objects = spark.createDataFrame([(1, 1, None, None, None, None, None, 5), (2, 2, "b", "DEBRIS", None, "p", None, 1)], schemas.DIM_SPACE_OBJECT)
    operators = spark.createDataFrame([(1, "Op", "UNKNOWN", None)], schemas.DIM_OPERATOR)
    made = fact_rows(
        spark, (1, 1, 1, day(1)), (2, 1, 900, day(9)), (3, 1, 2, day(2)), (4, 2, 900, day(3)), (5, 2, 900, day(4)), (6, 3, 1, day(1))
    ).withColumn("orbit_band_id", F.when(F.col("object_id") == 2, F.lit(1)).cast("bigint"))
    got = [tuple(r) for r in A.latest_position(star(spark, made, objects, operators)).collect()]
    assert got == [
        (1, 1, "UNKNOWN", "UNKNOWN", "UNKNOWN", None, None, None, 0.25, "CelesTrak debris", "UNKNOWN", "UNKNOWN", day(2)),
        (2, 2, "b", "DEBRIS", "LEO", 550.0, 7.8, None, 0.25, "Abgeleitete Daten (CelesTrak, 4 Wochen)", "Op", "p", day(4)),
    ]


def test_analytics_shares_totals(spark):
    made = fact_rows(spark, (1, 1, 1, day(1)), (2, 2, 1, day(1)))
    tables = star(spark, made)
    together = A.analytics(tables)
    assert list(together) == ["orbit_rollup", "daily_trend", "operator_ranking", "orbit_statistics", "skyline_risk", "purpose_distribution", "source_coverage"]
    assert together["orbit_rollup"].collect() == A.orbit_rollup(tables).collect()
    assert together["source_coverage"].collect() == A.source_coverage(tables).collect()


def test_quality_reports(spark, staging, rows):
    elements, _ = staging
    assert rows(quality.invalid_rows(elements)) == [("geo", 2), (None, 1)]
    assert rows(quality.duplicate_rows(elements)) == [(1, day(30), "active", 2)]


def test_upsert_keeps_vanished_objects(spark, staging):
    elements, registry = staging
    operators, objects = dims(staging)
    before = objects.unionByName(
        spark.createDataFrame([(99, 99, "GONE", "DEBRIS", "x", None, None, None)], schemas.DIM_SPACE_OBJECT)
    ).where("object_id <> 4")
    after = {r.object_id: r for r in D.upsert_dim_space_object(before, elements, registry, operators).collect()}
    assert set(after) == {1, 2, 3, 4, 5, 6, 99}
    assert after[99].object_name == "GONE"
    # the merge takes the registry's status alone
    assert after[3].operational_status is None and after[1].operational_status == "Inactive"


def test_landed_element_sets_fill_their_files(spark):
    """Ids are shared by all types of event: files by ranges of as many ids as rows would hold a fifth of them."""
    from types import SimpleNamespace

    from orbitlake.workload import rawtext

    types = list(rawtext.FEED_GROUP)
    kind = F.element_at(F.array(*map(F.lit, types)), (F.col("id") % len(types) + 1).cast("int"))
    events = spark.range(10 * rawtext.ROWS_PER_FILE).select(
        F.col("id").alias("event_id"),
        kind.alias("event_type"),
        (F.col("id") % 7).alias("user_id"),
        F.lit(0.75).alias("value"),
        F.lit("2024-01-01 00:30:00").cast("timestamp").alias("ts"),
    )
    files = rawtext.gp_files(SimpleNamespace(raw=lambda name: events), per_hour=True)
    sizes = [r.n for r in files.select(F.regexp_count("content", F.lit("OBJECT_NAME")).alias("n")).collect()]
    assert sum(sizes) == 10 * rawtext.ROWS_PER_FILE and set(sizes) == {rawtext.ROWS_PER_FILE}


def test_landed_launches_fill_their_files(spark, monkeypatch):
    """However far apart the keys lie, files of launches that are read in splits hold a share of the rows."""
    from types import SimpleNamespace

    from orbitlake.workload import queries, rawtext

    count = 12_000
    orders = spark.range(count).select(
        (F.col("id") * 400).alias("o_orderkey"),
        F.col("id").alias("o_custkey"),
        F.element_at(F.array(*map(F.lit, "FOP")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"),
        F.lit(150000.0).alias("o_totalprice"),
        F.lit("2024-01-01 00:30:00").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    )
    folders = []
    land = rawtext.land
    monkeypatch.setattr(rawtext, "land", lambda files, folder: (folders.append(folder), land(files, folder)))
    got = queries.launch_split_rows(SimpleNamespace(spark=spark, raw=lambda name: orders))
    assert got.select("launch_name").distinct().count() == got.count() == count
    landed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
    assert landed.count() <= 6
