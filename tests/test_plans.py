"""The shape of the physical plans: what must not move, and what must not be compared pairwise."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from orbitlake.operators.keyed import latest_per_key, missing_from
from orbitlake.plans import analytics as A
from orbitlake.plans import dimensions as D
from orbitlake.plans import facts
from orbitlake.workload.analogue import AS_OF, Lake


@pytest.fixture(scope="module")
def lake(spark):
    return Lake(spark, "/root/testdata/sf0.001")


@pytest.fixture
def no_broadcast(spark):
    """Tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


REPORTS = [
    A.orbit_rollup, A.operator_ranking, A.orbit_statistics, A.skyline_risk, A.purpose_distribution, A.source_coverage,
    A.altitude_by_type, A.latest_position, A.source_latest_import, A.orbit_class_count,
]


@pytest.mark.parametrize("report", REPORTS)
def test_no_pairwise_joins(lake, report, no_broadcast):
    text = plan(report(lake.star))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_derived_fill_has_no_cross_join(lake, no_broadcast):
    states = facts.object_states(lake.star.objects, lake.star.stg_registry, lake.star.stg_gp)
    text = plan(facts.derived_candidates(states, AS_OF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Generate" in text


@pytest.mark.parametrize("report", [A.orbit_rollup, A.operator_ranking, A.purpose_distribution, A.altitude_by_type])
def test_facts_are_summed_before_they_meet_a_large_dimension(lake, report, no_broadcast):
    text = plan(report(lake.star))
    tree = text.split("\n(1)")[0]
    scan_events = next(i for i, line in enumerate(tree.splitlines()) if "Scan parquet" in line and "(1)" in line)
    above = [line for line in tree.splitlines()[:scan_events]]
    # reading upwards from the facts' scan: partial sum, shuffle, final sum, only then a join
    order = [w for line in reversed(above) for w in ("HashAggregate", "Exchange", "SortMergeJoin") if w in line]
    assert order[:3] == ["HashAggregate", "Exchange", "HashAggregate"]


def test_only_needed_columns_are_read(lake):
    text = plan(A.daily_trend(lake.star))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_filter_reaches_the_scan(lake):
    text = plan(A.launch_activity(lake.star))
    assert "o_custkey" not in text and "o_orderdate" not in text


def test_latest_row_is_chosen_before_the_shuffle(lake):
    df = latest_per_key(lake.raw("lineitem").select("l_partkey", "l_shipdate", "l_orderkey"), ["l_partkey"], [F.col("l_shipdate").desc()])
    assert "WindowGroupLimit" in plan(df).split("Exchange")[1]


def test_append_is_an_anti_join_on_the_key(lake, no_broadcast):
    df = missing_from(lake.star.observations, lake.star.observations, facts.OBSERVATION_KEY)
    assert "LeftAnti" in plan(df) and "NestedLoop" not in plan(df)


def test_skewed_key_joins_and_sums_right(spark):
    # a third of all facts belong to one object
    made = spark.range(30000).select(
        F.col("id").alias("observation_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("bigint").alias("object_id"),
        F.lit(1).cast("bigint").alias("orbit_band_id"),
        F.lit(1).cast("bigint").alias("object_count"),
        F.lit(0.25).alias("debris_risk_score"),
        F.lit(None).cast("double").alias("altitude_km"),
    )
    totals = A.object_band_totals(A.Star(made, None, None, None, None))
    assert totals.count() == 500
    assert totals.agg(F.sum("n_objects")).first()[0] == 30000


def test_only_the_days_of_the_batch_are_read(spark, tmp_path):
    """Files of other days are made unreadable: reading them would fail."""
    path = tmp_path / "facts"
    made = spark.range(40).select(
        F.col("id").alias("object_id"),
        F.lit(1).cast("bigint").alias("source_id"),
        F.timestamp_seconds(F.col("id") * 86400).alias("observation_timestamp"),
        F.to_date(F.timestamp_seconds(F.col("id") * 86400)).alias("observation_date"),
    )
    made.write.partitionBy("observation_date").parquet(str(path))
    stored = spark.read.schema(made.schema).parquet(str(path))
    for folder in path.glob("observation_date=*"):
        if not folder.name.endswith(("1970-01-01", "1970-02-05")):
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"x" * file.stat().st_size)
                (folder / f".{file.name}.crc").unlink(missing_ok=True)
    batch = made.where("object_id in (0, 35)")
    found = facts.facts_on_days_of(stored, batch, "observation_timestamp")
    assert sorted(r.object_id for r in found.collect()) == [0, 35]


def test_hot_id_is_split_in_the_observation_join(spark, no_broadcast):
    """One id holds a third of the element sets and the dimension is too large to broadcast."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = spark.range(0, 60000, 1, 8)
        gp = n.select(
            F.lit("o").alias("object_name"),
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).cast("bigint").alias("norad_id"),
            F.timestamp_seconds(F.col("id")).alias("epoch"),
            F.lit(1.0).alias("inclination_deg"),
            F.lit(0.0).alias("eccentricity"),
            F.lit(1.0).alias("mean_motion"),
            F.when(F.col("id") % 2 == 0, "active").otherwise("geo").alias("source_group"),
        )
        objects = spark.range(1000).select(F.col("id").alias("norad_id"), F.col("id").alias("object_id"))
        registry = spark.range(1000).select(F.col("id").alias("norad_id"), F.lit("LEO").alias("orbit_type"))
        df = facts.observation_candidates(gp, objects, D.build_dim_source(spark), registry)
        assert len(df.collect()) == 60000
        text = plan(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "(skew=true)" in text.split("== Initial Plan")[0]

