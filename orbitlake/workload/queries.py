"""Every query by name: (spark, folder of test tables) → DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.functions.lenient import lenient_date
from orbitlake.functions.naming import fallback_launch_id, source_group
from orbitlake.operators.exact import exact_mean, exact_sum
from orbitlake.operators.keyed import append_missing, distinct_keys, latest_per_key, missing_from, percent_of_max, with_days
from orbitlake.operators.numbering import global_dense_rank, global_row_number, systematic_sample
from orbitlake.operators.skyline import skyline, skyline_of
from orbitlake.plans import analytics as A
from orbitlake.plans import dimensions as D
from orbitlake.plans import facts, pipeline, quality
from orbitlake.plans.warehouse import Warehouse
from orbitlake.sources import gp_json, json_pieces, landing, launches, registry, staging_csv, tle
from orbitlake.streaming import incremental
from orbitlake.workload import rawtext
from orbitlake.workload.analogue import AS_OF, Lake
from orbitlake.workspace import fresh_path, write_through

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to ``digits`` decimals, so that the order of additions does not show."""
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    return df.select(*(F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns))


def zoneless(df: DataFrame) -> DataFrame:
    """Times as UTC without a zone."""
    times = {f.name for f in df.schema if f.dataType.typeName() == "timestamp"}
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in times else F.col(c) for c in df.columns))


def on_star(report: Callable[[A.Star], DataFrame]) -> Query:
    return lambda spark, folder: rounded(report(Lake(spark, folder).star))


def on_lake(work: Callable[[Lake], DataFrame]) -> Query:
    return lambda spark, folder: work(Lake(spark, folder))


# --- positions -----------------------------------------------------------------------------------


def scene(star: A.Star) -> DataFrame:
    # the hash multiplies the last digits of a sine, so angles agree to four decimals
    coarse = ["phase", "node", "x", "y", "z"]
    drawn = A.scene_coordinates(A.latest_position(star, ordered=False))
    return drawn.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in coarse})


def rings(star: A.Star) -> DataFrame:
    sampled = A.sampled_rings(A.latest_position(star, ordered=False))
    return sampled.withColumn("rotation", F.round("rotation", 4))


# --- builds --------------------------------------------------------------------------------------


def built_operator(lake: Lake) -> DataFrame:
    return D.build_dim_operator(lake.star.stg_registry)


def built_object(lake: Lake) -> DataFrame:
    operators = write_through(built_operator(lake), "dim-operator")
    return D.build_dim_space_object(lake.star.stg_gp, lake.star.stg_registry, operators)


def upserted_object(lake: Lake) -> DataFrame:
    """The registry objects of known status, merged with the staged ones."""
    known = lake.star.objects.where(F.col("operational_status").isNotNull())
    return D.upsert_dim_space_object(known, lake.star.stg_gp, lake.star.stg_registry, built_operator(lake))


def no_observations(lake: Lake) -> DataFrame:
    return lake.star.observations.where(F.lit(False))


def appended_observations(lake: Lake, present: DataFrame) -> DataFrame:
    star = lake.star
    return rounded(facts.new_observations(present, star.stg_gp, built_object(lake), star.sources, star.stg_registry))


def known_observations(lake: Lake) -> DataFrame:
    """What an earlier run loaded: the steeper observations, by hour."""
    hour = F.date_trunc("hour", "observation_timestamp").cast("timestamp_ntz")
    loaded = lake.star.observations.where(F.col("inclination_deg") >= 30)
    return loaded.withColumn("observation_timestamp", hour)


def known_launches(lake: Lake) -> DataFrame:
    return lake.star.launches.where(F.col("launch_status") != "Launch Failure")


def derived(lake: Lake, present: DataFrame) -> DataFrame:
    star = lake.star
    return facts.new_derived_observations(present, built_object(lake), star.stg_registry, star.stg_gp, AS_OF)


def refilled(lake: Lake) -> DataFrame:
    kept = facts.prune_derived(lake.star.observations, AS_OF)
    return rounded(kept.unionByName(derived(lake, kept)))


def fused_objects(lake: Lake) -> DataFrame:
    operators = write_through(built_operator(lake), "dim-operator")
    fused = D.fuse_objects(lake.star.stg_gp, lake.star.stg_registry, operators)
    return fused.select("norad_id", "object_name", "purpose", "operational_status", "launch_date")


def staging_counts(lake: Lake) -> DataFrame:
    star = lake.star
    return pipeline.row_counts(dict(zip(pipeline.STAGING, [star.stg_gp, star.stg_registry, star.stg_launch])))


def all_analytics(lake: Lake) -> DataFrame:
    """The seven analyses from shared totals: rows per report."""
    return pipeline.row_counts(A.analytics(lake.star))


def launch_weeks(lake: Lake) -> DataFrame:
    """Derived launches two weeks after the last real one."""
    last = lake.star.launches.agg(F.to_date(F.max("launch_timestamp"))).first()[0]
    return facts.refresh_derived_launches(lake.star.launches, last + dt.timedelta(days=14))


# --- operators at size ---------------------------------------------------------------------------

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def numbered_lines(lake: Lake) -> DataFrame:
    lines = lake.raw("lineitem").select(*LINE_ORDER)
    return global_row_number(lines, [F.col(c) for c in LINE_ORDER])


def latest_lines(lake: Lake) -> DataFrame:
    lines = lake.raw("lineitem").select(*LINE_ORDER)
    order = [F.col("l_shipdate").desc(), *map(F.col, ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"))]
    return latest_per_key(lines, ["l_partkey"], order)


def ranked_suppliers(lake: Lake) -> DataFrame:
    counts = lake.raw("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_lines"))
    return global_dense_rank(write_through(counts, "supplier-lines"), "n_lines", "supplier_rank")


def part_skyline(lake: Lake) -> DataFrame:
    """Parts not beaten in both pieces sold and mean discount."""
    parts = (
        lake.raw("lineitem")
        .groupBy("l_partkey")
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("pieces"),
            exact_mean(exact_sum(F.col("l_discount")), F.count("l_discount")).alias("mean_discount"),
        )
    )
    return rounded(skyline(write_through(parts, "parts"), "pieces", "mean_discount"), 9)


def part_skyline_in_three(lake: Lake) -> DataFrame:
    """Parts not beaten in pieces sold, mean discount and the day they were last shipped."""
    parts = (
        lake.raw("lineitem")
        .groupBy("l_partkey")
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("pieces"),
            exact_mean(exact_sum(F.col("l_discount")), F.count("l_discount")).alias("mean_discount"),
            F.max(F.col("l_shipdate").cast("date")).alias("last_day"),
        )
    )
    return rounded(skyline_of(write_through(parts, "parts"), "pieces", "mean_discount", "last_day"), 9)


def part_gaps(lake: Lake) -> DataFrame:
    """Days without a shipment in the four weeks up to each part's last one."""
    days = lake.raw("lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"))
    last = days.groupBy("l_partkey").agg(F.max("day").alias("last_day"))
    spread = with_days(last, F.date_sub("last_day", K.DERIVED_WINDOW_DAYS - 1), F.col("last_day"))
    return missing_from(spread, days.distinct(), ["l_partkey", "day"]).select("l_partkey", "day", "last_day")


def sampled_orders(lake: Lake) -> DataFrame:
    return systematic_sample(lake.raw("orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")])


def appended_lines(lake: Lake) -> DataFrame:
    """Order days the event days lack, appended to them."""
    event_days = lake.raw("events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("who")).distinct()
    order_days = lake.raw("orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("who")).distinct()
    return append_missing(event_days, order_days, ["day", "who"])


# --- sources -------------------------------------------------------------------------------------


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("source_name", "reason").agg(F.count("*").alias("n"))


def gp_rows(lake: Lake) -> DataFrame:
    return zoneless(gp_json.parse_gp_json(rawtext.gp_files(lake))[0])


def gp_rejects(lake: Lake) -> DataFrame:
    bad = gp_json.parse_gp_json(rawtext.gp_files(lake))[1]
    return reject_counts(bad)


def launch_rows(lake: Lake) -> DataFrame:
    return zoneless(launches.parse_launches(rawtext.launch_files(lake))[0])


def registry_rows(lake: Lake) -> DataFrame:
    return zoneless(registry.parse_registry(rawtext.registry_files(lake))[0])


def workbook_rows(lake: Lake) -> DataFrame:
    return zoneless(registry.parse_workbooks(rawtext.registry_workbooks(lake))[0])


def tle_rows(lake: Lake) -> DataFrame:
    good = tle.parse_tle(rawtext.tle_files(lake))[0]
    return zoneless(good).select(
        "object_name", "norad_id", "classification", "international_designator", "epoch_year", "epoch_day", "epoch",
        "inclination_deg", "eccentricity", "mean_motion",
    )


def tle_catalogue_rows(lake: Lake) -> DataFrame:
    good = tle.parse_tle_catalogue(rawtext.tle_files(lake))[0]
    return good.select(
        "satellite_name", "norad_id", "designator_year", "designator_launch_number", "designator_piece", "epoch_year", "epoch_day"
    )


def tle_split_rows(lake: Lake) -> DataFrame:
    """Landed two-line files, read in splits."""
    good = tle.parse_tle_files(lake.spark, landed(lake, rawtext.tle_files(lake)))[0]
    return zoneless(good).select(
        "object_name", "norad_id", "classification", "international_designator", "epoch_year", "epoch_day", "epoch",
        "inclination_deg", "eccentricity", "mean_motion",
    )


def tle_split_catalogue_rows(lake: Lake) -> DataFrame:
    good = tle.parse_tle_catalogue_files(lake.spark, landed(lake, rawtext.tle_files(lake)))[0]
    return good.select(
        "satellite_name", "norad_id", "designator_year", "designator_launch_number", "designator_piece", "epoch_year", "epoch_day"
    )


def gp_split_rows(lake: Lake) -> DataFrame:
    """Landed arrays of element sets, read in splits."""
    good = json_pieces.parse_gp_json_files(lake.spark, landed(lake, rawtext.gp_files(lake)))[0]
    return zoneless(good).drop("imported_at")


def gp_split_rejects(lake: Lake) -> DataFrame:
    return reject_counts(json_pieces.parse_gp_json_files(lake.spark, landed(lake, rawtext.gp_files(lake)))[1])


def launch_split_rows(lake: Lake) -> DataFrame:
    """Landed launches, arrays read in splits."""
    good = json_pieces.parse_launch_files(lake.spark, landed(lake, rawtext.launch_files(lake, full=True)))[0]
    return zoneless(good).drop("imported_at")


def registry_split_rows(lake: Lake) -> DataFrame:
    """Landed registry tables, read in splits."""
    good = registry.parse_registry_files(lake.spark, landed(lake, rawtext.registry_files(lake)))[0]
    return good.drop("imported_at")


class Abandoned(Exception):
    """A run that does not reach its commit."""


def run_versions(lake: Lake) -> DataFrame:
    """Rows of the staging tables as of each commit: all of them, a run given up before its commit, and a run that
    replaces two of the three."""
    warehouse, star = Warehouse(lake.spark, fresh_path(lake.spark, "warehouse")), lake.star
    tables = dict(zip(pipeline.STAGING, [star.stg_gp, star.stg_registry, star.stg_launch]))
    with warehouse.transaction():
        for name, df in tables.items():
            warehouse.replace(name, df)
    try:
        with warehouse.transaction():
            for name, df in tables.items():
                warehouse.replace(name, df.where(F.lit(False)))
            raise Abandoned
    except Abandoned:
        pass
    with warehouse.transaction():
        warehouse.replace(pipeline.STAGING[0], star.stg_gp.where("norad_id % 2 = 0"))
        warehouse.replace(pipeline.STAGING[2], star.stg_launch.where("payload_count IS NOT NULL"))
    counts = [
        pipeline.row_counts({name: warehouse.at(number).snapshot(name) for name in tables}).withColumn("commit_no", F.lit(number).cast("long"))
        for number in warehouse.log.numbers()
    ]
    return reduce(DataFrame.unionByName, counts)


def content_gate(lake: Lake) -> DataFrame:
    """Whole pages and documents offered to the JSON parser: what is refused, and why."""
    offered = rawtext.page_snapshots(lake).unionByName(rawtext.document_snapshots(lake))
    return reject_counts(gp_json.parse_gp_json(offered)[1])


def table_gate(lake: Lake) -> DataFrame:
    """Whole pages offered to the registry parser."""
    return reject_counts(registry.parse_registry(rawtext.page_snapshots(lake))[1])


def groups_of_feeds(lake: Lake) -> DataFrame:
    offered = rawtext.page_snapshots(lake).unionByName(rawtext.document_snapshots(lake))
    group = source_group(F.col("source_uri"), F.col("source_name"))
    return offered.groupBy(group.alias("source_group")).agg(F.count("*").alias("n"))


def launch_ids(lake: Lake) -> DataFrame:
    provider = F.when(F.col("o_totalprice") < 480000, F.col("o_orderpriority"))
    name = F.concat(F.lit("LAUNCH-"), F.col("o_orderkey").cast("string"))
    fallback = fallback_launch_id(name, F.col("o_orderdate").cast("timestamp"), provider)
    return lake.raw("orders").select("o_orderkey", fallback.alias("launch_id"))


def parsed_dates(lake: Lake) -> DataFrame:
    """Order dates written in five ways and read back."""
    day, way = F.to_date("o_orderdate"), F.col("o_orderpriority")
    serial = F.date_diff(day, F.lit("1899-12-30").cast("date"))
    text = (
        F.when(way == "1-URGENT", F.concat(serial.cast("string"), F.lit(".75")))
        .when(way == "2-HIGH", F.date_format(day, "M/d/yyyy"))
        .when(way == "3-MEDIUM", F.date_format(day, "yyyy-MM-dd"))
        .when(way == "4-NOT SPECIFIED", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(day, "d MMM yyyy"))
    )
    return lake.raw("orders").select("o_orderkey", lenient_date(F.concat(F.lit(" "), text)).alias("day"))


def staged_csv(lake: Lake) -> DataFrame:
    """Element-set staging written to CSV and loaded again."""
    rows = schemas.conform(lake.star.stg_gp, schemas.STG_GP)
    path = staging_csv.write_staging(rows, fresh_path(lake.spark, "staging"), "stg_celestrak_objects", AS_OF)
    return zoneless(staging_csv.read_staging(lake.spark, path, schemas.STG_GP))


def staged_tle_csv(lake: Lake) -> DataFrame:
    """Two-line staging columns written to CSV and loaded again."""
    stage = tle.tle_stage(tle.parse_tle(rawtext.tle_files(lake))[0])
    path = staging_csv.write_staging(stage, fresh_path(lake.spark, "staging"), "satellite_tle_stage", AS_OF)
    return staging_csv.read_staging(lake.spark, path, schemas.STG_TLE)


# --- runs ----------------------------------------------------------------------------------------


def landed(lake: Lake, *snapshots: DataFrame) -> str:
    folder = fresh_path(lake.spark, "landing")
    for files in snapshots:
        rawtext.land(files, folder)
    return folder


def latest_files(lake: Lake) -> DataFrame:
    """One newest file per source of a landing folder."""
    folder = landed(lake, rawtext.gp_files(lake), rawtext.launch_files(lake))
    return landing.latest_snapshots(lake.spark, folder).select("source_name", "extension")


def archived_files(lake: Lake) -> DataFrame:
    """Landed files archived by source and day, and read back."""
    archive = fresh_path(lake.spark, "archive")
    landing.write_archive(rawtext.launch_files(lake).unionByName(rawtext.registry_files(lake)), archive)
    files = lake.spark.read.parquet(archive)
    return files.groupBy("source_name", "ingest_date").agg(F.count("*").alias("n_files"))


def run_observations(lake: Lake) -> DataFrame:
    """Facts after a whole run over landed files of all feeds."""
    folder = landed(
        lake, rawtext.gp_files(lake, per_hour=True), rawtext.launch_files(lake), rawtext.registry_files(lake)
    )
    star = pipeline.run(lake.spark, folder, fresh_path(lake.spark, "warehouse"), AS_OF)
    return zoneless(rounded(star.observations))


def streamed_observations(lake: Lake) -> DataFrame:
    """Landed files → staging → facts, both steps incremental, the second in several batches."""
    folder = landed(lake, rawtext.gp_files(lake, per_hour=True))
    staged, checkpoint = fresh_path(lake.spark, "staged"), fresh_path(lake.spark, "checkpoint")
    incremental.ingest_new_files(
        lake.spark, folder, K.GP, staged, f"{checkpoint}/ingest"
    ).awaitTermination()
    warehouse = Warehouse(lake.spark, fresh_path(lake.spark, "warehouse"))
    objects = write_through(built_object(lake), "dim-space-object")
    incremental.append_new_observations(
        warehouse, staged, objects, lake.star.sources, lake.star.stg_registry, f"{checkpoint}/append", files_per_batch=64
    ).awaitTermination()
    # ids follow arrival, all else follows the rows
    return zoneless(rounded(warehouse.real_observations().drop("observation_date", "observation_id")))


def queries() -> dict[str, Query]:
    purposes = lambda star: percent_of_max(A.purpose_distribution(star, limit=None), "object_count", 2)
    trend = lambda star: percent_of_max(A.daily_trend(star, limit=None), "object_count", 4)
    star_reports = {
        "orbit_rollup": A.orbit_rollup,
        "orbit_rollup_all": lambda star: A.orbit_rollup(star, limit=None),
        "daily_trend": A.daily_trend,
        "daily_trend_all": lambda star: A.daily_trend(star, limit=None),
        "operator_ranking": A.operator_ranking,
        "operator_ranking_all": lambda star: A.operator_ranking(star, limit=None),
        "orbit_statistics": A.orbit_statistics,
        "inclination_statistics": A.inclination_statistics,
        "skyline_risk": A.skyline_risk,
        "skyline_risk_all": lambda star: A.skyline_risk(star, limit=None),
        "purpose_distribution": A.purpose_distribution,
        "purpose_risk": A.purpose_risk,
        "source_coverage": A.source_coverage,
        "launch_activity": A.launch_activity,
        "purpose_percent_of_max": purposes,
        "trend_percent_of_max": trend,
        "dashboard_summary": A.dashboard_summary,
        "dashboard_summary_strict": lambda star: A.dashboard_summary(star, strict=True),
        "orbit_class_count": A.orbit_class_count,
        "altitude_by_type": A.altitude_by_type,
        "source_latest_import": A.source_latest_import,
        "latest_position": A.latest_position,
        "scene_coordinates": scene,
        "sampled_rings": rings,
        "invalid_rows": lambda star: quality.invalid_rows(star.stg_gp),
        "duplicate_rows": lambda star: quality.duplicate_rows(star.stg_gp),
        "prune_derived": lambda star: facts.prune_derived(star.observations, AS_OF),
        "fact_launch": lambda star: facts.new_launches(star.launches.where(F.lit(False)), star.stg_launch),
    }
    lake_work = {
        "dim_operator": built_operator,
        "dim_space_object": built_object,
        "upsert_objects": upserted_object,
        "fact_observation": lambda lake: appended_observations(lake, no_observations(lake)),
        "append_observations": lambda lake: appended_observations(lake, known_observations(lake)),
        "append_launches": lambda lake: facts.new_launches(known_launches(lake), lake.star.stg_launch),
        "derived_fill": lambda lake: rounded(derived(lake, lake.star.observations)),
        "refill_after_prune": refilled,
        "fill_launch_weeks": launch_weeks,
        "harmonised_objects": lambda lake: D.harmonised_objects(lake.star.stg_gp, lake.star.stg_registry),
        "fused_objects": fused_objects,
        "staging_counts": staging_counts,
        "all_analytics": all_analytics,
        "latest_raw_snapshot": latest_files,
        "raw_archive": archived_files,
        "global_row_number": numbered_lines,
        "latest_per_key": latest_lines,
        "global_dense_rank": ranked_suppliers,
        "skyline_parts": part_skyline,
        "skyline_parts_in_three": part_skyline_in_three,
        "gap_fill_parts": part_gaps,
        "systematic_sample": sampled_orders,
        "append_missing": appended_lines,
        "gp_roundtrip": gp_rows,
        "gp_rejects": gp_rejects,
        "launch_roundtrip": launch_rows,
        "ucs_roundtrip": registry_rows,
        "workbook_roundtrip": workbook_rows,
        "tle_roundtrip": tle_rows,
        "tle_catalogue_roundtrip": tle_catalogue_rows,
        "tle_split_roundtrip": tle_split_rows,
        "tle_split_catalogue_roundtrip": tle_split_catalogue_rows,
        "ucs_split_roundtrip": registry_split_rows,
        "gp_split_roundtrip": gp_split_rows,
        "gp_split_rejects": gp_split_rejects,
        "launch_split_roundtrip": launch_split_rows,
        "run_versions": run_versions,
        "content_gate": content_gate,
        "table_gate": table_gate,
        "source_group": groups_of_feeds,
        "fallback_launch_id": launch_ids,
        "lenient_dates": parsed_dates,
        "staging_csv_roundtrip": staged_csv,
        "tle_staging_csv": staged_tle_csv,
        "whole_run": run_observations,
        "incremental_append": streamed_observations,
        "distinct_keys": lambda lake: distinct_keys(lake.raw("documents"), ["lang", "source"]),
    }
    return {name: on_star(r) for name, r in star_reports.items()} | {name: on_lake(w) for name, w in lake_work.items()}
