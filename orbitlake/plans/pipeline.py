"""The whole run: landing files → staging → dimensions → facts → derived four weeks."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.plans import dimensions, facts
from orbitlake.plans.analytics import Star
from orbitlake.plans.warehouse import Warehouse
from orbitlake.sources import gp_json, landing, launches, registry, rows, staging_csv
from orbitlake.workspace import write_through

STAGING = ["stg_celestrak_objects", "stg_ucs_satellites", "stg_launch_events"]
# reasons that stop a strict run: the file is broken, rather than merely without rows
_BROKEN = ["malformed json", "not an object", registry.MALFORMED, registry.NO_SHEET]
KINDS = {STAGING[0]: K.GP, STAGING[1]: K.REGISTRY, STAGING[2]: K.LAUNCHES}


def read_kind(snapshots: DataFrame, kind: str) -> DataFrame:
    """Good and rejected rows of snapshots with binary content, all of one kind; the content routes registry files."""
    if kind == K.GP:
        return gp_json.read_gp_json(landing.as_text(snapshots))
    if kind == K.LAUNCHES:
        return launches.read_launches(landing.as_text(snapshots))
    tables = registry.read_registry(landing.as_text(snapshots.where(~landing.is_workbook())))
    return tables.unionByName(registry.read_workbooks(snapshots.where(landing.is_workbook())))


def parse_landing(snapshots: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Staging tables of the snapshots of every kind, and the rejects. Files of unknown feeds are left alone.

    Every file is parsed once: good and rejected rows are written together, then told apart.
    """
    written = {name: write_through(read_kind(snapshots[kind], kind), f"parsed-{name}") for name, kind in KINDS.items()}
    staging = {name: rows.good(df, schemas.TABLES[name]) for name, df in written.items()}
    gp_bad, registry_bad, launch_bad = (rows.rejected(df) for df in written.values())
    return staging, gp_bad.unionByName(registry_bad).unionByName(launch_bad)


def build(warehouse: Warehouse, staging: dict[str, DataFrame], as_of: dt.date) -> Star:
    """Dimensions and facts from staging, published together. Running it again with the same staging and day changes
    nothing."""
    with warehouse.transaction():
        return _build(warehouse, staging, as_of)


def _build(warehouse: Warehouse, staging: dict[str, DataFrame], as_of: dt.date) -> Star:
    spark = warehouse.spark
    gp, reg, launch = (staging[name] for name in STAGING)

    sources = warehouse.replace("dim_source", dimensions.build_dim_source(spark))
    bands = warehouse.replace("dim_orbit_band", dimensions.build_dim_orbit_band(spark))
    operators = warehouse.replace("dim_operator", dimensions.build_dim_operator(reg))
    objects = warehouse.replace("dim_space_object", dimensions.build_dim_space_object(gp, reg, operators))

    # each step reads the facts the step before has written
    append_observations(warehouse, gp, objects, sources, reg)
    warehouse.append_launches(facts.new_launches(warehouse.launches(), launch))

    real_launches = warehouse.real_launches()
    warehouse.replace("derived_launches", facts.new_derived_launches(real_launches, as_of))

    # only the window's days of the real facts can matter here
    current = facts.facts_in_window(warehouse.real_observations(), as_of)
    derived = warehouse.snapshot("derived_observations", schemas.FACT_OBSERVATION)
    columns = schemas.FACT_OBSERVATION.names
    # real rows replace derived ones of any day, so the pruning sees the days the derived rows span
    spanned = facts.facts_on_days_of(warehouse.real_observations(), derived, "observation_timestamp")
    kept = facts.prune_derived(spanned.select(*columns).unionByName(derived), as_of).where(facts.is_derived())
    kept = write_through(kept, "kept-derived")
    with_kept = current.select(*columns).unionByName(kept)
    after = F.lit(warehouse.last_observation_id())
    fresh = facts.new_derived_observations(with_kept, objects, reg, gp, as_of, after)
    warehouse.reserve_ids(fresh)
    warehouse.replace("derived_observations", kept.unionByName(fresh))
    return star(warehouse, sources, bands, operators, objects, staging)


def append_observations(warehouse: Warehouse, stg_gp: DataFrame, objects, sources, stg_registry) -> None:
    """Append what the real facts do not hold yet. Element sets never belong to the derived source, so only the
    real facts can hold their keys.
    """
    after = F.lit(warehouse.last_observation_id())
    warehouse.append_observations(
        facts.new_observations(warehouse.real_observations(), stg_gp, objects, sources, stg_registry, after)
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def star(warehouse: Warehouse, sources, bands, operators, objects, staging: dict[str, DataFrame]) -> Star:
    gp, reg, launch = (staging[name] for name in STAGING)
    return Star(
        observations=warehouse.observations().select(*schemas.FACT_OBSERVATION.names),
        objects=objects,
        operators=operators,
        bands=bands,
        sources=sources,
        launches=warehouse.launches(),
        stg_gp=gp,
        stg_registry=reg,
        stg_launch=launch,
    )


def open_star(spark: SparkSession, root: str, commit: int | None = None) -> Star:
    """The reports' tables of an existing warehouse, all as of one commit, by default the newest."""
    warehouse = Warehouse(spark, root).at(commit)
    dims = (warehouse.snapshot(t) for t in ("dim_source", "dim_orbit_band", "dim_operator", "dim_space_object"))
    return star(warehouse, *dims, {name: warehouse.snapshot(name) for name in STAGING})


def _parse_day(
    spark: SparkSession, landing_folder: str, as_of: dt.date, feeds: DataFrame | None, archive_folder: str | None
) -> tuple[dict[str, DataFrame], DataFrame]:
    snapshots = landing.read_day(spark, landing_folder, as_of, feeds, unknown=archive_folder is not None)
    if archive_folder:
        landing.write_archive(reduce(DataFrame.unionByName, snapshots.values()), archive_folder)
    return parse_landing(snapshots)


def run(
    spark: SparkSession,
    landing_folder: str,
    root: str,
    as_of: dt.date,
    on_error: str = "fail",
    export_folder: str | None = None,
    feeds: DataFrame | None = None,
    archive_folder: str | None = None,
) -> Star:
    """One whole run over the newest files of a landing folder: of every source those of its last day up to ``as_of``.

    All tables of the run are published by one commit at its end. ``on_error="fail"`` stops before that when a file is
    broken; ``"skip"`` goes on without it (the rejects table says what was left out). ``export_folder`` also writes the
    staging CSV files. ``archive_folder`` keeps the run's files as they are, before they are parsed, and those of
    unknown feeds with them.
    """
    staging, rejected = _parse_day(spark, landing_folder, as_of, feeds, archive_folder)
    broken = rejected.where(F.col("reason").isin(_BROKEN))
    if on_error == "fail" and not broken.isEmpty():
        raise ValueError(f"broken landing file: {broken.first().path}")

    warehouse = Warehouse(spark, root)
    with warehouse.transaction():
        warehouse.replace("rejects", rejected)
        published = {name: warehouse.replace(name, staging[name]) for name in STAGING}
        if export_folder:
            for name, table in published.items():
                staging_csv.write_staging(table, export_folder, name, as_of)
        return build(warehouse, published, as_of)


def stage_only(
    spark: SparkSession, landing_folder: str, export_folder: str, run_date: dt.date, archive_folder: str | None = None
) -> DataFrame:
    """The tolerant variant: parse what can be parsed, write the staging files, return the rejects. One source's broken
    files stop no other source; ``archive_folder`` as in :func:`run`."""
    staging, rejected = _parse_day(spark, landing_folder, run_date, None, archive_folder)
    for name, table in staging.items():
        staging_csv.write_staging(table, export_folder, name, run_date)
    return rejected
