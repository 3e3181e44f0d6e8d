"""Fact builds: idempotent appends and the derived four-week fill.

Every function takes the current facts and returns rows to add (``new_…``) or the rows that stay
(``prune_…``); the pipeline writes them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.functions import classify as C
from orbitlake.operators.keyed import missing_from, with_days
from orbitlake.operators.numbering import global_row_number
from orbitlake.workspace import write_through

OBSERVATION_KEY = ["object_id", "source_id", "observation_timestamp"]


def day_of(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def is_derived() -> Column:
    return F.coalesce(F.col("source_id") == K.DERIVED_SOURCE_ID, F.lit(False))


def is_real() -> Column:
    """Known source other than the derived one; a NULL source is neither."""
    return F.coalesce(F.col("source_id") != K.DERIVED_SOURCE_ID, F.lit(False))


def last_id(facts: DataFrame, column: str) -> Column:
    """Largest id so far, 0 for an empty table, as a scalar subquery."""
    return facts.agg(F.coalesce(F.max(column), F.lit(0))).scalar()


# --- real observations ---------------------------------------------------------------------------


def observation_candidates(
    stg_gp: DataFrame, dim_space_object: DataFrame, dim_source: DataFrame, stg_registry: DataFrame
) -> DataFrame:
    """One candidate fact per object, source and epoch.

    Staging is reduced to its grain before any join. The per-object attributes (object id, registry class) are
    joined to each other and written first, so the staging rows meet one plain table that is unique per id.
    Adaptive execution splits a hot id only in a join directly over two shuffles, which that gives; and it
    broadcasts the table where its size on disk allows.
    """
    keyed = stg_gp.dropna(subset=["norad_id", "epoch", "source_group"])
    grain = keyed.groupBy("norad_id", "epoch", "source_group").agg(
        F.max("inclination_deg").alias("inclination_deg"),
        F.max("eccentricity").alias("eccentricity"),
        F.max("mean_motion").alias("mean_motion"),
    )
    classes = (
        stg_registry.where(F.col("norad_id").isNotNull())
        .groupBy("norad_id")
        .agg(F.max("orbit_type").alias("orbit_type"))
    )
    attributes = dim_space_object.select("norad_id", "object_id").join(classes, "norad_id", "left")
    objects = write_through(attributes, "object-classes")
    groups = dim_source.select("source_id", F.col("source_name").alias("_source_name"))
    group = F.col("source_group")
    # dim_source is the fixed nine-row table
    in_source = grain.join(
        F.broadcast(groups), F.concat(F.lit(K.GP_SOURCE_PREFIX), group) == F.col("_source_name")
    )
    return in_source.join(objects, "norad_id").select(
        "object_id",
        # the lexically largest class decides; an unlisted class falls back to the group
        F.coalesce(C.band_id(F.col("orbit_type")), C.geo_group_band(group)).alias("orbit_band_id"),
        F.col("source_id").cast("bigint").alias("source_id"),
        F.col("epoch").alias("observation_timestamp"),
        F.lit(None).cast("double").alias("altitude_km"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        F.lit(None).cast("double").alias("velocity_km_s"),
        "inclination_deg",
        F.lit(1).cast("bigint").alias("object_count"),
        C.risk_score(group == "debris", F.col("eccentricity"), F.col("mean_motion")).alias("debris_risk_score"),
    )


def new_observations(
    facts: DataFrame,
    stg_gp: DataFrame,
    dim_space_object: DataFrame,
    dim_source: DataFrame,
    stg_registry: DataFrame,
    after: Column | None = None,
) -> DataFrame:
    """Observations of the staging snapshot the facts do not hold yet.

    Ids continue after the largest of ``facts``, or after ``after`` where the caller keeps count (which saves
    reading the id column of the whole history).
    """
    candidates = observation_candidates(stg_gp, dim_space_object, dim_source, stg_registry)
    fresh = missing_from(candidates, facts_on_days_of(facts, stg_gp, "epoch"), OBSERVATION_KEY)
    order = [F.col("object_id"), F.col("observation_timestamp"), F.col("source_id")]
    last = last_id(facts, "observation_id") if after is None else after
    return global_row_number(fresh, order, "observation_id", last).select(*schemas.FACT_OBSERVATION.names)


def facts_on_days_of(facts: DataFrame, batch: DataFrame, timestamp: str) -> DataFrame:
    """Facts of the calendar days that occur in the batch.

    Where the table is partitioned by ``observation_date`` the days (one scalar subquery, a set as long as the
    calendar at most) select its partitions, so a daily batch does not read the history, and one late row adds
    one partition. Other tables are returned whole.
    """
    if "observation_date" not in facts.columns:
        return facts
    days = batch.agg(F.collect_set(F.to_date(timestamp))).scalar()
    return facts.where(F.array_contains(days, F.col("observation_date")))


def fact_day(facts: DataFrame) -> Column:
    """Day of a fact: the partition column where the table has one."""
    if "observation_date" in facts.columns:
        return F.col("observation_date")
    return day_of(F.col("observation_timestamp"))


# --- launches ------------------------------------------------------------------------------------


def launch_candidates(stg_launch: DataFrame) -> DataFrame:
    return (
        stg_launch.where(F.col("launch_id").isNotNull())
        .groupBy("launch_id")
        .agg(
            F.max("launch_date").alias("launch_timestamp"),
            F.max("launch_name").alias("launch_name"),
            F.max("launch_provider").alias("provider_name"),
            F.max("rocket_name").alias("rocket_name"),
            F.max("launch_country").alias("launch_country"),
            F.max("launch_status").alias("launch_status"),
            F.max("payload_count").cast("bigint").alias("payload_count"),
        )
        .withColumns(
            {
                "source_id": F.lit(K.LAUNCH_SOURCE_ID).cast("bigint"),
                "launch_site": F.lit(None).cast("string"),
                "success_count": C.succeeded(F.col("launch_status")),
            }
        )
    )


def new_launches(facts: DataFrame, stg_launch: DataFrame) -> DataFrame:
    """Launches the facts do not hold yet, numbered after the last id."""
    fresh = missing_from(launch_candidates(stg_launch), facts, ["launch_id"])
    numbered = global_row_number(
        fresh, [F.col("launch_id")], "launch_event_id", last_id(facts, "launch_event_id")
    )
    return numbered.select(*schemas.FACT_LAUNCH.names)


# --- derived four weeks --------------------------------------------------------------------------


def window_start(as_of: dt.date) -> dt.date:
    return as_of - dt.timedelta(days=K.DERIVED_WINDOW_DAYS - 1)


def real_days(facts: DataFrame) -> DataFrame:
    """Objects and days with a real observation."""
    return (
        facts.where(is_real())
        .select("object_id", day_of(F.col("observation_timestamp")).alias("observation_day"))
        .distinct()
    )


def prune_derived(facts: DataFrame, as_of: dt.date) -> DataFrame:
    """Facts that stay: all but derived rows that left the window or now have a real row that day."""
    day = day_of(F.col("observation_timestamp"))
    expired = is_derived() & F.coalesce(day < F.lit(window_start(as_of)), F.lit(False))
    kept = facts.where(~expired)
    derived = kept.where(is_derived()).withColumn("observation_day", day)
    # derived rows that are left lie in the window, so only its days are looked at
    recent = facts.where(fact_day(facts) >= F.lit(window_start(as_of)))
    unreplaced = derived.join(real_days(recent), ["object_id", "observation_day"], "left_anti")
    return kept.where(~is_derived()).unionByName(unreplaced.select(*facts.columns))


def derived_launch_rows(template: DataFrame, as_of: dt.date) -> DataFrame:
    """The four representative launches of the window (before the checks against real launches)."""
    days = [as_of - dt.timedelta(days=back) for back in K.DERIVED_LAUNCH_DAYS_BACK]
    launches = [
        F.struct(
            F.lit(f"{K.DERIVED_LAUNCH_ID_PREFIX}{day:%Y%m%d}").alias("launch_id"),
            F.lit(day).alias("_day"),
            F.lit(f"{K.DERIVED_LAUNCH_NAME_PREFIX}{week}").alias("launch_name"),
        )
        for week, day in enumerate(days, start=1)
    ]
    timestamp = template.schema["launch_timestamp"].dataType
    return (
        template.sparkSession.sql("SELECT 1")
        .select(F.inline(F.array(*launches)))
        .withColumns(
            {
                "source_id": F.lit(K.DERIVED_SOURCE_ID).cast("bigint"),
                "launch_timestamp": F.col("_day").cast(timestamp),
                "provider_name": F.lit(K.DERIVED_LABEL),
                "rocket_name": F.lit(K.DERIVED_ROCKET),
                "launch_country": F.lit(K.DERIVED_COUNTRY),
                "launch_status": F.lit(K.DERIVED_LABEL),
                "launch_site": F.lit(K.DERIVED_SITE),
                "payload_count": F.lit(1).cast("bigint"),
                "success_count": F.lit(1).cast("bigint"),
            }
        )
    )


def without_derived_launches(facts: DataFrame) -> DataFrame:
    return facts.where(~is_derived())


def new_derived_launches(facts: DataFrame, as_of: dt.date) -> DataFrame:
    """Representative launches for days without a real launch.

    ``facts`` holds no derived launches any more (see ``without_derived_launches``), so ids continue after
    the real ones. At most four rows: both sides of the anti joins are the four candidates and the real
    launches of four days.
    """
    candidates = derived_launch_rows(facts, as_of)
    days = [as_of - dt.timedelta(days=back) for back in K.DERIVED_LAUNCH_DAYS_BACK]
    real = (
        facts.where(is_real())
        .select(day_of(F.col("launch_timestamp")).alias("_day"))
        .where(F.col("_day").isin(days))
        .distinct()
    )
    same_id = facts.select("launch_id").where(F.col("launch_id").startswith(K.DERIVED_LAUNCH_ID_PREFIX))
    open_days = candidates.join(real, "_day", "left_anti").join(same_id, "launch_id", "left_anti")
    numbered = global_row_number(
        open_days, [F.col("launch_timestamp")], "launch_event_id", last_id(facts, "launch_event_id")
    )
    return numbered.select(*facts.columns)


def refresh_derived_launches(facts: DataFrame, as_of: dt.date) -> DataFrame:
    real = without_derived_launches(facts)
    return real.unionByName(new_derived_launches(real, as_of))


def object_states(dim_space_object: DataFrame, stg_registry: DataFrame, stg_gp: DataFrame) -> DataFrame:
    """Per object: band, largest inclination and risk, for the derived rows.

    Here every registry class is mapped first and the largest band id wins, unlike in the real facts.
    """
    registry = (
        stg_registry.where(F.col("norad_id").isNotNull())
        .groupBy("norad_id")
        .agg(F.max(C.band_id(F.col("orbit_type"))).alias("registry_band"))
    )
    elements = (
        stg_gp.where(F.col("norad_id").isNotNull())
        .groupBy("norad_id")
        .agg(
            F.max(C.geo_group_band(F.col("source_group"))).alias("group_band"),
            F.max("inclination_deg").alias("inclination_deg"),
            F.max("eccentricity").alias("eccentricity"),
            F.max("mean_motion").alias("mean_motion"),
        )
    )
    joined = (
        dim_space_object.select("object_id", "norad_id", "object_type")
        .join(registry, "norad_id", "left")
        .join(elements, "norad_id", "left")
    )
    return joined.select(
        "object_id",
        F.coalesce("registry_band", "group_band").alias("orbit_band_id"),
        "inclination_deg",
        C.risk_score(F.col("object_type") == "DEBRIS", F.col("eccentricity"), F.col("mean_motion")).alias(
            "debris_risk_score"
        ),
    )


def derived_candidates(states: DataFrame, as_of: dt.date) -> DataFrame:
    """Every object once per day of the window, with its band's default altitude and velocity."""
    spread = with_days(states, F.lit(window_start(as_of)), F.lit(as_of), "observation_day")
    band = F.col("orbit_band_id")
    return spread.withColumns(
        {
            "source_id": F.lit(K.DERIVED_SOURCE_ID).cast("bigint"),
            "altitude_km": C.default_altitude_of_band(band),
            "velocity_km_s": C.default_velocity_of_band(band),
            "latitude": F.lit(None).cast("double"),
            "longitude": F.lit(None).cast("double"),
            "object_count": F.lit(1).cast("bigint"),
        }
    )


def new_derived_observations(
    facts: DataFrame,
    dim_space_object: DataFrame,
    stg_registry: DataFrame,
    stg_gp: DataFrame,
    as_of: dt.date,
    after: Column | None = None,
) -> DataFrame:
    """Derived rows for the window's object-days that have neither a real nor the same derived row.

    Ids continue after the largest of ``facts``, or after ``after`` when ``facts`` is only the window.
    """
    timestamp = facts.schema["observation_timestamp"].dataType
    candidates = derived_candidates(object_states(dim_space_object, stg_registry, stg_gp), as_of).withColumn(
        "observation_timestamp", F.col("observation_day").cast(timestamp)
    )
    window = facts_in_window(facts, as_of)
    present = window.where(is_derived()).select("object_id", "observation_timestamp")
    fresh = candidates.join(real_days(window), ["object_id", "observation_day"], "left_anti").join(
        present, ["object_id", "observation_timestamp"], "left_anti"
    )
    order = [F.col("object_id"), F.col("observation_timestamp")]
    last = last_id(facts, "observation_id") if after is None else after
    numbered = global_row_number(fresh, order, "observation_id", last)
    return numbered.select(*schemas.FACT_OBSERVATION.names)


def facts_in_window(facts: DataFrame, as_of: dt.date) -> DataFrame:
    """Facts of the four-week window; reads only its partitions where the table is partitioned by day."""
    return facts.where(fact_day(facts).between(F.lit(window_start(as_of)), F.lit(as_of)))
