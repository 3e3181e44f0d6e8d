"""The reports over the star schema.

Facts first shrink to one row per object and band (partial sums, combined before the shuffle), and only
those totals meet the object and operator dimensions. An object with very many observations is therefore
one row in every join, and no join moves the facts themselves. The band and source dimensions are the
fixed four and nine rows and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake.functions import classify as C
from orbitlake.functions import geometry as G
from orbitlake.operators.exact import exact_mean, exact_sum
from orbitlake.operators.keyed import latest_per_key
from orbitlake.operators.numbering import global_dense_rank, systematic_sample, top_dense_rank
from orbitlake.operators.skyline import skyline
from orbitlake.workspace import write_through


@dataclass(frozen=True)
class Star:
    """The warehouse tables the reports read."""

    observations: DataFrame
    objects: DataFrame
    operators: DataFrame
    bands: DataFrame
    sources: DataFrame
    launches: DataFrame | None = None
    stg_gp: DataFrame | None = None
    stg_registry: DataFrame | None = None
    stg_launch: DataFrame | None = None


# --- shared partial totals -----------------------------------------------------------------------

_TOTALS = {
    "n_rows": F.count,
    "n_objects": F.sum,
    "risk_sum": F.sum,
    "risk_units": F.sum,
    "risk_n": F.count,
    "altitude_sum": F.sum,
    "altitude_n": F.count,
}


def object_band_totals(star: Star) -> DataFrame:
    """Facts summed per object and band: the common input of most reports."""
    return star.observations.groupBy("object_id", "orbit_band_id").agg(
        F.count("*").alias("n_rows"),
        F.sum("object_count").cast("bigint").alias("n_objects"),
        F.sum("debris_risk_score").alias("risk_sum"),
        exact_sum(F.col("debris_risk_score")).alias("risk_units"),
        F.count("debris_risk_score").alias("risk_n"),
        F.sum("altitude_km").alias("altitude_sum"),
        F.count("altitude_km").alias("altitude_n"),
    )


def _objects_sum() -> Column:
    return F.sum("n_objects").cast("bigint").alias("object_count")


def _mean_risk(name: str = "average_risk_score") -> Column:
    return (F.sum("risk_sum") / F.nullif(F.sum("risk_n"), F.lit(0))).alias(name)


def _with_band(df: DataFrame, star: Star) -> DataFrame:
    return df.join(F.broadcast(star.bands.select("orbit_band_id", "orbit_class")), "orbit_band_id", "left")


def _with_operator(totals: DataFrame, star: Star) -> DataFrame:
    """Object totals summed per operator id (inner join to the objects), then named.

    The second sum makes the operator join a join of operators with operators.
    """
    keys = [c for c in totals.columns if c not in (*_TOTALS, "object_id")]
    objects = star.objects.select("object_id", "operator_id")
    per_operator = (
        totals.join(objects, "object_id")
        .groupBy("operator_id", *keys)
        .agg(*(F.sum(c).alias(c) for c in ("n_objects", "risk_sum", "risk_units", "risk_n")))
    )
    return per_operator.join(star.operators.select("operator_id", "operator_name", "country"), "operator_id", "left")


def _most_first(*ties: str) -> list[Column]:
    return [F.col("object_count").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ties)]


# --- the seven analyses --------------------------------------------------------------------------


def orbit_rollup(star: Star, totals: DataFrame | None = None, limit: int | None = K.ROLLUP_ROWS) -> DataFrame:
    """Objects and mean risk per class and type, with subtotals per class and the grand total.

    A missing class or type carries the same label as a subtotal; ``all_orbits`` and ``all_object_types``
    (1 on subtotal rows) tell them apart.
    """
    totals = object_band_totals(star) if totals is None else totals
    typed = _with_band(totals, star).join(star.objects.select("object_id", "object_type"), "object_id", "left")
    cells = typed.groupBy("orbit_class", "object_type").agg(
        F.sum("n_objects").alias("n_objects"), F.sum("risk_sum").alias("risk_sum"), F.sum("risk_n").alias("risk_n")
    )
    orbit_class, kind = F.col("orbit_class"), F.col("object_type")
    rolled = cells.groupingSets([[orbit_class, kind], [orbit_class], []], orbit_class, kind).agg(
        _objects_sum(),
        _mean_risk(),
        F.grouping("orbit_class").cast("bigint").alias("all_orbits"),
        F.grouping("object_type").cast("bigint").alias("all_object_types"),
    )
    labelled = rolled.select(
        C.labelled(orbit_class, K.ALL_ORBITS).alias("orbit_class"),
        C.labelled(kind, K.ALL_OBJECT_TYPES).alias("object_type"),
        "object_count",
        "average_risk_score",
        "all_orbits",
        "all_object_types",
    )
    ordered = labelled.orderBy(*_most_first("orbit_class", "object_type", "all_orbits", "all_object_types"))
    return ordered if limit is None else ordered.limit(limit)


def daily_counts(star: Star) -> DataFrame:
    observed = star.observations.where(F.col("observation_timestamp").isNotNull())
    return observed.groupBy(F.to_date("observation_timestamp").alias("observation_date")).agg(
        F.sum("object_count").cast("bigint").alias("object_count")
    )


def daily_trend(star: Star, limit: int | None = K.TREND_ROWS) -> DataFrame:
    """Objects per day with the mean of the last seven days that have any.

    The window spans the calendar days of the facts, one row each, whatever the size of the facts.
    """
    last_rows = Window.orderBy("observation_date").rowsBetween(1 - K.TREND_WINDOW_ROWS, Window.currentRow)
    trend = daily_counts(star).withColumn("moving_average_object_count", F.avg("object_count").over(last_rows))
    newest = F.col("observation_date").desc_nulls_last()
    return trend.orderBy("observation_date") if limit is None else trend.orderBy(newest).limit(limit)


def operator_counts(star: Star, totals: DataFrame | None = None) -> DataFrame:
    totals = object_band_totals(star) if totals is None else totals
    named = _with_operator(totals.drop("orbit_band_id"), star)
    return named.groupBy(
        C.labelled(F.col("operator_name")).alias("operator_name"), C.labelled(F.col("country")).alias("country")
    ).agg(_objects_sum(), _mean_risk())


def operator_ranking(star: Star, totals: DataFrame | None = None, limit: int | None = K.RANKING_ROWS) -> DataFrame:
    """Operators by observed objects: the first ten rows, or every operator with ``limit=None``."""
    counts = operator_counts(star, totals)
    if limit is None:
        return global_dense_rank(write_through(counts, "operators"), "object_count", "operator_rank")
    return top_dense_rank(counts, "object_count", ["operator_name", "country"], limit, "operator_rank")


def orbit_statistics(star: Star) -> DataFrame:
    """Count, mean and population deviation of altitude, mean risk per class."""
    return (
        _with_band(star.observations, star)
        .groupBy(C.labelled(F.col("orbit_class")).alias("orbit_class"))
        .agg(
            F.sum("object_count").cast("bigint").alias("object_count"),
            F.avg("altitude_km").alias("average_altitude_km"),
            F.stddev_pop("altitude_km").alias("altitude_stddev_km"),
            F.avg("debris_risk_score").alias("average_risk_score"),
        )
        .orderBy(*_most_first("orbit_class"))
    )


def risk_groups(star: Star, totals: DataFrame | None = None) -> DataFrame:
    """Objects and mean risk per class and operator. The mean comes from an exact sum, so that the order in which tasks
    add up decides no comparison between groups.
    """
    totals = object_band_totals(star) if totals is None else totals
    named = _with_band(_with_operator(totals, star), star)
    return (
        named.groupBy(
            C.labelled(F.col("orbit_class")).alias("orbit_class"),
            C.labelled(F.col("operator_name")).alias("operator_name"),
        )
        .agg(_objects_sum(), F.coalesce(exact_mean(F.sum("risk_units"), F.sum("risk_n")), F.lit(0.0)).alias("average_risk_score"))
    )


def skyline_risk(star: Star, totals: DataFrame | None = None, limit: int | None = K.SKYLINE_ROWS) -> DataFrame:
    """Class and operator pairs not beaten in both objects and mean risk."""
    groups = write_through(risk_groups(star, totals), "risk-groups")
    ordered = skyline(groups, "object_count", "average_risk_score").orderBy(
        F.col("average_risk_score").desc_nulls_last(), *_most_first("orbit_class", "operator_name")
    )
    return ordered if limit is None else ordered.limit(limit)


def purpose_distribution(star: Star, totals: DataFrame | None = None, limit: int | None = K.PURPOSE_ROWS) -> DataFrame:
    ordered = purpose_risk(star, totals).drop("average_risk_score")
    return ordered if limit is None else ordered.limit(limit)


def purpose_risk(star: Star, totals: DataFrame | None = None) -> DataFrame:
    """Objects and mean risk per purpose, all purposes."""
    totals = object_band_totals(star) if totals is None else totals
    return (
        totals.join(star.objects.select("object_id", "purpose"), "object_id")
        .groupBy(C.labelled(F.col("purpose")).alias("purpose"))
        .agg(_objects_sum(), _mean_risk())
        .orderBy(*_most_first("purpose"))
    )


def source_coverage(star: Star) -> DataFrame:
    """Observations and last observation per source; sources without facts stay with a count of 0."""
    per_source = star.observations.groupBy("source_id").agg(
        F.count("observation_id").alias("n"), F.max("observation_timestamp").alias("last")
    )
    return (
        star.sources.join(per_source, "source_id", "left")
        .groupBy("source_name")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("observation_count"),
            F.max("last").alias("last_observation_timestamp"),
        )
        .orderBy(F.col("observation_count").desc(), F.col("source_name").asc_nulls_last())
    )


def analytics(star: Star) -> dict[str, DataFrame]:
    """All seven analyses; the object totals four of them share are computed and written once."""
    totals = write_through(object_band_totals(star), "object-totals")
    return {
        "orbit_rollup": orbit_rollup(star, totals),
        "daily_trend": daily_trend(star),
        "operator_ranking": operator_ranking(star, totals),
        "orbit_statistics": orbit_statistics(star),
        "skyline_risk": skyline_risk(star, totals),
        "purpose_distribution": purpose_distribution(star, totals),
        "source_coverage": source_coverage(star),
    }


# --- dashboard -----------------------------------------------------------------------------------


def dashboard_summary(star: Star, strict: bool = False) -> DataFrame:
    """One row, also over empty tables: objects, active satellites, debris, last import."""

    def how_many(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")

    last_import = star.stg_gp.agg(F.max("imported_at")).scalar()
    return star.objects.agg(
        F.count("*").alias("total_objects"),
        how_many(C.is_active(F.col("operational_status"), strict)).alias("active_satellites"),
        how_many(C.is_debris(F.col("object_type"))).alias("debris_objects"),
    ).withColumn("last_import_timestamp", last_import)


def orbit_class_count(star: Star) -> DataFrame:
    """Fact rows per class: counted per band id first, then labelled."""
    per_band = star.observations.groupBy("orbit_band_id").agg(F.count("*").alias("n"))
    return (
        _with_band(per_band, star)
        .groupBy(C.labelled(F.col("orbit_class")).alias("orbit_class"))
        .agg(F.sum("n").cast("bigint").alias("object_count"))
        .orderBy(*_most_first("orbit_class"))
    )


def altitude_by_type(star: Star, totals: DataFrame | None = None) -> DataFrame:
    totals = object_band_totals(star) if totals is None else totals
    return (
        totals.join(star.objects.select("object_id", "object_type"), "object_id")
        .groupBy(C.labelled(F.col("object_type")).alias("object_type"))
        .agg((F.sum("altitude_sum") / F.nullif(F.sum("altitude_n"), F.lit(0))).alias("average_altitude_km"))
        .orderBy(F.col("object_type").asc_nulls_last())
    )


def source_latest_import(star: Star) -> DataFrame:
    """All sources with their latest import: one grouped pass over the element-set staging in place of a
    scalar subquery per source, plus one row each for registry, launches and derived facts.
    """

    def one(df: DataFrame, column: str, source_id: int) -> DataFrame:
        return df.agg(F.max(column).alias("last_import_timestamp")).select(
            F.lit(source_id).cast("bigint").alias("source_id"), "last_import_timestamp"
        )

    group_name = F.concat(F.lit(K.GP_SOURCE_PREFIX), F.col("source_group"))
    per_group = star.stg_gp.groupBy("source_group").agg(F.max("imported_at").alias("last_import_timestamp"))
    gp_sources = star.sources.where(F.col("source_type") == "CELESTRAK_GP_JSON").select("source_id", "source_name")
    gp = per_group.join(F.broadcast(gp_sources), group_name == F.col("source_name")).select(
        "source_id", "last_import_timestamp"
    )
    derived = star.observations.where(F.col("source_id") == K.DERIVED_SOURCE_ID)
    latest = (
        gp.unionByName(one(star.stg_registry, "imported_at", K.REGISTRY_SOURCE_ID))
        .unionByName(one(star.stg_launch, "imported_at", K.LAUNCH_SOURCE_ID))
        .unionByName(one(derived, "observation_timestamp", K.DERIVED_SOURCE_ID))
    )
    return star.sources.join(latest, "source_id", "left").orderBy("source_id")


# --- latest positions ----------------------------------------------------------------------------


def latest_observations(star: Star) -> DataFrame:
    """Newest real observation per object, the newest derived one where there is no real one."""
    # a row of unknown source counts as real here
    derived_last = F.when(F.col("source_id") == K.DERIVED_SOURCE_ID, 1).otherwise(0)
    order = [derived_last, F.col("observation_timestamp").desc_nulls_last(), F.col("observation_id").asc()]
    columns = [
        "observation_id",
        "object_id",
        "orbit_band_id",
        "source_id",
        "observation_timestamp",
        "altitude_km",
        "velocity_km_s",
        "inclination_deg",
        "debris_risk_score",
    ]
    return latest_per_key(star.observations.select(*columns), ["object_id"], order).drop("observation_id")


def latest_position(star: Star, ordered: bool = True) -> DataFrame:
    """Last known position of every object, with band defaults and labels."""
    objects = star.objects.select("object_id", "norad_id", "object_name", "object_type", "purpose", "operator_id")
    joined = (
        _with_band(latest_observations(star), star)
        .join(F.broadcast(star.sources.select("source_id", "source_name")), "source_id", "left")
        .join(objects, "object_id")
        .join(star.operators.select("operator_id", "operator_name"), "operator_id", "left")
    )
    orbit_class = F.col("orbit_class")
    positions = joined.select(
        "object_id",
        "norad_id",
        C.labelled(F.col("object_name")).alias("object_name"),
        C.labelled(F.col("object_type")).alias("object_type"),
        C.labelled(orbit_class).alias("orbit_class"),
        F.coalesce("altitude_km", C.default_altitude(orbit_class)).alias("altitude_km"),
        F.coalesce("velocity_km_s", C.default_velocity(orbit_class)).alias("velocity_km_s"),
        "inclination_deg",
        "debris_risk_score",
        C.labelled(F.col("source_name")).alias("source_name"),
        C.labelled(F.col("operator_name")).alias("operator_name"),
        C.labelled(F.col("purpose")).alias("purpose"),
        "observation_timestamp",
    )
    return positions.orderBy("object_id") if ordered else positions


def scene_coordinates(positions: DataFrame) -> DataFrame:
    """Where each object of ``latest_position`` is drawn: ring radius, angles, point and size."""
    object_id = F.col("object_id")
    node_id = object_id * K.NODE_MULTIPLIER + K.NODE_OFFSET
    tilt = F.coalesce("inclination_deg", G.default_inclination(F.col("orbit_class")))
    placed = positions.withColumns(
        {
            "radius": G.scene_radius(F.col("altitude_km")),
            "inclination": F.radians(tilt),
            "phase": G.turn(G.hash01(object_id)),
            "node": G.turn(G.hash01(node_id)),
            "scale": F.when(C.is_debris(F.col("object_type")), F.lit(K.SCENE_DEBRIS_SCALE)).otherwise(F.lit(1.0)),
        }
    )
    point = G.ring_position(F.col("radius"), F.col("inclination"), F.col("phase"), F.col("node"))
    return placed.select(
        "object_id", "object_type", "orbit_class", "radius", "inclination", "phase", "node", "scale",
        *(c.alias(n) for n, c in point.items()),
    )


def sampled_rings(positions: DataFrame, target: int = K.SAMPLE_TARGET) -> DataFrame:
    """The objects whose rings are drawn: a systematic sample in id order, with the ring's rotation."""
    sampled = systematic_sample(positions, [F.col("object_id")], target)
    tilt = F.coalesce("inclination_deg", G.default_inclination(F.col("orbit_class")))
    return sampled.select(
        "position",
        "object_id",
        "orbit_class",
        G.scene_radius(F.col("altitude_km")).alias("radius"),
        tilt.alias("inclination_deg"),
        G.turn(G.hash01(F.col("object_id"))).alias("rotation"),
    )


# --- documented variants -------------------------------------------------------------------------


def inclination_statistics(star: Star) -> DataFrame:
    return (
        _with_band(star.observations, star)
        .groupBy(C.labelled(F.col("orbit_class")).alias("orbit_class"))
        .agg(
            F.sum("object_count").cast("bigint").alias("object_count"),
            F.avg("inclination_deg").alias("average_inclination_deg"),
            F.stddev_pop("inclination_deg").alias("inclination_stddev_deg"),
            F.avg("debris_risk_score").alias("average_risk_score"),
        )
        .orderBy(*_most_first("orbit_class"))
    )


def launch_activity(star: Star) -> DataFrame:
    """Launches, payloads and successes per provider and status."""

    def total(column: str) -> Column:
        return F.sum(F.coalesce(column, F.lit(0))).cast("bigint").alias(column)

    return (
        star.launches.groupBy(
            C.labelled(F.col("provider_name")).alias("provider_name"),
            C.labelled(F.col("launch_status")).alias("launch_status"),
        )
        .agg(F.count("*").alias("launch_count"), total("payload_count"), total("success_count"))
        .orderBy(F.col("launch_count").desc(), "provider_name", "launch_status")
    )


def present(df: DataFrame) -> DataFrame:
    """For display: NULL text becomes empty and NULL counts become 0; measures stay NULL."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    counts = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long")]
    return df.na.fill("", texts).na.fill(0, counts)
