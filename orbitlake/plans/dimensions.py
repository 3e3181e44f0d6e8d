"""Dimension builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.functions.classify import labelled, object_type
from orbitlake.operators.keyed import upsert
from orbitlake.operators.numbering import global_row_number


def constant_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A few fixed rows as a local relation, so that Spark knows how small it is."""

    def literal(value) -> str:
        if value is None:
            return "NULL"
        return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else str(value)

    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return schemas.conform(spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(schema.names)})"), schema)


def build_dim_source(spark: SparkSession) -> DataFrame:
    return constant_table(spark, K.DIM_SOURCE_ROWS, schemas.DIM_SOURCE)


def build_dim_orbit_band(spark: SparkSession) -> DataFrame:
    return constant_table(spark, K.DIM_ORBIT_BAND_ROWS, schemas.DIM_ORBIT_BAND)


def build_dim_operator(stg_registry: DataFrame) -> DataFrame:
    """One row per operator that wins for at least one catalogue id, numbered in name order."""
    per_id = (
        stg_registry.where(F.col("norad_id").isNotNull())
        .groupBy("norad_id")
        .agg(F.max("operator_name").alias("operator_name"), F.max("country").alias("country"))
    )
    operators = per_id.groupBy(labelled(F.col("operator_name")).alias("operator_name")).agg(
        F.max("country").alias("country")
    )
    numbered = global_row_number(operators, [F.col("operator_name")], "operator_id")
    return schemas.conform(numbered.withColumn("operator_type", F.lit(K.UNKNOWN)), schemas.DIM_OPERATOR)


def fuse_objects(stg_gp: DataFrame, stg_registry: DataFrame, dim_operator: DataFrame) -> DataFrame:
    """One row per catalogue id: element-set facts joined with the registry's attributes.

    Both many-row sides are reduced to one row per id before they meet; only maxima are taken, so the
    result is that of joining first.
    """
    elements = (
        stg_gp.where(F.col("norad_id").isNotNull())
        .groupBy("norad_id")
        .agg(
            F.max("object_name").alias("object_name"),
            F.max("source_group").alias("source_group"),
            F.max(F.col("source_group") == "active").alias("ever_active"),
        )
    )
    registry = (
        stg_registry.where(F.col("norad_id").isNotNull())
        .groupBy("norad_id", "operator_name")
        .agg(
            F.max("operational_status").alias("operational_status"),
            F.max("purpose").alias("purpose"),
            F.max("launch_date").alias("launch_date"),
        )
    )
    with_operator = elements.join(registry, "norad_id", "left").join(
        dim_operator.select("operator_id", F.col("operator_name").alias("_operator")),
        labelled(F.col("operator_name")) == F.col("_operator"),
        "left",
    )
    return with_operator.groupBy("norad_id").agg(
        F.max("object_name").alias("object_name"),
        F.max("source_group").alias("source_group"),
        F.max("ever_active").alias("ever_active"),
        F.max("operational_status").alias("operational_status"),
        F.max("purpose").alias("purpose"),
        F.max("launch_date").alias("launch_date"),
        F.max("operator_id").alias("operator_id"),
    )


def harmonised_objects(stg_gp: DataFrame, stg_registry: DataFrame) -> DataFrame:
    """Name, operator and class per catalogue id: both sources reduced to one row per id, then joined."""
    names = stg_gp.where(F.col("norad_id").isNotNull()).groupBy("norad_id").agg(F.max("object_name").alias("object_name"))
    registry = (
        stg_registry.where(F.col("norad_id").isNotNull())
        .groupBy("norad_id")
        .agg(F.max("operator_name").alias("operator_name"), F.max("orbit_type").alias("orbit_type"))
    )
    return names.join(registry, "norad_id", "left")


def _as_dim_space_object(fused: DataFrame, status: Column) -> DataFrame:
    return schemas.conform(
        fused.withColumns(
            {
                "object_id": F.col("norad_id"),
                "object_type": object_type(F.col("source_group")),
                "operational_status": status,
            }
        ),
        schemas.DIM_SPACE_OBJECT,
    )


def build_dim_space_object(stg_gp: DataFrame, stg_registry: DataFrame, dim_operator: DataFrame) -> DataFrame:
    """Full rebuild: an object without a registry status is ACTIVE when it was ever in the active group."""
    status = F.coalesce("operational_status", F.when(F.col("ever_active"), F.lit("ACTIVE")))
    return _as_dim_space_object(fuse_objects(stg_gp, stg_registry, dim_operator), status)


def upsert_dim_space_object(
    dim_space_object: DataFrame, stg_gp: DataFrame, stg_registry: DataFrame, dim_operator: DataFrame
) -> DataFrame:
    """Merge variant: matched objects are refreshed, new ones inserted, vanished ones kept. The status is the
    registry's alone.
    """
    source = _as_dim_space_object(fuse_objects(stg_gp, stg_registry, dim_operator), F.col("operational_status"))
    refreshed = ["object_name", "object_type", "operational_status", "purpose", "launch_date", "operator_id"]
    return upsert(dim_space_object, source, "norad_id", refreshed)
