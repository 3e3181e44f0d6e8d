"""Time the reports and builds on a synthetic observation table of the documented size and above.

    python tools/scale.py [days] [objects] [--hot]

35,000 objects over 140 days are the documented 4.9 million rows. ``--hot`` gives one object a third of all rows.
Prints one line per step: seconds and rows. The table is written to a fresh folder under /tmp.
"""

from __future__ import annotations

import datetime as dt
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from orbitlake import schemas  # noqa: E402
from orbitlake.plans import analytics as A  # noqa: E402
from orbitlake.plans import dimensions as D  # noqa: E402
from orbitlake.plans import facts  # noqa: E402
from orbitlake.session import local_session  # noqa: E402

LAST = dt.date(2024, 5, 31)


def elements(spark: SparkSession, days: int, objects: int, hot: bool) -> DataFrame:
    """One element set per object and day; with ``hot``, a third of the rows are further epochs of object 7."""
    total = days * objects
    n = spark.range(total if not hot else total * 3 // 2)
    extra = F.col("id") >= total
    catalogue_id = F.when(extra, F.lit(7)).otherwise(F.col("id") % objects)
    back = F.when(extra, F.col("id") % days).otherwise(F.floor(F.col("id") / objects))
    epoch = F.timestamp_seconds(F.unix_timestamp(F.date_sub(F.lit(LAST), back.cast("int")).cast("timestamp")) + F.col("id") % 86400)
    group = F.element_at(F.array(*map(F.lit, ("active", "debris", "starlink", "geo"))), (catalogue_id % 4 + 1).cast("int"))
    return schemas.conform(
        n.select(
            F.concat(F.lit("OBJ "), catalogue_id).alias("object_name"),
            catalogue_id.alias("norad_id"),
            (epoch + F.make_dt_interval(secs=F.when(extra, F.col("id") % 1000000 / 1000000).otherwise(0).cast("decimal(18,6)"))).alias("epoch"),
            (F.col("id") % 180).cast("double").alias("inclination_deg"),
            ((F.col("id") % 1000) / 5000).alias("eccentricity"),
            ((F.col("id") % 160) / 10).alias("mean_motion"),
            group.alias("source_group"),
            F.lit(LAST).cast("timestamp").alias("imported_at"),
        ),
        schemas.STG_GP,
    )


def registry(spark: SparkSession, objects: int) -> DataFrame:
    n = spark.range(objects)
    classes = F.element_at(F.array(*map(F.lit, ("LEO", "MEO", "GEO", "HEO", "Elliptical"))), (F.col("id") % 5 + 1).cast("int"))
    return schemas.conform(
        n.select(
            F.col("id").alias("norad_id"),
            F.concat(F.lit("SAT "), "id").alias("satellite_name"),
            F.lit("X").alias("country"),
            F.concat(F.lit("OP "), F.col("id") % 900).alias("operator_name"),
            F.concat(F.lit("PURPOSE "), F.col("id") % 30).alias("purpose"),
            classes.alias("orbit_type"),
            F.lit("Operational").alias("operational_status"),
            F.lit(None).alias("launch_date"),
            F.lit(LAST).cast("timestamp").alias("imported_at"),
        ),
        schemas.STG_REGISTRY,
    )


def main() -> None:
    sizes = [int(a) for a in sys.argv[1:] if a.isdigit()]
    days, objects = (sizes + [140, 35000][len(sizes):])[:2]
    folder = tempfile.mkdtemp(prefix="scale-", dir="/tmp")
    spark = local_session(8, "scale", **{"spark.checkpoint.dir": f"{folder}/shared", "spark.sql.shuffle.partitions": "32"})
    spark.sparkContext.setLogLevel("ERROR")

    def step(name: str, make) -> DataFrame | None:
        started = time.perf_counter()
        made = make()
        path = f"{folder}/{name}"
        made.write.parquet(path)
        seconds = time.perf_counter() - started
        back = spark.read.schema(made.schema).parquet(path)
        print(f"{name:24} {seconds:8.2f}s {back.count():>12,} rows", flush=True)
        return back

    gp = step("stg_gp", lambda: elements(spark, days, objects, "--hot" in sys.argv))
    reg = step("stg_registry", lambda: registry(spark, objects))
    operators = step("dim_operator", lambda: D.build_dim_operator(reg))
    dim = step("dim_space_object", lambda: D.build_dim_space_object(gp, reg, operators))
    sources, bands = D.build_dim_source(spark), D.build_dim_orbit_band(spark)
    empty = spark.createDataFrame([], schemas.FACT_OBSERVATION)
    fact = step("fact_observation", lambda: facts.new_observations(empty, gp, dim, sources, reg))
    step("append_again", lambda: facts.new_observations(fact, gp, dim, sources, reg))
    late = LAST + dt.timedelta(days=14)
    derived = step("derived_fill", lambda: facts.new_derived_observations(fact, dim, reg, gp, late))
    whole = fact.unionByName(derived)
    step("prune_derived", lambda: facts.prune_derived(whole, late + dt.timedelta(days=1)))
    star = A.Star(whole, dim, operators, bands, sources, None, gp, reg, spark.createDataFrame([], schemas.STG_LAUNCH))
    for report in (
        A.orbit_rollup, A.daily_trend, A.operator_ranking, A.orbit_statistics, A.skyline_risk, A.purpose_distribution,
        A.source_coverage, A.dashboard_summary, A.orbit_class_count, A.altitude_by_type, A.source_latest_import,
        A.latest_position,
    ):
        step(report.__name__, lambda report=report: report(star))
    spark.stop()


if __name__ == "__main__":
    main()
