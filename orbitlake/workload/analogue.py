"""The warehouse tables expressed over the test tables.

Each table is a list of (column, SQL expression) over one source relation. The expressions are plain enough
to mean the same in Spark and in the oracle's SQL, so the mapping is stated once; the work on top of it is
stated twice. Every table covers its whole source.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.plans.dimensions import build_dim_orbit_band, build_dim_source
from orbitlake.schemas import table_schema
from orbitlake.session import configure

AS_OF = dt.date(2024, 1, 30)

# Columns of the test tables, so that opening one reads no file
TEST_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}

_BIG = "CAST({} AS BIGINT)"
_GROUP = (
    "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'debris' WHEN 'purchase' THEN 'geo' "
    "WHEN 'signup' THEN 'starlink' ELSE 'unlisted' END"
)
_CLASS = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'LEO' WHEN 'BUILDING' THEN 'MEO' WHEN 'FURNITURE' THEN 'GEO' "
    "WHEN 'HOUSEHOLD' THEN 'HEO' ELSE 'Elliptical' END"
)
_STATUS = (
    "CASE WHEN c_acctbal > 7000 THEN 'Operational' WHEN c_acctbal > 4000 THEN 'Inactive' "
    "WHEN c_acctbal > 2000 THEN 'Active' END"
)
_LAUNCH_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Launch Successful' WHEN 'O' THEN 'Launch Failure' ELSE 'Partial Success' END"
_PAYLOADS = "CAST(CASE WHEN o_totalprice >= 20000 THEN floor(o_totalprice / 100000) END AS BIGINT)"

# table: (source relation, [(column, expression), …])
TABLES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "fact_object_position_observation": (
        "events",
        [
            ("observation_id", "event_id"),
            # large values belong to objects the dimension does not know
            ("object_id", "CASE WHEN value > 200 THEN -1 - user_id ELSE user_id END"),
            (
                "orbit_band_id",
                _BIG.format(
                    "CASE WHEN value < 20 THEN 1 WHEN value < 60 THEN 2 WHEN value < 120 THEN 3 "
                    "WHEN value < 200 THEN 4 END"
                ),
            ),
            (
                "source_id",
                _BIG.format(
                    "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 "
                    "WHEN 'purchase' THEN 4 ELSE 900 END"
                ),
            ),
            ("observation_timestamp", "ts"),
            ("altitude_km", "CASE WHEN event_type <> 'view' THEN value * 100 END"),
            ("latitude", "CAST(NULL AS DOUBLE)"),
            ("longitude", "CAST(NULL AS DOUBLE)"),
            ("velocity_km_s", "CASE WHEN event_type = 'error' THEN value / 10 END"),
            ("inclination_deg", "CASE WHEN event_type <> 'signup' THEN value END"),
            ("object_count", _BIG.format("1")),
            (
                "debris_risk_score",
                "CAST(CASE WHEN event_type = 'click' THEN 0.90 WHEN value >= 100 THEN 0.75 "
                "WHEN value >= 60 THEN 0.50 ELSE 0.25 END AS DOUBLE)",
            ),
        ],
    ),
    "dim_space_object": (
        "customer",
        [
            ("object_id", "c_custkey"),
            ("norad_id", "c_custkey"),
            ("object_name", "c_name"),
            ("object_type", "CASE WHEN c_acctbal < 0 THEN 'DEBRIS' WHEN c_acctbal < 9000 THEN 'SATELLITE' END"),
            ("operational_status", _STATUS),
            ("purpose", "CASE WHEN c_acctbal < 8500 THEN c_mktsegment END"),
            ("launch_date", "CAST(NULL AS DATE)"),
            # some objects have no operator, some an operator the dimension does not know
            (
                "operator_id",
                _BIG.format(
                    "CASE WHEN c_acctbal < 500 THEN NULL WHEN c_acctbal > 9500 THEN 1000 + c_nationkey "
                    "ELSE c_nationkey END"
                ),
            ),
        ],
    ),
    "dim_operator": (
        "nation JOIN region ON n_regionkey = r_regionkey",
        [
            ("operator_id", _BIG.format("n_nationkey")),
            ("operator_name", "n_name"),
            ("operator_type", "'UNKNOWN'"),
            ("country", "r_name"),
        ],
    ),
    "fact_launch_event": (
        "orders",
        [
            ("launch_event_id", "o_orderkey + 1"),
            ("launch_id", "CAST(o_orderkey AS VARCHAR(32))"),
            ("source_id", _BIG.format("200")),
            ("launch_timestamp", "o_orderdate"),
            ("launch_name", "concat('LAUNCH-', CAST(o_orderkey AS VARCHAR(32)))"),
            ("provider_name", "CASE WHEN o_totalprice < 480000 THEN o_orderpriority END"),
            ("rocket_name", "concat('ROCKET-', o_orderstatus)"),
            ("launch_country", "'N/A'"),
            ("launch_status", _LAUNCH_STATUS),
            ("launch_site", "CAST(NULL AS VARCHAR(32))"),
            ("payload_count", _PAYLOADS),
            ("success_count", _BIG.format("CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END")),
        ],
    ),
    "stg_celestrak_objects": (
        "events",
        [
            ("object_name", "concat('OBJ-', CAST(user_id AS VARCHAR(32)))"),
            # rows of small value lack the catalogue id
            ("norad_id", "CASE WHEN value < 0.5 THEN NULL ELSE user_id END"),
            # whole hours, so that a key occurs more than once
            ("epoch", "CAST(date_trunc('hour', ts) AS {ts})"),
            ("inclination_deg", "value"),
            ("eccentricity", "value / 1000"),
            ("mean_motion", "value / 5"),
            ("source_group", _GROUP),
            ("imported_at", "ts"),
        ],
    ),
    "stg_ucs_satellites": (
        "customer JOIN nation ON c_nationkey = n_nationkey",
        [
            ("norad_id", "CASE WHEN c_acctbal < -900 THEN NULL ELSE c_custkey END"),
            ("satellite_name", "c_name"),
            ("country", "CASE WHEN c_acctbal < 9000 THEN n_name END"),
            ("operator_name", "CASE WHEN c_acctbal < 1000 THEN NULL ELSE n_name END"),
            ("purpose", "c_mktsegment"),
            ("orbit_type", "CASE WHEN c_acctbal < 9000 THEN " + _CLASS + " END"),
            ("operational_status", _STATUS),
            ("launch_date", "CAST(NULL AS DATE)"),
            ("imported_at", "CAST('2024-01-29 06:00:00' AS {ts})"),
        ],
    ),
    # rich customers of one segment have a second registry row that contradicts the first
    "stg_ucs_second": (
        "customer JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 2500 AND c_mktsegment = 'BUILDING'",
        [
            ("norad_id", "c_custkey"),
            ("satellite_name", "c_name"),
            ("country", "'SECOND'"),
            ("operator_name", "'SECOND'"),
            ("purpose", "'SECOND'"),
            ("orbit_type", "'HEO'"),
            ("operational_status", "CAST(NULL AS VARCHAR(32))"),
            ("launch_date", "CAST('2020-02-29' AS DATE)"),
            ("imported_at", "CAST('2024-01-29 07:00:00' AS {ts})"),
        ],
    ),
    "stg_launch_events": (
        "orders",
        [
            ("launch_id", "CAST(o_orderkey AS VARCHAR(32))"),
            ("launch_name", "concat('LAUNCH-', CAST(o_orderkey AS VARCHAR(32)))"),
            ("launch_date", "o_orderdate"),
            ("launch_provider", "CASE WHEN o_totalprice < 480000 THEN o_orderpriority END"),
            ("rocket_name", "concat('ROCKET-', o_orderstatus)"),
            ("launch_country", "'N/A'"),
            ("launch_status", _LAUNCH_STATUS),
            ("payload_count", _PAYLOADS),
            ("imported_at", "CAST('2024-01-29 08:00:00' AS {ts})"),
        ],
    ),
}

_SPARK_TS, _DUCK_TS = "TIMESTAMP_NTZ", "TIMESTAMP"


class Lake:
    """The test tables of one folder, and the warehouse tables over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(table_schema(TEST_TABLES[name])).parquet(f"{self.folder}/{name}.parquet")

    def _source(self, relation: str) -> DataFrame:
        tables = [t for t in ("events", "customer", "nation", "region", "orders") if t in relation.split()]
        if len(tables) == 1:
            return self.raw(relation)
        condition = relation.split(" ON ", 1)[1]
        left, right = (self.raw(t) for t in sorted(tables, key=relation.split().index))
        return left.join(right, F.expr(condition))

    def table(self, name: str) -> DataFrame:
        relation, columns = TABLES[name]
        expressions = (f"{e.replace('{ts}', _SPARK_TS)} AS {c}" for c, e in columns)
        df = self._source(relation).selectExpr(*expressions)
        return df.unionByName(self.table("stg_ucs_second")) if name == "stg_ucs_satellites" else df

    @cached_property
    def star(self) -> LakeStar:
        return LakeStar(self)


class LakeStar:
    """The analogue ``Star``; a table is opened when a report first asks for it."""

    def __init__(self, lake: Lake):
        self._lake = lake

    def __getattr__(self, name: str) -> DataFrame:
        if name in _STAR_TABLES:
            table = self._lake.table(_STAR_TABLES[name])
        elif name in ("bands", "sources"):
            table = {"bands": build_dim_orbit_band, "sources": build_dim_source}[name](self._lake.spark)
        else:
            raise AttributeError(name)
        setattr(self, name, table)
        return table


_STAR_TABLES = {
    "observations": "fact_object_position_observation",
    "objects": "dim_space_object",
    "operators": "dim_operator",
    "launches": "fact_launch_event",
    "stg_gp": "stg_celestrak_objects",
    "stg_registry": "stg_ucs_satellites",
    "stg_launch": "stg_launch_events",
}


def duck_cte(name: str) -> str:
    """``name AS (SELECT …)`` for the oracle's WITH clause."""
    relation, columns = TABLES[name]

    def select(table: str) -> str:
        source, listed = TABLES[table]
        return "SELECT " + ", ".join(f"{e.replace('{ts}', _DUCK_TS)} AS {c}" for c, e in listed) + f" FROM {source}"

    body = select(name)
    if name == "stg_ucs_satellites":
        body += " UNION ALL " + select("stg_ucs_second")
    return f"{name} AS ({body})"
