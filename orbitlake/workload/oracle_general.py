"""Plain SQL for the operators at size, the sources and the runs."""

from __future__ import annotations

from orbitlake.workload import oracle as O
from orbitlake.workload.rawtext import DOWNLOADED

_LINE = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_FEED = (
    "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'debris' WHEN 'purchase' THEN 'geo' "
    "WHEN 'signup' THEN 'starlink' ELSE 'unlisted' END"
)
_PROVIDER = "CASE WHEN o_totalprice < 480000 THEN o_orderpriority END"
_FALLBACK = (
    "upper(sha256(lower('LAUNCH-' || CAST(o_orderkey AS VARCHAR) || '|' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.0000000') "
    f"|| '+00:00|' || coalesce({_PROVIDER}, ''))))"
)


def _downloaded(key: str) -> str:
    return f"TIMESTAMP '{DOWNLOADED}' + to_minutes(CAST({key} // 1000 AS INTEGER))"


def _parsed_gp(epoch: str, where: str) -> str:
    return f"""SELECT 'OBJ-' || CAST(user_id AS VARCHAR) AS object_name, user_id AS norad_id, {epoch} AS epoch,
             value AS inclination_deg, value / 1000 AS eccentricity, value / 5 AS mean_motion, {_FEED} AS source_group,
             {_downloaded("event_id")} AS imported_at
      FROM events WHERE value >= 0.5 {where}"""


def _parsed_registry(name: str) -> str:
    return f"""SELECT CASE WHEN c_acctbal >= -900 THEN c_custkey END AS norad_id, {name} AS satellite_name, n_name AS country,
             CASE WHEN c_acctbal >= 1000 THEN n_name END AS operator_name, c_mktsegment AS purpose,
             CASE c_mktsegment WHEN 'BUILDING' THEN 'MEO' WHEN 'AUTOMOBILE' THEN 'LEO' ELSE 'GEO' END AS orbit_type,
             CASE WHEN c_acctbal > 7000 THEN 'Operational' END AS operational_status,
             DATE '2000-01-01' + CAST(floor(abs(c_acctbal)) AS INTEGER) AS launch_date"""


_REGISTRY_NAME = "c_name || ', \"' || lower(c_mktsegment) || '\";' || chr(10) || ' block'"
_CUSTOMER_NATION = "FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _operators() -> dict[str, str]:
    return {
        "global_row_number": f"""SELECT {_LINE}, CAST(row_number() OVER (ORDER BY {_LINE}) AS BIGINT) AS row_number
            FROM lineitem""",
        "latest_per_key": f"""SELECT {_LINE} FROM lineitem QUALIFY row_number() OVER (
              PARTITION BY l_partkey
              ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1""",
        "global_dense_rank": """SELECT l_suppkey, count(*) AS n_lines,
              CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS supplier_rank FROM lineitem GROUP BY 1""",
        "skyline_parts": """WITH parts AS (
              SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pieces,
                     round(avg(l_discount), 9) AS mean_discount FROM lineitem GROUP BY 1)
            SELECT * FROM parts p WHERE NOT EXISTS (
              SELECT 1 FROM parts d WHERE d.pieces >= p.pieces AND d.mean_discount >= p.mean_discount
                AND (d.pieces > p.pieces OR d.mean_discount > p.mean_discount))""",
        "skyline_parts_in_three": """WITH parts AS (
              SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pieces,
                     round(avg(l_discount), 9) AS mean_discount, max(CAST(l_shipdate AS DATE)) AS last_day
              FROM lineitem GROUP BY 1)
            SELECT * FROM parts p WHERE NOT EXISTS (
              SELECT 1 FROM parts d
              WHERE d.pieces >= p.pieces AND d.mean_discount >= p.mean_discount AND d.last_day >= p.last_day
                AND (d.pieces > p.pieces OR d.mean_discount > p.mean_discount OR d.last_day > p.last_day))""",
        "gap_fill_parts": """WITH shipped AS (SELECT DISTINCT l_partkey, CAST(l_shipdate AS DATE) AS day FROM lineitem),
            spread AS (SELECT l_partkey, max(day) AS last_day,
                         CAST(unnest(generate_series(max(day) - 27, max(day), INTERVAL 1 DAY)) AS DATE) AS day
                       FROM shipped GROUP BY 1)
            SELECT l_partkey, day, last_day FROM spread
            WHERE (l_partkey, day) NOT IN (SELECT (l_partkey, day) FROM shipped)""",
        "systematic_sample": """SELECT CAST(position AS BIGINT) AS position, o_orderkey, o_custkey
            FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS position, count(*) OVER () AS n
                  FROM orders)
            WHERE (position - 1) % greatest(1, n // least(n, 360)) = 0""",
        "append_missing": """SELECT DISTINCT CAST(ts AS DATE) AS day, user_id AS who FROM events
            UNION SELECT DISTINCT CAST(o_orderdate AS DATE), o_custkey FROM orders""",
        "distinct_keys": "SELECT DISTINCT lang, source FROM documents",
    }


def _sources() -> dict[str, str]:
    tle_day = "floor(abs(c_acctbal) / 30) + 1.5"
    tle_year = "CASE WHEN c_nationkey + 40 >= 57 THEN 1900 ELSE 2000 END + c_nationkey + 40"
    tle_id = "CAST(c_custkey % 100000 AS INTEGER) AS norad_id"
    page_text = "SELECT html AS body, 'celestrak-stations-json' AS source_name FROM pages"
    document_text = "SELECT text AS body, 'celestrak-' || source || '-json' AS source_name FROM documents"
    sql = {
        "gp_roundtrip": _parsed_gp("ts", ""),
        "gp_rejects": """SELECT 'celestrak-' || CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'fengyun-1c-debris'
              WHEN 'purchase' THEN 'geo' WHEN 'signup' THEN 'starlink' ELSE 'unlisted' END AS source_name,
              'missing required field' AS reason, count(*) AS n
            FROM events WHERE value < 0.5 GROUP BY 1""",
        "launch_roundtrip": f"""SELECT CASE WHEN o_orderstatus = 'P' THEN {_FALLBACK} ELSE CAST(o_orderkey AS VARCHAR) END AS launch_id,
              'LAUNCH-' || CAST(o_orderkey AS VARCHAR) AS launch_name, o_orderdate AS launch_date,
              {_PROVIDER} AS launch_provider, 'ROCKET-' || o_orderstatus AS rocket_name, 'N/A' AS launch_country,
              CASE o_orderstatus WHEN 'F' THEN 'Launch Successful' WHEN 'O' THEN 'Launch Failure' ELSE 'Partial Success' END
                AS launch_status,
              CAST(CASE WHEN o_totalprice >= 20000 THEN floor(o_totalprice / 100000) END AS BIGINT) AS payload_count,
              {_downloaded("o_orderkey")} AS imported_at
            FROM orders""",
        "ucs_roundtrip": _parsed_registry(_REGISTRY_NAME)
        + f", {_downloaded('c_custkey')} AS imported_at {_CUSTOMER_NATION}",
        "workbook_roundtrip": _parsed_registry("c_name")
        + f", TIMESTAMP '{DOWNLOADED}' AS imported_at {_CUSTOMER_NATION}",
        "tle_roundtrip": f"""SELECT c_name AS object_name, {tle_id}, 'U' AS classification, '98067A' AS international_designator,
              CAST(c_nationkey + 40 AS INTEGER) AS epoch_year, CAST({tle_day} AS DOUBLE) AS epoch_day,
              make_timestamp({tle_year}, 1, 1, 12, 0, 0) + to_days(CAST(floor(abs(c_acctbal) / 30) AS INTEGER)) AS epoch,
              round(abs(c_acctbal) / 100, 4) AS inclination_deg,
              CAST('0.' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS DOUBLE) AS eccentricity,
              round(abs(c_acctbal) / 1000, 8) AS mean_motion
            FROM customer WHERE c_acctbal <= 9000""",
        "tle_catalogue_roundtrip": f"""SELECT c_name AS satellite_name, {tle_id}, CAST(98 AS INTEGER) AS designator_year,
              CAST(67 AS INTEGER) AS designator_launch_number, 'A' AS designator_piece,
              CAST(c_nationkey + 40 AS INTEGER) AS epoch_year, CAST({tle_day} AS DOUBLE) AS epoch_day
            FROM customer WHERE c_acctbal <= 9000""",
        "ucs_split_roundtrip": _parsed_registry(_REGISTRY_NAME) + f" {_CUSTOMER_NATION}",
        "raw_archive": f"""SELECT 'spacedevs-recent-launches' AS source_name,
              CAST({_downloaded("o_orderkey")} AS DATE) AS ingest_date, count(DISTINCT (o_orderstatus, o_orderkey // 1000)) AS n_files
            FROM orders GROUP BY 2
            UNION ALL SELECT 'ucs-satellite-database', CAST({_downloaded("c_custkey")} AS DATE),
              count(DISTINCT (c_mktsegment, c_custkey // 1000)) FROM customer GROUP BY 2""",
        "latest_raw_snapshot": """SELECT DISTINCT 'celestrak-' || CASE event_type WHEN 'view' THEN 'active'
              WHEN 'click' THEN 'fengyun-1c-debris' WHEN 'purchase' THEN 'geo' WHEN 'signup' THEN 'starlink' ELSE 'unlisted' END
              AS source_name, '.txt' AS extension FROM events
            UNION ALL SELECT 'spacedevs-recent-launches', '.txt'""",
        "content_gate": f"""SELECT source_name, CASE WHEN left(ltrim(body, ' \n\r\t'), 1) NOT IN ('[', '{{') THEN 'not json'
                WHEN left(ltrim(body, ' \n\r\t'), 1) <> '[' THEN 'not an array' ELSE 'malformed json' END AS reason, count(*) AS n
            FROM ({page_text} UNION ALL {document_text}) GROUP BY 1, 2""",
        "table_gate": """SELECT 'celestrak-stations-json' AS source_name, 'html' AS reason, count(*) AS n FROM pages
            WHERE regexp_matches(lower(html), '^[^\\r\\n]*(<html|<!doctype)')""",
        "source_group": """SELECT source_group, count(*) AS n FROM (
              SELECT 'stations' AS source_group FROM pages UNION ALL SELECT 'debris' FROM documents) GROUP BY 1""",
        "fallback_launch_id": f"SELECT o_orderkey, {_FALLBACK} AS launch_id FROM orders",
        "lenient_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
        "staging_csv_roundtrip": O.over([O.GP], f"SELECT * FROM {O.GP}"),
        "tle_staging_csv": f"""SELECT CAST(c_custkey % 100000 AS INTEGER) AS "NORAD_ID", c_name AS "SATELLITE_NAME", 'U' AS "CLASSIFICATION",
              '98067A' AS "INTERNATIONAL_DESIGNATOR", CAST(c_nationkey + 40 AS INTEGER) AS "EPOCH_YEAR",
              CAST({tle_day} AS DOUBLE) AS "EPOCH_DAY", 'tle-' || CAST(c_nationkey AS VARCHAR) AS "SOURCE_NAME",
              strftime({_downloaded("c_custkey")}, '%Y-%m-%dT%H:%M:%S.0000000Z') AS "DOWNLOADED_AT_UTC",
              'tle/' || CAST(c_nationkey AS VARCHAR) || '/' || CAST(c_custkey // 1000 AS VARCHAR) AS "RAW_FILE_PATH"
            FROM customer WHERE c_acctbal <= 9000""",
    }
    # the landed copies are named by Spark, so their download time is when they were written
    timeless = {f"{feed}_split_roundtrip": f"SELECT * EXCLUDE (imported_at) FROM ({sql[f'{feed}_roundtrip']})" for feed in ("gp", "launch")}
    same = {"tle_split_roundtrip": "tle_roundtrip", "tle_split_catalogue_roundtrip": "tle_catalogue_roundtrip", "gp_split_rejects": "gp_rejects"}
    return sql | timeless | {name: sql[whole] for name, whole in same.items()}


def _runs() -> dict[str, str]:
    gp = f"{O.GP} AS ({_parsed_gp('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)', 'AND event_type <> ' + chr(39) + 'error' + chr(39))})"
    registry = f"{O.REG} AS ({_parsed_registry(_REGISTRY_NAME)} {_CUSTOMER_NATION})"
    real = O._NUMBERED_CANDIDATES.format(last=0)
    no_id = O._NUMBERED_CANDIDATES.split("object_id, orbit_band_id", 1)[1]
    whole = ",\n".join(
        [
            O.cte(O.SRC),
            gp,
            registry,
            O._BUILT_OPERATOR,
            O._BUILT_OBJECT,
            O._CANDIDATES,
            f"real AS ({real})",
            O._derived("real"),
        ]
    )
    return {
        "whole_run": f"WITH {whole}\nSELECT * FROM real UNION ALL SELECT * FROM derived",
        "incremental_append": O.over(
            [O.SRC, O.REG],
            "SELECT object_id, orbit_band_id" + no_id,
            # objects and registry come from the analogue tables, element sets from the landed files
            *_analogue_objects(),
            gp.replace(O.GP, "landed", 1),
            O._CANDIDATES.replace(f"FROM {O.GP} g", "FROM landed g"),
        ),
    }


def _analogue_objects() -> list[str]:
    return [O.cte(O.GP), O._BUILT_OPERATOR, O._BUILT_OBJECT]


def general() -> dict[str, str]:
    return {**_operators(), **_sources(), **_runs()}
