"""The same results as plain SQL over the test tables, for the side-by-side check."""

from __future__ import annotations

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.workload.analogue import AS_OF, duck_cte

OBS, OBJ, OPR = "fact_object_position_observation", "dim_space_object", "dim_operator"
GP, REG, LNC = "stg_celestrak_objects", "stg_ucs_satellites", "stg_launch_events"
BAND, SRC, LAUNCH = "dim_orbit_band", "dim_source", "fact_launch_event"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _constants(name: str, rows: list[tuple], columns: list[str]) -> str:
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {values})"


def cte(name: str) -> str:
    if name == BAND:
        return _constants(name, K.DIM_ORBIT_BAND_ROWS, schemas.DIM_ORBIT_BAND.names)
    if name == SRC:
        return _constants(name, K.DIM_SOURCE_ROWS, schemas.DIM_SOURCE.names)
    return duck_cte(name)


def over(tables: list[str], sql: str, *more: str) -> str:
    """``sql`` with the named analogue tables (and further CTEs) in scope."""
    return "WITH " + ",\n".join([*map(cte, tables), *more]) + "\n" + sql


def _risk_groups() -> str:
    return f"""risk_groups AS (
      SELECT coalesce(b.orbit_class, 'UNKNOWN') AS orbit_class, coalesce(p.operator_name, 'UNKNOWN') AS operator_name,
             CAST(sum(f.object_count) AS BIGINT) AS object_count,
             round(coalesce(avg(f.debris_risk_score), 0), 9) AS average_risk_score
      FROM {OBS} f JOIN {OBJ} o USING (object_id)
      LEFT JOIN {OPR} p USING (operator_id) LEFT JOIN {BAND} b USING (orbit_band_id)
      GROUP BY 1, 2)"""


def _analytics() -> dict[str, str]:
    orbit_rollup = f"""
      SELECT coalesce(b.orbit_class, 'ALL_ORBITS') AS orbit_class,
             coalesce(o.object_type, 'ALL_OBJECT_TYPES') AS object_type,
             CAST(sum(f.object_count) AS BIGINT) AS object_count,
             round(avg(f.debris_risk_score), 6) AS average_risk_score,
             CAST(grouping(b.orbit_class) AS BIGINT) AS all_orbits,
             CAST(grouping(o.object_type) AS BIGINT) AS all_object_types
      FROM {OBS} f LEFT JOIN {BAND} b USING (orbit_band_id) LEFT JOIN {OBJ} o USING (object_id)
      GROUP BY ROLLUP (b.orbit_class, o.object_type)"""
    by_operator = f"""by_operator AS (
      SELECT coalesce(p.operator_name, 'UNKNOWN') AS operator_name, coalesce(p.country, 'UNKNOWN') AS country,
             CAST(sum(f.object_count) AS BIGINT) AS object_count,
             round(avg(f.debris_risk_score), 6) AS average_risk_score
      FROM {OBS} f JOIN {OBJ} o USING (object_id) LEFT JOIN {OPR} p USING (operator_id)
      GROUP BY 1, 2)"""
    ranked = """SELECT *, CAST(dense_rank() OVER (ORDER BY object_count DESC) AS BIGINT) AS operator_rank
      FROM by_operator"""
    trend = f"""
      SELECT observation_date, object_count, round(avg(object_count) OVER (
               ORDER BY observation_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_average_object_count
      FROM (SELECT CAST(observation_timestamp AS DATE) AS observation_date,
                   CAST(sum(object_count) AS BIGINT) AS object_count
            FROM {OBS} WHERE observation_timestamp IS NOT NULL GROUP BY 1)"""

    def statistics(column: str, mean: str, deviation: str) -> str:
        return over(
            [OBS, BAND],
            f"""SELECT coalesce(b.orbit_class, 'UNKNOWN') AS orbit_class, CAST(sum(f.object_count) AS BIGINT) AS object_count,
                   round(avg(f.{column}), 6) AS {mean}, round(stddev_pop(f.{column}), 6) AS {deviation},
                   round(avg(f.debris_risk_score), 6) AS average_risk_score
            FROM {OBS} f LEFT JOIN {BAND} b USING (orbit_band_id) GROUP BY 1""",
        )

    purposes = f"""SELECT coalesce(o.purpose, 'UNKNOWN') AS purpose, CAST(sum(f.object_count) AS BIGINT) AS object_count,
             round(avg(f.debris_risk_score), 6) AS average_risk_score
      FROM {OBS} f JOIN {OBJ} o USING (object_id) GROUP BY 1"""
    not_dominated = """NOT EXISTS (
        SELECT 1 FROM risk_groups d
        WHERE d.object_count >= g.object_count AND d.average_risk_score >= g.average_risk_score
          AND (d.object_count, d.average_risk_score) <> (g.object_count, g.average_risk_score))"""
    return {
        "orbit_rollup": over(
            [OBS, BAND, OBJ],
            orbit_rollup + " ORDER BY object_count DESC, 1, 2, all_orbits, all_object_types LIMIT 12",
        ),
        "orbit_rollup_all": over([OBS, BAND, OBJ], orbit_rollup),
        "daily_trend": over([OBS], trend + " ORDER BY observation_date DESC LIMIT 30"),
        "daily_trend_all": over([OBS], trend),
        "operator_ranking": over(
            [OBS, OBJ, OPR], ranked + " ORDER BY operator_rank, operator_name, country LIMIT 10", by_operator
        ),
        "operator_ranking_all": over([OBS, OBJ, OPR], ranked, by_operator),
        "orbit_statistics": statistics("altitude_km", "average_altitude_km", "altitude_stddev_km"),
        "inclination_statistics": statistics("inclination_deg", "average_inclination_deg", "inclination_stddev_deg"),
        "skyline_risk": over(
            [OBS, OBJ, OPR, BAND],
            f"""SELECT orbit_class, operator_name, object_count, round(average_risk_score, 6) AS average_risk_score
            FROM risk_groups g WHERE {not_dominated}
            ORDER BY g.average_risk_score DESC, object_count DESC, orbit_class, operator_name LIMIT 10""",
            _risk_groups(),
        ),
        "skyline_risk_all": over(
            [OBS, OBJ, OPR, BAND],
            f"""SELECT orbit_class, operator_name, object_count, round(average_risk_score, 6) AS average_risk_score
            FROM risk_groups g WHERE {not_dominated}""",
            _risk_groups(),
        ),
        "purpose_distribution": over(
            [OBS, OBJ],
            f"SELECT purpose, object_count FROM ({purposes}) ORDER BY object_count DESC, purpose LIMIT 10",
        ),
        "purpose_risk": over([OBS, OBJ], purposes),
        "source_coverage": over(
            [OBS, SRC],
            f"""SELECT s.source_name, count(f.observation_id) AS observation_count,
                   max(f.observation_timestamp) AS last_observation_timestamp
            FROM {SRC} s LEFT JOIN {OBS} f USING (source_id) GROUP BY 1""",
        ),
        "launch_activity": over(
            [LAUNCH],
            f"""SELECT coalesce(provider_name, 'UNKNOWN') AS provider_name, coalesce(launch_status, 'UNKNOWN') AS launch_status,
                   count(*) AS launch_count, CAST(sum(coalesce(payload_count, 0)) AS BIGINT) AS payload_count,
                   CAST(sum(coalesce(success_count, 0)) AS BIGINT) AS success_count
            FROM {LAUNCH} GROUP BY 1, 2""",
        ),
        "purpose_percent_of_max": over(
            [OBS, OBJ],
            f"""SELECT purpose, object_count,
                   round(greatest(2.0, least(100.0, 100.0 * object_count / max(object_count) OVER ())), 6) AS percent
            FROM ({purposes})""",
        ),
        "trend_percent_of_max": over(
            [OBS],
            f"""SELECT observation_date, object_count, moving_average_object_count,
                   round(greatest(4.0, least(100.0, 100.0 * object_count / max(object_count) OVER ())), 6) AS percent
            FROM ({trend})""",
        ),
    }


def _dashboard() -> dict[str, str]:
    def counted(test: str, name: str) -> str:
        return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT) AS {name}"

    active = "contains(upper(operational_status), 'ACTIVE') OR contains(upper(operational_status), 'OPERATIONAL')"
    latest_import = " UNION ALL ".join(
        [
            f"""SELECT s.source_id, max(g.imported_at) AS last_import_timestamp FROM {SRC} s
            JOIN {GP} g ON s.source_name = 'CelesTrak ' || g.source_group GROUP BY 1""",
            f"SELECT 100, max(imported_at) FROM {REG}",
            f"SELECT 200, max(imported_at) FROM {LNC}",
            f"SELECT 900, max(observation_timestamp) FROM {OBS} WHERE source_id = 900",
        ]
    )

    def summary(test: str) -> str:
        return over(
            [OBJ, GP],
            f"""SELECT count(*) AS total_objects, {counted(test, "active_satellites")},
                   {counted("contains(upper(object_type), 'DEBRIS')", "debris_objects")},
                   (SELECT max(imported_at) FROM {GP}) AS last_import_timestamp
            FROM {OBJ}""",
        )

    return {
        "dashboard_summary": summary(active),
        "dashboard_summary_strict": summary(f"({active}) AND NOT contains(upper(operational_status), 'INACTIVE')"),
        "orbit_class_count": over(
            [OBS, BAND],
            f"""SELECT coalesce(orbit_class, 'UNKNOWN') AS orbit_class, count(*) AS object_count
            FROM {OBS} LEFT JOIN {BAND} USING (orbit_band_id) GROUP BY 1""",
        ),
        "altitude_by_type": over(
            [OBS, OBJ],
            f"""SELECT coalesce(object_type, 'UNKNOWN') AS object_type, round(avg(altitude_km), 6) AS average_altitude_km
            FROM {OBS} JOIN {OBJ} USING (object_id) GROUP BY 1""",
        ),
        "source_latest_import": over(
            [OBS, SRC, GP, REG, LNC],
            f"""SELECT CAST(s.source_id AS BIGINT) AS source_id, source_name, source_type, source_url, last_import_timestamp
            FROM {SRC} s LEFT JOIN ({latest_import}) USING (source_id)""",
        ),
    }


def _positions() -> dict[str, str]:
    def by_class(values: dict) -> str:
        return "CASE b.orbit_class " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in values.items()) + " END"

    positions = f"""positions AS (
      SELECT o.object_id, o.norad_id, coalesce(o.object_name, 'UNKNOWN') AS object_name,
             coalesce(o.object_type, 'UNKNOWN') AS object_type, coalesce(b.orbit_class, 'UNKNOWN') AS orbit_class,
             CAST(coalesce(f.altitude_km, {by_class(K.BAND_ALTITUDE_KM)}) AS DOUBLE) AS altitude_km,
             CAST(coalesce(f.velocity_km_s, {by_class(K.BAND_VELOCITY_KM_S)}) AS DOUBLE) AS velocity_km_s,
             f.inclination_deg, f.debris_risk_score, coalesce(s.source_name, 'UNKNOWN') AS source_name,
             coalesce(p.operator_name, 'UNKNOWN') AS operator_name, coalesce(o.purpose, 'UNKNOWN') AS purpose,
             f.observation_timestamp
      FROM (SELECT * FROM {OBS} QUALIFY row_number() OVER (
              PARTITION BY object_id
              ORDER BY source_id = 900, observation_timestamp DESC NULLS LAST, observation_id) = 1) f
      JOIN {OBJ} o USING (object_id) LEFT JOIN {OPR} p USING (operator_id)
      LEFT JOIN {BAND} b USING (orbit_band_id) LEFT JOIN {SRC} s USING (source_id))"""
    tables = [OBS, OBJ, OPR, BAND, SRC]
    measured = ", ".join(
        f"round({c}, 6) AS {c}" for c in ("altitude_km", "velocity_km_s", "inclination_deg", "debris_risk_score")
    )
    plain = (
        "object_id, norad_id, object_name, object_type, orbit_class, source_name, operator_name, purpose, "
        "observation_timestamp"
    )
    radius = (
        "1.18 + 2.28 * ln(1 + greatest(160.0, least(42000.0, coalesce(altitude_km, 550.0)))) / ln(42001.0)"
    )
    tilt = (
        "coalesce(inclination_deg, CASE upper(orbit_class) WHEN 'GEO' THEN 0.0 WHEN 'MEO' THEN 56.0 "
        "WHEN 'HEO' THEN 63.0 ELSE 52.0 END)"
    )

    def hashed(value: str) -> str:
        wave = f"(sin(CAST({value} AS DOUBLE) * CAST(12.9898 AS DOUBLE)) * CAST(43758.5453 AS DOUBLE))"
        return f"2 * pi() * ({wave} - floor({wave}))"

    scene = f"""scene AS (
      SELECT object_id, object_type, orbit_class, CAST({radius} AS DOUBLE) AS radius, radians({tilt}) AS inclination,
             {hashed("object_id")} AS phase, {hashed("object_id * 13 + 5")} AS node,
             CASE WHEN contains(upper(object_type), 'DEBRIS') THEN 0.72 ELSE 1.0 END AS scale
      FROM positions)"""
    across = "sin(phase) * radius * cos(inclination * 0.45)"
    return {
        "latest_position": over(tables, f"SELECT {plain}, {measured} FROM positions", positions),
        "scene_coordinates": over(
            tables,
            f"""SELECT object_id, object_type, orbit_class, round(radius, 6) AS radius, round(inclination, 6) AS inclination,
                   round(phase, 4) AS phase, round(node, 4) AS node, CAST(scale AS DOUBLE) AS scale,
                   round(cos(phase) * radius * cos(node) - {across} * sin(node), 4) + 0 AS x,
                   round(sin(phase) * sin(inclination) * radius * 0.75, 4) + 0 AS y,
                   round(cos(phase) * radius * sin(node) + {across} * cos(node), 4) + 0 AS z
            FROM scene""",
            positions,
            scene,
        ),
        "sampled_rings": over(
            tables,
            f"""SELECT CAST(position AS BIGINT) AS position, object_id, orbit_class, round(CAST({radius} AS DOUBLE), 6) AS radius,
                   round(CAST({tilt} AS DOUBLE), 6) AS inclination_deg, round({hashed("object_id")}, 4) AS rotation
            FROM (SELECT *, row_number() OVER (ORDER BY object_id) AS position, count(*) OVER () AS n FROM positions)
            WHERE (position - 1) % greatest(1, n // greatest(1, least(n, 360))) = 0""",
            positions,
        ),
    }


def _quality() -> dict[str, str]:
    return {
        "invalid_rows": over(
            [GP],
            f"""SELECT source_group, count(*) AS invalid_rows FROM {GP}
            WHERE norad_id IS NULL OR epoch IS NULL OR source_group IS NULL GROUP BY 1""",
        ),
        "duplicate_rows": over(
            [GP],
            f"""SELECT norad_id, epoch, source_group, count(*) AS duplicate_count FROM {GP}
            GROUP BY 1, 2, 3 HAVING count(*) > 1""",
        ),
    }


# --- builds --------------------------------------------------------------------------------------

_BUILT_OPERATOR = f"""built_operator AS (
      SELECT CAST(row_number() OVER (ORDER BY operator_name) AS BIGINT) AS operator_id, operator_name,
             'UNKNOWN' AS operator_type, country
      FROM (SELECT coalesce(operator_name, 'UNKNOWN') AS operator_name, max(country) AS country
            FROM (SELECT norad_id, max(operator_name) AS operator_name, max(country) AS country
                  FROM {REG} WHERE norad_id IS NOT NULL GROUP BY norad_id)
            GROUP BY 1))"""


def _fused(status: str) -> str:
    return f"""SELECT g.norad_id AS object_id, g.norad_id, max(g.object_name) AS object_name,
             CASE WHEN max(g.source_group) = 'debris' THEN 'DEBRIS' ELSE 'SATELLITE' END AS object_type,
             {status} AS operational_status, max(r.purpose) AS purpose, max(r.launch_date) AS launch_date,
             max(p.operator_id) AS operator_id
      FROM {GP} g LEFT JOIN {REG} r ON g.norad_id = r.norad_id
      LEFT JOIN built_operator p ON coalesce(r.operator_name, 'UNKNOWN') = p.operator_name
      WHERE g.norad_id IS NOT NULL GROUP BY g.norad_id"""


_BUILT_OBJECT = (
    "built_object AS ("
    + _fused("coalesce(max(r.operational_status), CASE WHEN bool_or(g.source_group = 'active') THEN 'ACTIVE' END)")
    + ")"
)

_RISK = "WHEN max(g.eccentricity) >= 0.1 THEN 0.75 WHEN max(g.mean_motion) >= 12 THEN 0.50 ELSE 0.25"


def _band_of(text: str) -> str:
    return f"CASE {text} WHEN 'LEO' THEN 1 WHEN 'MEO' THEN 2 WHEN 'GEO' THEN 3 WHEN 'HEO' THEN 4"


_CANDIDATES = f"""candidates AS (
      SELECT d.object_id, CAST({_band_of("max(r.orbit_type)")} ELSE CASE WHEN g.source_group = 'geo' THEN 3 END END AS BIGINT)
               AS orbit_band_id,
             CAST(s.source_id AS BIGINT) AS source_id, g.epoch AS observation_timestamp,
             max(g.inclination_deg) AS inclination_deg, CAST(1 AS BIGINT) AS object_count,
             CAST(CASE WHEN g.source_group = 'debris' THEN 0.90 {_RISK} END AS DOUBLE) AS debris_risk_score
      FROM {GP} g JOIN built_object d ON g.norad_id = d.norad_id
      JOIN {SRC} s ON s.source_name = 'CelesTrak ' || g.source_group
      LEFT JOIN {REG} r ON g.norad_id = r.norad_id
      WHERE g.epoch IS NOT NULL GROUP BY d.object_id, s.source_id, g.epoch, g.source_group)"""

_BUILD_TABLES = [GP, REG, SRC]
_EMPTY_MEASURES = ", ".join(
    f"CAST(NULL AS DOUBLE) AS {c}" for c in ("altitude_km", "latitude", "longitude", "velocity_km_s")
)
_NUMBERED_CANDIDATES = f"""SELECT CAST({{last}} + row_number() OVER (ORDER BY object_id, observation_timestamp, source_id) AS BIGINT)
        AS observation_id, object_id, orbit_band_id, source_id, observation_timestamp, {_EMPTY_MEASURES},
        round(inclination_deg, 6) AS inclination_deg, object_count, debris_risk_score
      FROM candidates c"""

_WINDOW_START = f"(DATE '{AS_OF}' - 27)"


def _derived(facts: str) -> str:
    """Derived rows to add, given a relation of facts."""

    def by_band(values: dict) -> str:
        cases = " ".join(f"WHEN {K.BAND_ID[c]} THEN {v}" for c, v in values.items())
        return f"CAST(CASE orbit_band_id {cases} END AS DOUBLE)"

    return f"""states AS (
      SELECT d.object_id,
             CAST(coalesce(max({_band_of("r.orbit_type")} END), max(CASE WHEN g.source_group = 'geo' THEN 3 END)) AS BIGINT)
               AS orbit_band_id,
             max(g.inclination_deg) AS inclination_deg,
             CAST(CASE WHEN max(d.object_type) = 'DEBRIS' THEN 0.90 {_RISK} END AS DOUBLE) AS debris_risk_score
      FROM built_object d LEFT JOIN {REG} r ON d.norad_id = r.norad_id LEFT JOIN {GP} g ON d.norad_id = g.norad_id
      GROUP BY d.object_id),
    days AS (SELECT CAST(unnest(generate_series({_WINDOW_START}, DATE '{AS_OF}', INTERVAL 1 DAY)) AS TIMESTAMP) AS day),
    derived AS (
      SELECT CAST((SELECT coalesce(max(observation_id), 0) FROM {facts})
                  + row_number() OVER (ORDER BY object_id, day) AS BIGINT) AS observation_id,
             object_id, orbit_band_id, CAST(900 AS BIGINT) AS source_id, day AS observation_timestamp,
             {by_band(K.BAND_ALTITUDE_KM)} AS altitude_km, CAST(NULL AS DOUBLE) AS latitude,
             CAST(NULL AS DOUBLE) AS longitude, {by_band(K.BAND_VELOCITY_KM_S)} AS velocity_km_s,
             round(inclination_deg, 6) AS inclination_deg, CAST(1 AS BIGINT) AS object_count, debris_risk_score
      FROM states CROSS JOIN days
      WHERE NOT EXISTS (SELECT 1 FROM {facts} f WHERE f.object_id = states.object_id AND f.source_id = 900
                          AND f.observation_timestamp = day)
        AND NOT EXISTS (SELECT 1 FROM {facts} f WHERE f.object_id = states.object_id AND f.source_id <> 900
                          AND CAST(f.observation_timestamp AS DATE) = CAST(day AS DATE)))"""


def _pruned(where: str) -> str:
    return f"""SELECT f.* FROM {OBS} f
      WHERE NOT (f.source_id = 900 AND (CAST(f.observation_timestamp AS DATE) < {where}
             OR EXISTS (SELECT 1 FROM {OBS} t WHERE t.object_id = f.object_id AND t.source_id <> 900
                          AND CAST(t.observation_timestamp AS DATE) = CAST(f.observation_timestamp AS DATE))))"""


def _builds() -> dict[str, str]:
    operator_cte, object_cte = _BUILT_OPERATOR, _BUILT_OBJECT
    launch_columns = (
        "launch_id, CAST(200 AS BIGINT) AS source_id, max(launch_date) AS launch_timestamp, max(launch_name) AS launch_name, "
        "max(launch_provider) AS provider_name, max(rocket_name) AS rocket_name, max(launch_country) AS launch_country, "
        "max(launch_status) AS launch_status, CAST(NULL AS VARCHAR) AS launch_site, max(payload_count) AS payload_count, "
        "CAST(CASE WHEN contains(upper(max(launch_status)), 'SUCCESS') THEN 1 ELSE 0 END AS BIGINT) AS success_count"
    )
    facts_rounded = (
        "observation_id, object_id, orbit_band_id, source_id, observation_timestamp, round(altitude_km, 6) AS altitude_km, "
        "latitude, longitude, round(velocity_km_s, 6) AS velocity_km_s, round(inclination_deg, 6) AS inclination_deg, "
        "object_count, debris_risk_score"
    )
    return {
        "dim_operator": over([REG], "SELECT * FROM built_operator", operator_cte),
        "dim_space_object": over([GP, REG], "SELECT * FROM built_object", operator_cte, object_cte),
        "upsert_objects": over(
            [GP, REG, OBJ],
            f"""SELECT coalesce(t.object_id, s.object_id) AS object_id, coalesce(t.norad_id, s.norad_id) AS norad_id,
                   CASE WHEN s.norad_id IS NULL THEN t.object_name ELSE s.object_name END AS object_name,
                   CASE WHEN s.norad_id IS NULL THEN t.object_type ELSE s.object_type END AS object_type,
                   CASE WHEN s.norad_id IS NULL THEN t.operational_status ELSE s.operational_status END AS operational_status,
                   CASE WHEN s.norad_id IS NULL THEN t.purpose ELSE s.purpose END AS purpose,
                   CASE WHEN s.norad_id IS NULL THEN t.launch_date ELSE s.launch_date END AS launch_date,
                   CASE WHEN s.norad_id IS NULL THEN t.operator_id ELSE s.operator_id END AS operator_id
            FROM (SELECT * FROM {OBJ} WHERE operational_status IS NOT NULL) t
            FULL JOIN ({_fused("max(r.operational_status)")}) s ON t.norad_id = s.norad_id""",
            operator_cte,
        ),
        "harmonised_objects": over(
            [GP, REG],
            f"""SELECT g.norad_id, max(g.object_name) AS object_name, max(r.operator_name) AS operator_name,
                   max(r.orbit_type) AS orbit_type
            FROM {GP} g LEFT JOIN {REG} r ON g.norad_id = r.norad_id WHERE g.norad_id IS NOT NULL GROUP BY 1""",
        ),
        "fused_objects": over(
            [GP, REG],
            f"""SELECT g.norad_id, max(g.object_name) AS object_name, max(r.purpose) AS purpose,
                   max(r.operational_status) AS operational_status, max(r.launch_date) AS launch_date
            FROM {GP} g LEFT JOIN {REG} r ON g.norad_id = r.norad_id WHERE g.norad_id IS NOT NULL GROUP BY 1""",
        ),
        "staging_counts": over(
            [GP, REG, LNC],
            " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in (GP, REG, LNC)),
        ),
        "run_versions": over(
            [GP, REG, LNC],
            " UNION ALL ".join(
                f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({commit} AS BIGINT) AS commit_no FROM {t}{kept}"
                for commit, t, kept in (
                    (1, GP, ""), (1, REG, ""), (1, LNC, ""),
                    (2, GP, " WHERE norad_id % 2 = 0"), (2, REG, ""), (2, LNC, " WHERE payload_count IS NOT NULL"),
                )
            ),
        ),
        "fact_observation": over(
            _BUILD_TABLES, _NUMBERED_CANDIDATES.format(last=0), operator_cte, object_cte, _CANDIDATES
        ),
        "append_observations": over(
            [*_BUILD_TABLES, OBS],
            _NUMBERED_CANDIDATES.format(last="(SELECT max(observation_id) FROM known)")
            + """ WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.object_id = c.object_id AND k.source_id = c.source_id
                    AND k.observation_timestamp = c.observation_timestamp)""",
            operator_cte,
            object_cte,
            _CANDIDATES,
            f"""known AS (SELECT observation_id, object_id, source_id,
                   date_trunc('hour', observation_timestamp) AS observation_timestamp
                 FROM {OBS} WHERE inclination_deg >= 30)""",
        ),
        "fact_launch": over(
            [LNC],
            f"""SELECT CAST(row_number() OVER (ORDER BY launch_id) AS BIGINT) AS launch_event_id, *
            FROM (SELECT {launch_columns} FROM {LNC} WHERE launch_id IS NOT NULL GROUP BY launch_id)""",
        ),
        "append_launches": over(
            [LNC, LAUNCH],
            f"""SELECT CAST((SELECT max(launch_event_id) FROM known) + row_number() OVER (ORDER BY launch_id) AS BIGINT)
                   AS launch_event_id, *
            FROM (SELECT {launch_columns} FROM {LNC} WHERE launch_id IS NOT NULL GROUP BY launch_id) c
            WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.launch_id = c.launch_id)""",
            f"known AS (SELECT * FROM {LAUNCH} WHERE launch_status <> 'Launch Failure')",
        ),
        "prune_derived": over([OBS], f"SELECT {facts_rounded} FROM ({_pruned(_WINDOW_START)})"),
        "derived_fill": over(
            [*_BUILD_TABLES, OBS], "SELECT * FROM derived", operator_cte, object_cte, _derived(OBS)
        ),
        "refill_after_prune": over(
            [*_BUILD_TABLES, OBS],
            f"SELECT {facts_rounded} FROM pruned UNION ALL SELECT * FROM derived",
            operator_cte,
            object_cte,
            f"pruned AS ({_pruned(_WINDOW_START)})",
            _derived("pruned"),
        ),
        "fill_launch_weeks": over(
            [LAUNCH],
            f"""SELECT launch_event_id, launch_id, source_id, CAST(launch_timestamp AS TIMESTAMP) AS launch_timestamp, launch_name,
                   provider_name, rocket_name, launch_country, launch_status, launch_site, payload_count, success_count
            FROM {LAUNCH}
            UNION ALL
            SELECT CAST((SELECT max(launch_event_id) FROM {LAUNCH}) + row_number() OVER (ORDER BY day) AS BIGINT),
                   'abgeleitete-daten-launch-' || strftime(day, '%Y%m%d'), 900, CAST(day AS TIMESTAMP),
                   'Abgeleitete Launch-Aktivitaet Woche ' || week, 'Abgeleitete Daten', 'Representative orbital mission',
                   'N/A', 'Abgeleitete Daten', 'Abgeleiteter Startplatz', 1, 1
            FROM (SELECT last_day - back AS day, week
                  FROM (SELECT CAST(max(launch_timestamp) AS DATE) + 14 AS last_day FROM {LAUNCH}),
                       (VALUES (24, 1), (17, 2), (10, 3), (3, 4)) v(back, week))
            WHERE day NOT IN (SELECT CAST(launch_timestamp AS DATE) FROM {LAUNCH})""",
        ),
    }


def oracle_sql() -> dict[str, str]:
    from orbitlake.workload.oracle_general import general

    analytics = _analytics()
    return {**analytics, "all_analytics": _counted(analytics), **_dashboard(), **_positions(), **_quality(), **_builds(), **general()}


def _counted(analytics: dict[str, str]) -> str:
    names = [
        "orbit_rollup", "daily_trend", "operator_ranking", "orbit_statistics", "skyline_risk", "purpose_distribution",
        "source_coverage",
    ]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM ({analytics[name]})) AS row_count" for name in names
    )
