"""Fixed values.

Everything in this file must equal the published warehouse contract for results to be right:
ids, names, labels, thresholds and formats. Nothing here is logic.
"""

# Source rows: (source_id, source_name, source_type, source_url)
DIM_SOURCE_ROWS = [
    (1, "CelesTrak active", "CELESTRAK_GP_JSON", "https://celestrak.org/NORAD/elements/gp.php?GROUP=active&FORMAT=json"),
    (2, "CelesTrak debris", "CELESTRAK_GP_JSON", "https://celestrak.org/NORAD/elements/index.php?FORMAT=json"),
    (3, "CelesTrak starlink", "CELESTRAK_GP_JSON", "https://celestrak.org/NORAD/elements/gp.php?GROUP=starlink&FORMAT=json"),
    (4, "CelesTrak geo", "CELESTRAK_GP_JSON", "https://celestrak.org/NORAD/elements/gp.php?GROUP=geo&FORMAT=json"),
    (5, "CelesTrak stations", "CELESTRAK_GP_JSON", "https://celestrak.org/NORAD/elements/gp.php?GROUP=stations&FORMAT=json"),
    (6, "CelesTrak last-30-days", "CELESTRAK_GP_JSON", "https://celestrak.org/NORAD/elements/gp.php?GROUP=last-30-days&FORMAT=json"),
    (100, "UCS Satellite Database", "SATELLITE_DATABASE", "https://www.ucsusa.org/resources/satellite-database"),
    (200, "SpaceDevs Launch Library API", "LAUNCH_API", "https://ll.thespacedevs.com/2.2.0/launch/previous/?limit=100"),
    (900, "Abgeleitete Daten (CelesTrak, 4 Wochen)", "ABGELEITETE_DATEN", "https://celestrak.org/NORAD/elements/"),
]
GP_SOURCE_PREFIX = "CelesTrak "
REGISTRY_SOURCE_ID = 100
LAUNCH_SOURCE_ID = 200
DERIVED_SOURCE_ID = 900

# Orbit band rows: (orbit_band_id, orbit_class, altitude_min_km, altitude_max_km, inclination_class)
DIM_ORBIT_BAND_ROWS = [
    (1, "LEO", 160.0, 2000.0, "LOW_INCLINATION"),
    (2, "MEO", 2000.0, 35786.0, "MEDIUM_INCLINATION"),
    (3, "GEO", 35786.0, 35786.0, "EQUATORIAL"),
    (4, "HEO", 35786.0, None, "HIGH_INCLINATION"),
]
BAND_ID = {"LEO": 1, "MEO": 2, "GEO": 3, "HEO": 4}
BAND_ALTITUDE_KM = {"LEO": 550.0, "MEO": 20200.0, "GEO": 35786.0, "HEO": 42000.0}
BAND_VELOCITY_KM_S = {"LEO": 7.8, "MEO": 3.9, "GEO": 3.1, "HEO": 2.5}
BAND_INCLINATION_DEG = {"GEO": 0.0, "MEO": 56.0, "HEO": 63.0}
OTHER_INCLINATION_DEG = 52.0

# Risk score
RISK_DEBRIS = 0.90
RISK_ECCENTRIC = 0.75
RISK_LOW_ORBIT = 0.50
RISK_OTHER = 0.25
ECCENTRIC_FROM = 0.1
LOW_ORBIT_MEAN_MOTION_FROM = 12.0

# Derived four-week fill
DERIVED_WINDOW_DAYS = 28
DERIVED_LAUNCH_DAYS_BACK = [24, 17, 10, 3]
DERIVED_LAUNCH_ID_PREFIX = "abgeleitete-daten-launch-"
DERIVED_LAUNCH_NAME_PREFIX = "Abgeleitete Launch-Aktivitaet Woche "
DERIVED_LABEL = "Abgeleitete Daten"
DERIVED_ROCKET = "Representative orbital mission"
DERIVED_COUNTRY = "N/A"
DERIVED_SITE = "Abgeleiteter Startplatz"

# Labels
UNKNOWN = "UNKNOWN"
ALL_ORBITS = "ALL_ORBITS"
ALL_OBJECT_TYPES = "ALL_OBJECT_TYPES"

# Raw snapshots: (source_name, kind, source_uri)
GP, REGISTRY, LAUNCHES, TLE = "gp_json", "registry", "launches", "tle"
FEEDS = [
    *(
        (f"celestrak-{group}", GP, f"https://celestrak.org/NORAD/elements/gp.php?GROUP={group}&FORMAT=json")
        for group in (
            "active",
            "fengyun-1c-debris",
            "iridium-33-debris",
            "cosmos-2251-debris",
            "starlink",
            "geo",
            "stations",
            "last-30-days",
        )
    ),
    ("ucs-satellite-database", REGISTRY, "https://www.ucsusa.org/resources/satellite-database"),
    ("spacedevs-recent-launches", LAUNCHES, "https://ll.thespacedevs.com/2.2.0/launch/previous/?limit=100"),
]
RAW_FILE_TIME_FORMAT = "yyyyMMdd'T'HHmmssSSS'Z'"

# Registry columns: accepted header spellings (after normalisation), in order of preference
REGISTRY_HEADERS = {
    "satellite_name": ["current official name of satellite", "name of satellite", "satellite name", "name"],
    "norad_id": ["norad number", "norad id"],
    "operator_name": ["operator owner", "operator", "owner operator"],
    "country": ["country org of un registry", "country", "users"],
    "purpose": ["purpose"],
    "orbit_type": ["class of orbit", "orbit class"],
    "operational_status": ["operational status", "status"],
    "launch_date": ["date of launch", "launch date"],
}

# Text formats of the staging files
STAGING_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
STAGING_DATE_FORMAT = "yyyy-MM-dd"

# Report sizes
ROLLUP_ROWS = 12
TREND_ROWS = 30
TREND_WINDOW_ROWS = 7
RANKING_ROWS = 10
SKYLINE_ROWS = 10
PURPOSE_ROWS = 10
SAMPLE_TARGET = 360

# Scene geometry
SCENE_MIN_ALTITUDE_KM = 160.0
SCENE_MAX_ALTITUDE_KM = 42000.0
SCENE_DEFAULT_ALTITUDE_KM = 550.0
SCENE_BASE_RADIUS = 1.18
SCENE_RADIUS_SPAN = 2.28
SCENE_DEBRIS_SCALE = 0.72
SCENE_HEIGHT_FACTOR = 0.75
SCENE_TILT_FACTOR = 0.45
HASH_FREQUENCY = 12.9898
HASH_AMPLITUDE = 43758.5453
NODE_MULTIPLIER = 13
NODE_OFFSET = 5
