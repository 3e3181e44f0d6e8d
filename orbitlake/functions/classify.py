"""Classification rules of the warehouse: orbit bands, risk, object type, status, labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbitlake import constants as K


def lookup(key: Column, table: Mapping, cast: str) -> Column:
    """``table[key]`` as a CASE expression; NULL when the key is not listed."""
    found = F.lit(None).cast(cast)
    for listed, value in reversed(list(table.items())):
        found = F.when(key == F.lit(listed), F.lit(value).cast(cast)).otherwise(found)
    return found


def band_id(orbit_class: Column) -> Column:
    """Band of an orbit class; only the exact four class names count."""
    return lookup(orbit_class, K.BAND_ID, "bigint")


def geo_group_band(source_group: Column) -> Column:
    return F.when(source_group == "geo", F.lit(K.BAND_ID["GEO"]).cast("bigint"))


def risk_score(is_debris: Column, eccentricity: Column, mean_motion: Column) -> Column:
    """First matching rule wins; comparisons with NULL fall through to the next rule."""
    return (
        F.when(is_debris, F.lit(K.RISK_DEBRIS))
        .when(eccentricity >= K.ECCENTRIC_FROM, F.lit(K.RISK_ECCENTRIC))
        .when(mean_motion >= K.LOW_ORBIT_MEAN_MOTION_FROM, F.lit(K.RISK_LOW_ORBIT))
        .otherwise(F.lit(K.RISK_OTHER))
        .cast("double")
    )


def default_altitude(orbit_class: Column) -> Column:
    return lookup(orbit_class, K.BAND_ALTITUDE_KM, "double")


def default_velocity(orbit_class: Column) -> Column:
    return lookup(orbit_class, K.BAND_VELOCITY_KM_S, "double")


def default_altitude_of_band(band: Column) -> Column:
    return lookup(band, {K.BAND_ID[c]: v for c, v in K.BAND_ALTITUDE_KM.items()}, "double")


def default_velocity_of_band(band: Column) -> Column:
    return lookup(band, {K.BAND_ID[c]: v for c, v in K.BAND_VELOCITY_KM_S.items()}, "double")


def object_type(source_group: Column) -> Column:
    return F.when(source_group == "debris", F.lit("DEBRIS")).otherwise(F.lit("SATELLITE"))


def mentions(text: Column, word: str) -> Column:
    """Case-insensitive containment; false for NULL."""
    return F.coalesce(F.upper(text).contains(word), F.lit(False))


def is_active(status: Column, strict: bool = False) -> Column:
    """Active test of the dashboard.

    The default also accepts INACTIVE and NON-OPERATIONAL, as the published numbers do; ``strict`` does not.
    """
    accepted = mentions(status, "ACTIVE") | mentions(status, "OPERATIONAL")
    if strict:
        refused = mentions(status, "INACTIVE") | F.coalesce(F.upper(status).rlike("NON.?OPERATIONAL"), F.lit(False))
        accepted = accepted & ~refused
    return accepted


def is_debris(kind: Column) -> Column:
    return mentions(kind, "DEBRIS")


def succeeded(status: Column) -> Column:
    """1 when the status mentions SUCCESS anywhere (so partial success counts), else 0."""
    return F.when(mentions(status, "SUCCESS"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def labelled(value: Column, label: str = K.UNKNOWN) -> Column:
    return F.coalesce(value, F.lit(label))
