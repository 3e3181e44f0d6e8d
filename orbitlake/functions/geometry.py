"""Scene geometry: where an object is drawn, as pure column arithmetic."""

from __future__ import annotations

from math import log1p, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake.functions.classify import lookup


def scene_radius(altitude_km: Column) -> Column:
    known = F.coalesce(altitude_km, F.lit(K.SCENE_DEFAULT_ALTITUDE_KM))
    clamped = F.greatest(F.lit(K.SCENE_MIN_ALTITUDE_KM), F.least(known, F.lit(K.SCENE_MAX_ALTITUDE_KM)))
    return K.SCENE_BASE_RADIUS + F.log1p(clamped) / log1p(K.SCENE_MAX_ALTITUDE_KM) * K.SCENE_RADIUS_SPAN


def default_inclination(orbit_class: Column) -> Column:
    listed = lookup(F.upper(orbit_class), K.BAND_INCLINATION_DEG, "double")
    return F.coalesce(listed, F.lit(K.OTHER_INCLINATION_DEG))


def hash01(value: Column) -> Column:
    """Deterministic number in [0, 1) from an id."""
    wave = F.sin(value.cast("double") * K.HASH_FREQUENCY) * K.HASH_AMPLITUDE
    return wave - F.floor(wave)


def turn(fraction: Column) -> Column:
    return fraction * (2 * pi)


def ring_position(radius: Column, inclination: Column, phase: Column, node: Column) -> dict[str, Column]:
    """x, y, z of a point on an inclined ring turned about the vertical axis; angles in radians."""
    along = F.cos(phase) * radius
    across = F.sin(phase) * radius * F.cos(inclination * K.SCENE_TILT_FACTOR)
    height = F.sin(phase) * F.sin(inclination) * radius * K.SCENE_HEIGHT_FACTOR
    return {
        "x": along * F.cos(node) - across * F.sin(node),
        "y": height,
        "z": along * F.sin(node) + across * F.cos(node),
    }
