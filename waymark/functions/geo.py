"""Spherical geometry and rounding as Column expressions, with numpy versions for grouped kernels.

Angles are degrees, distances kilometres, times minutes. Longitudes may lie outside -180..180 and are wrapped.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.errors import DomainError

EARTH_RADIUS_KM = 6371.0
KM_DIGITS, MIN_DIGITS, DEG_DIGITS = 3, 2, 6
#: Length of a mean vector below which points have no mean direction.
NO_DIRECTION = 1e-9


def _c(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def normalize_lng(lng: Column | str) -> Column:
    """Longitude in -180..180. Both ends are kept; values from beyond the east end that fall on it become 180."""
    x = _c(lng)
    full = F.lit(360.0)
    wrapped = (((x + 180.0) % full) + full) % full - 180.0
    return F.when((x >= -180.0) & (x <= 180.0), x).when((wrapped == -180.0) & (x > 0), F.lit(180.0)).otherwise(wrapped)


def shortest_lng_delta(start: Column | str, end: Column | str) -> Column:
    return normalize_lng(_c(end) - _c(start))


def haversine_km(lat1: Column | str, lng1: Column | str, lat2: Column | str, lng2: Column | str) -> Column:
    """Great-circle distance; null where a coordinate is null."""
    a, b = _c(lat1), _c(lat2)
    up = F.sin(F.radians(b - a) / 2)
    side = F.sin(F.radians(shortest_lng_delta(lng1, lng2)) / 2)
    h = up * up + F.cos(F.radians(a)) * F.cos(F.radians(b)) * side * side
    # rounding can bring h a little above 1, where the arc sine is NaN; a coordinate that is NaN stays so
    most = F.lit(math.pi / 2) + (a + b + _c(lng1) + _c(lng2)) * 0.0
    return F.lit(2 * EARTH_RADIUS_KM) * F.nanvl(F.asin(F.sqrt(h)), most)


def duration_min(km: Column | str, speed_kmh: Column | float) -> Column:
    """Travel time; a speed that is not positive fails the query."""
    speed = _c(speed_kmh)
    return F.when(speed <= 0, F.raise_error(F.lit("averageSpeedKmh must be positive")).cast("double")).otherwise(_c(km) / speed * 60.0)


def round_half_up(value: Column | str, digits: int) -> Column:
    """Rounds halves towards plus infinity (``F.round`` rounds them away from zero); never minus zero."""
    factor = float(10**digits)
    rounded = F.floor(_c(value) * factor + 0.5) / factor
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def round_km(value: Column | str) -> Column:
    return round_half_up(value, KM_DIGITS)


def round_min(value: Column | str) -> Column:
    return round_half_up(value, MIN_DIGITS)


def round_deg(value: Column | str) -> Column:
    return round_half_up(value, DEG_DIGITS)


def is_finite(value: Column | str) -> Column:
    x = _c(value)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def turn(o_lng: Column, o_lat: Column, a_lng: Column, a_lat: Column, b_lng: Column, b_lat: Column) -> Column:
    """Cross product of o-a and o-b: positive for a turn to the left."""
    return (a_lng - o_lng) * (b_lat - o_lat) - (a_lat - o_lat) * (b_lng - o_lng)


def line_distance_km(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance of a point to the line through two others, as the height of the triangle of the three distances."""
    base = haversine_km(lat1, lng1, lat2, lng2)
    left, right = haversine_km(lat1, lng1, lat, lng), haversine_km(lat2, lng2, lat, lng)
    half = (base + left + right) / 2
    inner = half * (half - base) * (half - left) * (half - right)
    area = F.when(inner <= 0, F.lit(0.0)).otherwise(F.sqrt(inner))
    return F.when(base == 0, left).otherwise(2 * area / base)


def spherical_mean(lat: Column | str, lng: Column | str) -> dict[str, Column]:
    """Aggregates ``lat`` and ``lng`` of the mean direction, or of the plain mean where the points cancel out."""
    a, b = F.radians(_c(lat)), F.radians(_c(lng))
    x, y, z = F.sum(F.cos(a) * F.cos(b)), F.sum(F.cos(a) * F.sin(b)), F.sum(F.sin(a))
    flat = F.hypot(x, y)
    none = (flat < NO_DIRECTION) & (F.abs(z) < NO_DIRECTION)
    return {
        "lat": F.when(none, F.avg(_c(lat))).otherwise(F.degrees(F.atan2(z, flat))),
        "lng": F.when(none, F.avg(_c(lng))).otherwise(normalize_lng(F.degrees(F.atan2(y, x)))),
    }


def distinct_points(lat: Column | str, lng: Column | str) -> Column:
    """Aggregate: number of different points (longitudes wrapped; the two ends of the range stay different)."""
    return F.count_distinct(F.struct(_c(lat), normalize_lng(lng)))


# ---- numpy -----------------------------------------------------------------------------------------------------


def np_normalize_lng(lng: np.ndarray) -> np.ndarray:
    x = np.asarray(lng, np.float64)
    # the steps of ``normalize_lng``, so that both round alike
    wrapped = np.fmod(np.fmod(x + 180.0, 360.0) + 360.0, 360.0) - 180.0
    wrapped = np.where((wrapped == -180.0) & (x > 0), 180.0, wrapped)
    return np.where((x >= -180.0) & (x <= 180.0), x, wrapped)


def np_haversine_km(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    up = np.sin(np.radians(np.subtract(lat2, lat1)) / 2)
    side = np.sin(np.radians(np_normalize_lng(np.subtract(lng2, lng1))) / 2)
    h = up**2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * side**2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def np_distance_matrix(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    lat, lng = np.asarray(lat, np.float64), np.asarray(lng, np.float64)
    return np_haversine_km(lat[:, None], lng[:, None], lat[None, :], lng[None, :])


def np_spherical_mean(lat: np.ndarray, lng: np.ndarray) -> tuple[float, float]:
    if not len(lat):
        raise DomainError("EMPTY", "Cannot compute centroid of empty set")
    a, b = np.radians(lat), np.radians(lng)
    x, y, z = (float(v.sum()) for v in (np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)))
    return mean_of_sums(x, y, z, float(np.mean(lat)), float(np.mean(lng)))


def mean_of_sums(x: float, y: float, z: float, plain_lat: float, plain_lng: float) -> tuple[float, float]:
    """Mean direction of the sums of some unit vectors, or the plain mean where they cancel out."""
    flat = math.hypot(x, y)
    if flat < NO_DIRECTION and abs(z) < NO_DIRECTION:
        return plain_lat, plain_lng
    return math.degrees(math.atan2(z, flat)), float(np_normalize_lng(np.array([math.degrees(math.atan2(y, x))]))[0])


def py_round(value: float, digits: int) -> float:
    """``round_half_up`` of one number."""
    factor = 10**digits
    return math.floor(value * factor + 0.5) / factor + 0.0


def py_duration_min(km: float, speed_kmh: float) -> float:
    if speed_kmh <= 0:
        raise DomainError("INVALID_SPEED", "averageSpeedKmh must be positive")
    return km / speed_kmh * 60
