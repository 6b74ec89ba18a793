"""The scalar functions under their names in SQL: temporary SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from waymark.functions.geo import EARTH_RADIUS_KM

FUNCTIONS = {
    "normalize_lng(lng DOUBLE) RETURNS DOUBLE": """
        CASE WHEN lng BETWEEN -180D AND 180D THEN lng
             WHEN lng > 0 AND ((lng + 180D) % 360D + 360D) % 360D = 0 THEN 180D
             ELSE ((lng + 180D) % 360D + 360D) % 360D - 180D END""",
    "haversine_km(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE) RETURNS DOUBLE": f"""
        {2 * EARTH_RADIUS_KM}D * asin(least(1D, sqrt(
          sin(radians(lat2 - lat1) / 2) * sin(radians(lat2 - lat1) / 2)
          + cos(radians(lat1)) * cos(radians(lat2))
            * sin(radians(normalize_lng(lng2 - lng1)) / 2) * sin(radians(normalize_lng(lng2 - lng1)) / 2))))""",
    "duration_min(km DOUBLE, speed_kmh DOUBLE) RETURNS DOUBLE": """
        CASE WHEN speed_kmh <= 0 THEN CAST(raise_error('averageSpeedKmh must be positive') AS DOUBLE) ELSE km / speed_kmh * 60D END""",
    "round_half_up(value DOUBLE, digits INT) RETURNS DOUBLE": "floor(value * pow(10, digits) + 0.5D) / pow(10, digits) + 0D",
    "point_in_polygon(lat DOUBLE, lng DOUBLE, polygon ARRAY<STRUCT<lat: DOUBLE, lng: DOUBLE>>) RETURNS BOOLEAN": """
        size(filter(
          transform(polygon, (v, i) -> struct(v.lat AS lat1, v.lng AS lng1, polygon[(i + 1) % size(polygon)].lat AS lat2, polygon[(i + 1) % size(polygon)].lng AS lng2,
            exists(transform(polygon, (w, j) -> abs(polygon[(j + 1) % size(polygon)].lng - w.lng)), d -> d > 180D) AS wide)),
          e -> (e.lat1 > lat) <> (e.lat2 > lat)
            AND if(e.wide AND lng < 0, lng + 360D, lng)
              < (if(e.wide AND e.lng1 < 0, e.lng1 + 360D, e.lng1) - if(e.wide AND e.lng2 < 0, e.lng2 + 360D, e.lng2)) * (lat - e.lat2) / nullif(e.lat1 - e.lat2, 0D)
                + if(e.wide AND e.lng2 < 0, e.lng2 + 360D, e.lng2))) % 2 = 1""",
}


def register(spark: SparkSession) -> None:
    """Create the functions in the session: ``spark.sql("SELECT haversine_km(...)")``."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
