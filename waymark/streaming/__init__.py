"""Row-by-row operators over streams, and windowed summaries of moving points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import spherical_mean
from waymark.operators.boundary import in_polygons


def geofence(points: DataFrame, polygons: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """Each point of a stream with each polygon of a fixed list that holds it."""
    return in_polygons(points, polygons).where("inside").drop("inside")


def windowed_centroids(points: DataFrame, ts: str, keys: list[Column | str], every: str, late: str) -> DataFrame:
    """Count and spherical mean of the points of each key in tumbling windows; points later than ``late`` are left out."""
    mean = spherical_mean("lat", "lng")
    grouped = points.withWatermark(ts, late).groupBy(F.window(ts, every), *keys)
    return grouped.agg(F.count("*").alias("n_points"), mean["lat"].alias("lat"), mean["lng"].alias("lng"))
