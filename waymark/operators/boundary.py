"""Bounding boxes, convex hulls and point-in-polygon tests, aware of the antimeridian."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.errors import DomainError
from waymark.functions.geo import distinct_points, normalize_lng, np_normalize_lng
from waymark.session import cut_lineage

#: Parts that the longitudes of a group are searched in, and points that are hulled at once.
STRIPS = 3600
HULL_POINTS = 100_000


def unique_points(points: DataFrame, *keys: str, order: str = "idx") -> DataFrame:
    """The first row, by ``order``, of each point of a group."""
    w = Window.partitionBy(*keys, "lat", normalize_lng("lng")).orderBy(order)
    return points.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def count_distinct_points(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(distinct_points("lat", "lng").alias("n_distinct"))


def lng_window(points: DataFrame, key: str) -> DataFrame:
    """The smallest arc that holds all longitudes of a group: ``(key, west, east, crosses)``.

    The arc leaves out the widest gap between neighbouring longitudes; of equally wide ones the gap at the antimeridian,
    then the westernmost.
    """
    return bounding_box(points, key).select(key, F.col("min_lng").alias("west"), F.col("max_lng").alias("east"), "crosses")


def bounding_box(points: DataFrame, key: str) -> DataFrame:
    """``(key, min_lat, min_lng, max_lat, max_lng, crosses)``; a box across the antimeridian has min_lng > max_lng.

    Gaps of longitudes are sought within strips first and then between the ends of the strips, so that no task sorts all
    points of a large group; the latitudes travel along.
    """
    k = "_key"  # the caller's name can be one that is used here
    lngs = points.select(F.col(key).alias(k), "lat", normalize_lng("lng").alias("x")).withColumn("strip", F.floor((F.col("x") + 180.0) / 360.0 * STRIPS))
    lngs = lngs.groupBy(k, "strip", "x").agg(F.min("lat").alias("south"), F.max("lat").alias("north"))
    gap = lambda low, high: F.struct((high - low).alias("gap"), high.alias("to"), low.alias("before"))
    rank = lambda g: F.when(F.col(f"{g}.gap").isNotNull(), F.struct(F.col(f"{g}.gap"), -F.col(f"{g}.to")))
    inner = Window.partitionBy(k, "strip").orderBy("x")
    strips = lngs.withColumn("g", gap(F.lag("x").over(inner), F.col("x"))).groupBy(k, "strip").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.max_by("g", rank("g")).alias("widest"), F.min("south").alias("south"), F.max("north").alias("north")
    )
    outer = Window.partitionBy(k).orderBy("strip")
    both = strips.withColumn("g", gap(F.lag("high").over(outer), F.col("low"))).withColumn(
        "g", F.when(F.coalesce(rank("widest") > rank("g"), rank("g").isNull()), F.col("widest")).otherwise(F.col("g"))
    )
    best = both.groupBy(k).agg(
        F.min("low").alias("first"), F.max("high").alias("last"), F.max_by("g", rank("g")).alias("g"), F.min("south").alias("min_lat"), F.max("north").alias("max_lat")
    )
    crosses = F.coalesce(F.col("g.gap") > F.col("first") + 360.0 - F.col("last"), F.lit(False))
    return best.select(
        F.col(k).alias(key), "min_lat", F.when(crosses, F.col("g.to")).otherwise(F.col("first")).alias("min_lng"),
        "max_lat", F.when(crosses, F.col("g.before")).otherwise(F.col("last")).alias("max_lng"), crosses.alias("crosses"),
    )


def hull_indices(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of distinct points, counter-clockwise from the least (x, y); points on an edge are no
    corners."""
    order = np.lexsort((y, x))
    if len(order) < 3:
        return order

    def side(of: np.ndarray) -> list[int]:
        corners: list[int] = []
        for p in of.tolist():
            while len(corners) > 1:
                o, a = corners[-2], corners[-1]
                if (x[a] - x[o]) * (y[p] - y[o]) - (y[a] - y[o]) * (x[p] - x[o]) > 0:
                    break
                corners.pop()
            corners.append(p)
        return corners[:-1]

    return np.array(side(order) + side(order[::-1]))


def convex_hull(points: DataFrame, key: str) -> DataFrame:
    """Corners of each group's hull, planar in degrees: ``(key, seq, lat, lng)``, counter-clockwise from the west.

    Longitudes are shifted past 180 for groups that cross the antimeridian and come back wrapped. A group of more than
    ``HULL_POINTS`` points is hulled in parts of about that size, and so are the corners of the parts, until few are left
    (or all are corners): a large group is no single task's work.
    """
    k = "_key"
    points = points.select(F.col(key).alias(k), "lat", "lng")
    arcs = lng_window(points, k).select(k, "west", "crosses")
    x = normalize_lng("lng")
    rows = points.select(k, "lat", x.alias("lng")).distinct().join(arcs, k)
    rows = rows.withColumn("x", F.when(F.col("crosses") & (F.col("lng") < F.col("west")), F.col("lng") + 360.0).otherwise(F.col("lng")))
    rows = cut_lineage(rows.select(k, "lat", "lng", "x"))
    kind = rows.schema[k].dataType.simpleString()

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[hull_indices(pdf["x"].to_numpy(), pdf["lat"].to_numpy())]

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        out = corners(pdf)
        return pd.DataFrame({key: out[k], "seq": np.arange(len(out), dtype=np.int32), "lat": out["lat"], "lng": out["lng"]})

    before = None
    while True:
        sizes = rows.groupBy(k).agg(F.count("*").alias("_n"))
        total = sizes.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
        if (total["most"] or 0) <= HULL_POINTS or total["all"] == before:
            return rows.groupBy(k).applyInPandas(final, f"{key} {kind}, seq int, lat double, lng double")
        before = total["all"]
        part = F.pmod(F.xxhash64("lat", "lng"), F.ceil(F.col("_n") / HULL_POINTS)).alias("_part")
        dealt = rows.join(sizes, k).select(*rows.columns, part)
        rows = cut_lineage(dealt.groupBy(k, "_part").applyInPandas(corners, dealt.schema).drop("_part"))


def point_in_polygon(lat: Column, lng: Column, polygon: Column) -> Column:
    """Even-odd test of a point against an array of vertices (lat, lng); fewer than three vertices fail the query.

    If an edge spans more than 180 degrees of longitude, negative longitudes count as that much east of 180. Points on
    an edge may fall either way; holes and poles are not handled.
    """
    following = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    edges = F.zip_with(polygon, following, lambda a, b: F.struct(a["lat"].alias("alat"), a["lng"].alias("alng"), b["lat"].alias("blat"), b["lng"].alias("blng")))
    wide = F.exists(edges, lambda e: F.abs(e["blng"] - e["alng"]) > 180.0)
    east = lambda x: F.when(wide & (x < 0), x + 360.0).otherwise(x)
    crossed = F.filter(
        edges,
        # the end of the edge is the vertex that follows; the division is safe where the latitudes straddle the point's
        lambda e: ((e["alat"] > lat) != (e["blat"] > lat))
        & (east(lng) < (east(e["alng"]) - east(e["blng"])) * (lat - e["blat"]) / F.when(e["alat"] != e["blat"], e["alat"] - e["blat"]) + east(e["blng"])),
    )
    return F.when(F.size(polygon) < 3, F.raise_error(F.lit("polygon requires at least 3 vertices")).cast("boolean")).otherwise(F.size(crossed) % 2 == 1)


def polygon_literal(vertices: list[tuple[float, float]]) -> Column:
    if len(vertices) < 3:
        raise DomainError("DEGENERATE", "polygon requires at least 3 vertices")
    return F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lng")) for a, b in vertices))


def in_polygons(points: DataFrame, polygons: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """``points`` with ``poly_id`` and ``inside``, a row for each of a fixed list of polygons (no join)."""
    listed = F.array(*(F.struct(F.lit(i).alias("id"), polygon_literal(v).alias("vertices")) for i, v in polygons.items()))
    rows = points.withColumn("_p", F.explode(listed))
    return rows.withColumn("poly_id", F.col("_p.id")).withColumn("inside", point_in_polygon(F.col("lat"), F.col("lng"), F.col("_p.vertices"))).drop("_p")


def geofence_join(points: DataFrame, fences: DataFrame, cell_degrees: float = 1.0) -> DataFrame:
    """Points with the polygons that hold them; ``fences``: key columns and ``polygon`` (array of lat, lng).

    A polygon goes to the cells of a degree grid that its box touches, a point to its own, and equal cells are joined
    before the exact test. Polygons with an edge over 180 degrees wide are matched on latitude alone.
    """
    strips = int(round(360 / cell_degrees))
    lats, lngs = F.col("polygon.lat"), F.col("polygon.lng")
    following = F.concat(F.slice(lngs, 2, F.size(lngs)), F.slice(lngs, 1, 1))
    wide = F.exists(F.zip_with(lngs, following, lambda a, b: F.abs(a - b) > 180.0), lambda x: x)
    row = lambda x: F.floor((x + 90.0) / cell_degrees).cast("int")
    col = lambda x: F.floor((x + 180.0) / cell_degrees).cast("int")
    tiles = fences.withColumn("_row", F.explode(F.sequence(row(F.array_min(lats)), row(F.array_max(lats)))))
    tiles = tiles.withColumn("_col", F.explode(F.when(wide, F.sequence(F.lit(0), F.lit(strips))).otherwise(F.sequence(col(F.array_min(lngs)), col(F.array_max(lngs))))))
    keyed = points.withColumn("_row", row(F.col("lat"))).withColumn("_col", col(F.col("lng")))
    joined = keyed.join(tiles, ["_row", "_col"]).where(point_in_polygon(F.col("lat"), F.col("lng"), F.col("polygon")))
    return joined.drop("_row", "_col", "polygon")


def np_lng_window(lngs: np.ndarray) -> tuple[float, float, bool]:
    """``lng_window`` of one small group."""
    x = np.unique(np_normalize_lng(lngs))
    if not len(x):
        raise DomainError("EMPTY", "at least one longitude is required")
    gaps = np.diff(x)
    if not len(gaps) or gaps.max() <= x[0] + 360 - x[-1]:
        return float(x[0]), float(x[-1]), False
    at = int(gaps.argmax())
    return float(x[at + 1]), float(x[at]), True
