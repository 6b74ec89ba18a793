from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.errors import DomainError
from waymark.operators import boundary as b
from waymark.operators import proximity as p
from waymark.functions.geo import np_haversine_km


def frame(spark, *groups):
    rows = [(k, i, float(lat), float(lng)) for k, g in enumerate(groups) for i, (lat, lng) in enumerate(g)]
    return spark.createDataFrame(rows, "k int, idx int, lat double, lng double")


def test_bounding_box(spark):
    df = frame(spark, [(0, 179.8), (0, -179.8)], [(0, -100), (5, 0), (0, 100)], [(1, 2)], [(0, 190), (0, 10)])
    found = {r.k: tuple(r)[1:] for r in b.bounding_box(df, "k").collect()}
    assert found[0] == (0, 179.8, 0, -179.8, True)
    assert found[1] == (0, -100, 5, 100, False)
    assert found[2] == (1, 2, 1, 2, False)
    assert found[3] == (0, -170, 0, 10, False)


def test_window_agrees_with_numpy(spark):
    rng = random.Random(2)
    groups = [[(0, rng.choice([rng.uniform(-180, 180), rng.randint(-18, 18) * 10, 179.9, -179.9])) for _ in range(rng.randint(1, 30))] for _ in range(25)]
    found = {r.k: (r.west, r.east, r.crosses) for r in b.lng_window(frame(spark, *groups), "k").collect()}
    assert found == {k: b.np_lng_window(np.array([x for _, x in g], float)) for k, g in enumerate(groups)}
    with pytest.raises(DomainError):
        b.np_lng_window(np.zeros(0))


def inside(spark, polygon, *points):
    df = spark.createDataFrame([(float(a), float(x)) for a, x in points], "lat double, lng double")
    return [r.inside for r in b.in_polygons(df, {1: polygon}).collect()]


def test_point_in_polygon(spark):
    square = [(0, 0), (0, 1), (1, 1), (1, 0)]
    assert inside(spark, square, (0.5, 0.5), (1.5, 0.5), (0.5, -0.5)) == [True, False, False]
    wide = [(-5, 170), (-5, -170), (5, -170), (5, 170)]
    assert inside(spark, wide, (0, 179), (0, -179), (0, 0), (0, 160)) == [True, True, False, False]
    with pytest.raises(DomainError):
        inside(spark, square[:2], (0, 0))


def test_geofence_join_agrees(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(400)]
    polygons = {i: [(rng.uniform(-50, 50), rng.uniform(-80, 80)) for _ in range(rng.randint(3, 7))] for i in range(5)}
    polygons[9] = [(-20.5, 150.5), (-20.5, -150.5), (30.5, -140.5), (30.5, 160.5)]
    df = spark.createDataFrame(points, "id int, lat double, lng double")
    want = {(r.id, r.poly_id) for r in b.in_polygons(df, polygons).where("inside").collect()}
    fences = spark.createDataFrame([(i, [{"lat": a, "lng": x} for a, x in v]) for i, v in polygons.items()], "poly_id int, polygon array<struct<lat:double,lng:double>>")
    assert {(r.id, r.poly_id) for r in b.geofence_join(df, fences, 7.0).collect()} == want and want


def test_convex_hull(spark):
    df = frame(
        spark,
        [(0, 0), (0, 1), (1, 1), (1, 0), (0.5, 0.5), (0, 0)],
        [(0, 0), (0, 1), (0, 2)],
        [(3, 4)],
        [(0, 179.5), (0, -179.5), (1, 180), (0.2, 179.9)],
    )
    found: dict = {}
    for r in b.convex_hull(df, "k").orderBy("k", "seq").collect():
        found.setdefault(r.k, []).append((r.lat, r.lng))
    assert found[0] == [(0, 0), (0, 1), (1, 1), (1, 0)]
    assert sorted(found[1]) == [(0, 0), (0, 2)]
    assert found[2] == [(3, 4)]
    assert found[3] == [(0, 179.5), (0, -179.5), (1, 180)]


def test_unique_points(spark):
    df = frame(spark, [(0, 190), (0, -170), (1, 1)])
    assert sorted(r.idx for r in b.unique_points(df, "k").collect()) == [0, 2]
    assert b.count_distinct_points(df, "k").first().n_distinct == 2


@pytest.mark.parametrize("eps", [0.2, 30.0, 700.0, 9000.0, 20100.0])
def test_range_join_is_exact(spark, eps):
    rng = random.Random(int(eps))
    place = lambda: (rng.choice([rng.uniform(-90, 90), 90.0, -90.0, 89.99, 0.0]), rng.choice([rng.uniform(-180, 180), 180.0, -180.0, 179.999, 200.0]))
    left, right = ([(i, *place()) for i in range(120)] for _ in range(2))
    right += [(200 + i, a + 0.0005, x - 0.0005) for i, a, x in left[:40] if a < 89]
    got = p.range_join(spark.createDataFrame(left, "a int, lat double, lng double"), spark.createDataFrame(right, "b int, lat double, lng double"), eps)
    want = {(i, j) for i, a, x in left for j, c, y in right if float(np_haversine_km(a, x, c, y)) <= eps}
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


def test_nearest_both_ways(spark, monkeypatch):
    rng = random.Random(8)
    points = spark.createDataFrame([(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)], "k int, lat double, lng double")
    candidates = spark.createDataFrame([(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(25)] + [(99, 1.0, 1.0), (98, 1.0, 1.0)], "c int, lat double, lng double")
    small = {tuple(r) for r in p.nearest(points, candidates, "k", "c").collect()}
    monkeypatch.setattr(p, "SMALL_SIDE", 3)
    assert {tuple(r) for r in p.nearest(points, candidates, "k", "c").collect()} == small and len(small) == 60
    assert p.nearest(points, candidates.limit(0), "k", "c").count() == 0


def test_request_matrices(spark):
    coord = "array<struct<lat:double,lng:double>>"
    rows = [
        (1, [(0.0, 0.0)], [(0.0, 1.0)], 60.0), (2, [(0.0, 0.0), (0.0, 1.0)], None, 30.0), (3, [(0.0, 0.0)] * 3, [(0.0, 0.0)] * 3, None), (4, [(0.0, 0.0)], None, 0.0),
    ]
    df = spark.createDataFrame(rows, f"request_id int, origins {coord}, destinations {coord}, average_speed_kmh double")
    found = {r.request_id: r for r in p.request_matrices(df, max_cells=8).collect()}
    assert found[1].distances_km == [[111.195]] and found[1].durations_min == [[111.19]]
    assert found[2].durations_min == [[0, 222.39], [222.39, 0]]
    assert found[3].error == "origins x destinations = 9 cells exceeds the limit of 8" and found[3].distances_km is None
    assert found[4].error == "averageSpeedKmh must be positive"


def test_nearest_in_group(spark):
    points = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 2, 0.0, 0.0)], "g string, k int, lat double, lng double")
    centers = spark.createDataFrame([("a", 7, 0.0, 1.0), ("a", 8, 0.0, 2.0), ("b", 9, 5.0, 5.0)], "g string, c int, lat double, lng double")
    assert {(r.g, r.c) for r in p.nearest_in_group(points, centers, "g", "k", "c").collect()} == {("a", 7), ("b", 9)}


def test_region_query_counts_itself(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.01), (3, 50.0, 50.0)], "k int, lat double, lng double")
    assert {r.k: r.n_neighbors for r in p.region_query(df, "k", 5.0).collect()} == {1: 2, 2: 2, 3: 1}


def test_plan_has_no_cross_join(spark):
    df = spark.range(10).select("id", (F.col("id") * 1.0).alias("lat"), (F.col("id") * 2.0).alias("lng"))
    plan = p.range_join(df, df.withColumnRenamed("id", "other"), 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hull_of_parts(spark, monkeypatch):
    """Parts of any size give the hull of all points."""
    monkeypatch.setattr(b, "HULL_POINTS", 20)
    rng = np.random.default_rng(4)
    p = np.vstack((rng.normal(0, 5, (400, 2)), [(np.cos(a) * 40, np.sin(a) * 40) for a in np.linspace(0, 6, 30)]))
    df = spark.createDataFrame([("g", float(y), float(x)) for x, y in p] + [("h", 1.0, 2.0)], "g string, lat double, lng double")
    got = [(r.lng, r.lat) for r in b.convex_hull(df, "g").where("g = 'g'").orderBy("seq").collect()]
    assert got == [tuple(p[i]) for i in b.hull_indices(p[:, 0], p[:, 1])]
