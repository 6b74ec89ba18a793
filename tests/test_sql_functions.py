from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, sql
from waymark.operators import boundary


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    rng = random.Random(1)
    rows = [tuple(rng.choice([rng.uniform(-90, 90), 0.0]) if i % 2 == 0 else rng.choice([rng.uniform(-600, 600), 180.0, -180.0, 540.0, -540.0]) for i in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    df.createOrReplaceTempView("places")
    got = spark.sql("SELECT normalize_lng(b) n, round_half_up(haversine_km(a, b, c, d), 6) km, duration_min(abs(a), 30) m, round_half_up(b, 2) r FROM places").collect()
    want = df.select(
        geo.normalize_lng("b").alias("n"), geo.round_half_up(geo.haversine_km("a", "b", "c", "d"), 6).alias("km"),
        geo.duration_min(F.abs("a"), 30.0).alias("m"), geo.round_half_up("b", 2).alias("r"),
    ).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert "Python" not in spark.sql("SELECT haversine_km(a, b, c, d) FROM places")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="averageSpeedKmh must be positive"):
        spark.sql("SELECT duration_min(1, 0)").collect()


@pytest.mark.parametrize("polygon", [[(0, 0), (0, 30), (30, 30), (30, 0)], [(-50.5, 150.5), (-50.5, -150.5), (45.5, -140.5), (50.5, 160.5)]])
def test_point_in_polygon_in_sql(spark, polygon):
    sql.register(spark)
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.uniform(-60, 60), rng.uniform(-180, 180)) for _ in range(200)], "lat double, lng double")
    df.createOrReplaceTempView("spots")
    listed = ", ".join(f"struct({float(a)}D AS lat, {float(b)}D AS lng)" for a, b in polygon)
    got = [r[0] for r in spark.sql(f"SELECT point_in_polygon(lat, lng, array({listed})) FROM spots").collect()]
    assert got == [r.inside for r in boundary.in_polygons(df, {1: polygon}).collect()] and any(got)
