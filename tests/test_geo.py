from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from waymark.errors import DomainError, ServiceError, as_service_error, redact, redact_column, redact_url
from waymark.functions import geo
from waymark.functions.rng import Mulberry32


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_haversine(spark):
    km = geo.haversine_km(F.lit(40.7128), F.lit(-74.006), F.lit(51.5074), F.lit(-0.1278))
    assert round(value(spark, km), -1) == 5570
    across = geo.haversine_km(F.lit(0.0), F.lit(179.8), F.lit(0.0), F.lit(-179.8))
    assert value(spark, across) == pytest.approx(44.48, abs=0.01)
    assert float(geo.np_haversine_km(0, 179.8, 0, -179.8)) == pytest.approx(value(spark, across))
    assert value(spark, geo.haversine_km(F.lit(0.0), F.lit(180.0), F.lit(0.0), F.lit(-180.0))) == 0


@pytest.mark.parametrize(("x", "want"), [(190, -170), (-190, 170), (180, 180), (-180, -180), (540, 180), (1e6, -80), (-540, -180), (0, 0)])
def test_normalize_lng(spark, x, want):
    assert value(spark, geo.normalize_lng(F.lit(float(x)))) == want
    assert geo.np_normalize_lng(np.array([float(x)]))[0] == want


def test_duration(spark):
    assert value(spark, geo.duration_min(F.lit(40.0), 40.0)) == 60
    with pytest.raises(PySparkException, match="averageSpeedKmh must be positive"):
        value(spark, geo.duration_min(F.lit(40.0), 0.0))
    with pytest.raises(DomainError):
        geo.py_duration_min(1, 0)


@pytest.mark.parametrize(("x", "digits", "want"), [(1.23456, 2, 1.23), (-0.0001, 2, 0.0), (-2.5, 0, -2.0), (2.5, 0, 3.0), (-1.005, 1, -1.0)])
def test_round_half_up(spark, x, digits, want):
    got = value(spark, geo.round_half_up(F.lit(x), digits))
    assert got == want == geo.py_round(x, digits)
    assert math.copysign(1, got) == math.copysign(1, want)


def test_spherical_mean(spark):
    def mean(*points):
        df = spark.createDataFrame(list(points), "lat double, lng double")
        return tuple(df.agg(*(c.alias(n) for n, c in geo.spherical_mean("lat", "lng").items())).first())

    assert mean((0.0, 0.0), (0.0, 180.0)) == (0, 90) == geo.np_spherical_mean(np.array([0.0, 0.0]), np.array([0.0, 180.0]))
    assert mean((0.0, 179.0), (0.0, -179.0))[1] in (180, -180)
    assert mean((10.0, 20.0)) == pytest.approx((10, 20))
    with pytest.raises(DomainError):
        geo.np_spherical_mean(np.zeros(0), np.zeros(0))


def test_is_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(geo.is_finite("x")).collect()] == [True, False, False, False]


def test_line_distance(spark):
    at = [F.lit(float(x)) for x in (1, 0, 0, -10, 0, 10)]
    assert value(spark, geo.line_distance_km(*at)) == pytest.approx(111, abs=2)
    same = [F.lit(float(x)) for x in (1, 0, 0, 0, 0, 0)]
    assert value(spark, geo.line_distance_km(*same)) == pytest.approx(111.19, abs=0.01)


def test_turn(spark):
    assert value(spark, geo.turn(*(F.lit(float(x)) for x in (0, 0, 1, 0, 1, 1)))) > 0


def test_generator_is_seeded():
    first, second = Mulberry32(42), Mulberry32(42)
    drawn = [first.random() for _ in range(5)]
    assert drawn == [second.random() for _ in range(5)]
    assert all(0 <= x < 1 for x in drawn) and len(set(drawn)) == 5
    assert drawn[0] == pytest.approx(0.6011037519)
    assert Mulberry32(-1).random() == Mulberry32(2**32 - 1).random()


def test_redaction(spark):
    text = "failed: https://u:p@host/x?key=SECRET&q=1 and ?Token=T"
    want = "failed: https://REDACTED@host/x?key=REDACTED&q=1 and ?Token=REDACTED"
    assert redact(text) == want == value(spark, redact_column(F.lit(text)))
    assert redact_url("https://u:p@h/x?a=1&key=S") == "https://REDACTED@h/x?a=1&key=REDACTED"
    assert redact_url("no url ?key=S") == "no url ?key=REDACTED"


def test_error_codes():
    assert as_service_error(DomainError("EMPTY", "nothing")).code == "InvalidParams"
    assert as_service_error(ServiceError("TIMEOUT", "late")).code == "TIMEOUT"
    assert as_service_error(OSError("key: ?key=1"), "ROUTE_FAIL").as_dict() == {"code": "ROUTE_FAIL", "message": "key: ?key=REDACTED"}


def test_null_coordinates(spark):
    """A missing coordinate is no distance: such points are near nothing."""
    from waymark.operators import proximity

    df = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 0.0, None), (4, float("nan"), 0.0)], "k int, lat double, lng double")
    got = {r.k: r.km for r in df.select("k", geo.haversine_km("lat", "lng", F.lit(0.0), F.lit(1.0)).alias("km")).collect()}
    assert got[2] is None and got[3] is None and math.isnan(got[4]) and 111 < got[1] < 112
    line = df.select("k", geo.line_distance_km(F.col("lat"), F.col("lng"), *(F.lit(float(x)) for x in (0, -1, 0, 1))).alias("km"))
    assert {r.k: r.km for r in line.where("k < 4").collect()} == {1: 0.0, 2: None, 3: None}
    known = df.where("k < 4")
    to = known.withColumnRenamed("k", "c")
    assert [tuple(r) for r in proximity.range_join(known, to, 20_100).select("k", "c").collect()] == [(1, 1)]
    assert [tuple(r) for r in proximity.nearest(known, to, "k", "c").select("k", "c").collect()] == [(1, 1)]
    cells = {(r.k, r.c): r.km for r in proximity.distance_matrix(known, to, max_cells=9).collect()}
    assert len(cells) == 9 and cells[1, 1] == 0 and cells[1, 2] is None and cells[2, 2] is None
    with pytest.raises(DomainError):
        proximity.distance_matrix(known, to, max_cells=8)
