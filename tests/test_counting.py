"""Numbers of near points: exact, and without a list of the pairs."""

from __future__ import annotations

import numpy as np
import pytest

from waymark.functions.geo import np_haversine_km
from waymark.operators import counting, proximity


def places(rng, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points all over the sphere; on its seams; around a pole; on a lattice across the antimeridian."""
    if kind == 0:
        return rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    if kind == 1:
        return rng.choice([90.0, -90.0, 89.99, -89.99, 0.0, 0.001, 45.0], n), rng.choice([180.0, -180.0, 179.999, -179.99, 0.0, 200.0, 31.0], n)
    if kind == 2:
        return rng.uniform(80, 90, n), rng.uniform(-400, 400, n)
    return np.round(rng.uniform(-3, 3, n), 1), np.round(rng.uniform(177, 183, n), 1)


@pytest.mark.parametrize("eps", [0.0, 0.2, 30.0, 250.5, 2500.0, 10007.543, 15000.0, 20100.0])
@pytest.mark.parametrize("kind", range(4))
@pytest.mark.parametrize("share", [0.01, 30.0])
def test_count_near_is_exact(monkeypatch, eps, kind, share):
    """With few strips and with many; points of several blocks and weights, some only to be counted."""
    monkeypatch.setattr(counting, "STRIP_SHARE", share)
    rng = np.random.default_rng(kind)
    lat, lng = places(rng, kind, 300)
    block, weight, own = rng.integers(0, 2, 300) * 10**15, rng.integers(1, 4, 300), rng.random(300) < 0.7
    at, found = counting.count_near(block, lat, lng, weight, own, eps)
    near = (np_haversine_km(lat[:, None], lng[:, None], lat[None], lng[None]) <= eps) & (block[:, None] == block[None])
    assert sorted(at) == np.flatnonzero(own).tolist() and found.tolist() == (near * weight).sum(axis=1)[at].tolist()


ODD = [
    (900, None, 0.0), (901, 0.0, None), (902, float("nan"), 0.0), (903, 0.0, float("inf")), (904, 95.0, 10.0), (905, -95.0, 10.0), (906, 84.9, -170.0),
    (907, 0.0, 0.0), (907, -0.0, 720.0), (907, 50.0, 50.0), (None, 0.0, 0.0),
]


@pytest.mark.parametrize("eps", [0.2, 250.5, 4000.0, 20100.0])
@pytest.mark.parametrize("crowd", [20_000, 5])
def test_region_query_of_odd_points(spark, monkeypatch, eps, crowd):
    """Unknown places, latitudes beyond a pole, a key of several points, and blocks that are shared out."""
    monkeypatch.setattr(proximity, "CROWD", crowd)
    rng = np.random.default_rng(3)
    rows = [(int(100 * kind + i), float(a), float(b)) for kind in range(4) for i, (a, b) in enumerate(zip(*places(rng, kind, 60)))] + ODD
    known = [r for r in rows if r[1] is not None and r[2] is not None and np.isfinite(r[1]) and np.isfinite(r[2])]
    lat, lng = (np.array([r[i] for r in known]) for i in (1, 2))
    n = (np_haversine_km(lat[:, None], lng[:, None], lat[None], lng[None]) <= eps).sum(axis=1)
    want = {}
    for (key, _, _), m in zip(known, n.tolist()):
        want[key] = want.get(key, 0) + m
    found = proximity.region_query(spark.createDataFrame(rows, "k int, lat double, lng double"), "k", eps).collect()
    assert len(found) == len(want) and {r.k: r.n_neighbors for r in found} == want


def joined_rows(node) -> int:
    """Most rows that a join of a plan that has run gave."""
    own = node.metrics().get("numOutputRows") if "Join" in node.nodeName() else None
    children = node.children()
    return max([own.get().value() if own is not None and own.isDefined() else 0, *(joined_rows(children.apply(i)) for i in range(children.size()))])


def test_region_query_lists_no_pairs(spark):
    """Three thousand points of which all are near all, half of them equal: nine million pairs."""
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 0.5, (1500, 2)))]
    df = spark.createDataFrame(rows + [(1500 + i, 0.25, 0.25) for i in range(1500)], "k int, lat double, lng double")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = proximity.region_query(df, "k", 250.5)
        assert [r.n_neighbors for r in counts.collect()] == [3000] * 3000
        assert joined_rows(counts._jdf.queryExecution().executedPlan()) < 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
