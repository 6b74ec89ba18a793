"""Lines of all events of a user, simplified whole, against a plain Douglas-Peucker."""

from __future__ import annotations

import json
import math

from tests.conftest import DATA
from waymark.plans import catalog


def km(a, b):
    x, y = math.radians(b[1] - a[1]), math.radians(b[0] - a[0])
    h = math.sin(x / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(y / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def far(p, a, b):
    base, left, right = km(a, b), km(a, p), km(b, p)
    if base == 0:
        return left
    h = (base + left + right) / 2
    return 2 * math.sqrt(max(0, h * (h - base) * (h - left) * (h - right))) / base


def kept(line):
    if len(line) < 3:
        return line
    d = [far(p, line[0], line[-1]) for p in line[1:-1]]
    if max(d) <= catalog.TOLERANCE_KM:
        return [line[0], line[-1]]
    m = d.index(max(d)) + 1
    return kept(line[: m + 1])[:-1] + kept(line[m:])


def test_geojson_simplify_takes_whole_lines(spark):
    events = catalog._event_lines(spark, DATA).select("user_id", "r", "lng", "lat").collect()
    lines: dict = {}
    for e in sorted(events, key=lambda e: (e.user_id, e.r)):
        lines.setdefault(e.user_id, []).append([e.lng, e.lat])
    assert max(map(len, lines.values())) > 50
    found = catalog.QUERIES["geojson_simplify"](spark, DATA).collect()
    assert len(found) == len(lines)
    assert {r.user_id: json.loads(r.geojson)["coordinates"] for r in found if r.error is None} == {u: kept(p) for u, p in lines.items() if len(p) > 1}


def test_simplify_line_takes_whole_lines(spark):
    events = catalog._event_lines(spark, DATA).select("user_id", "event_id", "r", "lng", "lat").collect()
    lines: dict = {}
    for e in sorted(events, key=lambda e: (e.user_id, e.r)):
        lines.setdefault(e.user_id, []).append((e.lng, e.lat, e.event_id))
    found = {(r.user_id, r.event_id) for r in catalog.QUERIES["simplify_line"](spark, DATA).collect()}
    assert found == {(u, p[2]) for u, line in lines.items() for p in kept(line)}
