"""Numbers of near points by ranks in sorted strips: few pairs are looked at, however many there are."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from waymark.functions.geo import EARTH_RADIUS_KM, np_haversine_km, np_normalize_lng

#: Bits of a longitude's place on its circle, by which a strip is sorted.
TURN_BITS = 33
TURN = 1 << TURN_BITS
#: By how much a cosine, or a product of unit vectors, has to miss that of the radius to be sure of its side.
SURE = 1e-12
#: Angle that a strip's height is not less than a share of.
MIN_ANGLE = 1e-6
#: Strips to a radius at most, and the share of pairs looked at for which one more is worth its searches.
MAX_STRIPS, STRIP_SHARE = 256, 0.04
#: Pairs that are looked at at a time.
PAIRS = 1 << 20


def _half_width(cosine: float, sin0: np.ndarray, cos0: np.ndarray, sin1: np.ndarray, cos1: np.ndarray, unknown: float) -> np.ndarray:
    """Half of the longitudes at a latitude that a circle covers: -1 for none, pi for all of them."""
    ratio = (cosine - sin0 * sin1) / (cos0 * cos1)
    ratio[np.isnan(ratio)] = unknown
    return np.where(ratio > 1, -1.0, np.arccos(np.clip(ratio, -1, 1)))


class _Strips:
    """Points sorted by block, strip of latitude and longitude, with the ranks of places in a strip."""

    def __init__(self, block: np.ndarray, lat: np.ndarray, lng: np.ndarray, weight: np.ndarray, own: np.ndarray, angle: float, height: float):
        lng = np_normalize_lng(lng)
        a, b = np.radians(lat), np.radians(lng)
        x, y, z = np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)
        # also right for latitudes beyond a pole
        phi, place = np.arctan2(z, np.hypot(x, y)), (np.arctan2(y, x) + math.pi) / (2 * math.pi) * TURN
        turned = np.floor(place).astype(np.int64) & (TURN - 1)
        blocks, at = np.unique(block, return_inverse=True)
        self.strips = int(math.pi / height) + 2
        strip = np.clip(np.floor((phi + math.pi / 2) / height).astype(np.int64), 0, self.strips - 1)
        key = at * self.strips + strip
        order = np.lexsort((turned, key))
        key, self.own = key[order], own[order]
        self.x, self.y, self.z, self.lat, self.lng, self.weight = (v[order] for v in (x, y, z, lat, lng, weight))
        self.start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.rows, self.size = key[self.start], np.diff(np.append(self.start, len(key)))
        row = np.repeat(np.arange(len(self.rows)), self.size)
        self.places = row << TURN_BITS | turned[order]
        self.sums = np.concatenate(([0], np.cumsum(self.weight)))
        self.left = np.flatnonzero(self.own)
        self.order, self.key, self.strip, self.phi, self.place = order, key[self.left], strip[order][self.left], phi[order][self.left], place[order][self.left]
        self.even = bool((weight == 1).all())
        self.angle = angle

    def rank(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Points of a strip before a place; places go round, and a turn counts all of them."""
        return np.searchsorted(self.places, row << TURN_BITS | (place & (TURN - 1))) - self.start[row] + (place >> TURN_BITS) * self.size[row]

    def weighed(self, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Weight of the points of a strip before a rank, which goes round as well."""
        if self.even:
            return rank
        start, size = self.start[row], self.size[row]
        turns = rank // size
        return self.sums[start + rank - turns * size] - self.sums[start] + turns * (self.sums[start + size] - self.sums[start])

    def compared(self, out: np.ndarray, who: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, eps_km: float) -> None:
        """Add to ``out`` what is near among the points of ranks ``first`` to ``last`` of strips."""
        some = np.flatnonzero(last > first)
        who, row, first, last = who[some], row[some], first[some], last[some]
        turns = first // self.size[row]
        first, last = first - turns * self.size[row], last - turns * self.size[row]
        ends = np.cumsum(last - first)
        cosine = math.cos(self.angle)
        at = 0
        while at < len(who):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            n, r, i = (last - first)[at:to], row[at:to], self.left[who[at:to]]
            begins = ends[at:to] - n - done
            j = np.arange(int(ends[to - 1]) - done) + np.repeat(first[at:to] + self.start[r] - begins, n)
            if (last[at:to] > self.size[r]).any():
                j -= np.where(j >= np.repeat(self.start[r] + self.size[r], n), np.repeat(self.size[r], n), 0)
            dot = np.repeat(self.x[i], n) * self.x[j] + np.repeat(self.y[i], n) * self.y[j] + np.repeat(self.z[i], n) * self.z[j]
            near = dot > cosine + SURE
            close = np.flatnonzero(np.abs(dot - cosine) <= SURE)
            if len(close):
                k, m = np.repeat(i, n)[close], j[close]
                near[close] = np_haversine_km(self.lat[k], self.lng[k], self.lat[m], self.lng[m]) <= eps_km
            # a point can have two ranges of a strip, but not in one call
            out[who[at:to]] += np.add.reduceat(near.astype(np.int64) if self.even else near * self.weight[j], begins)
            at = to


def count_near(block: np.ndarray, lat: np.ndarray, lng: np.ndarray, weight: np.ndarray, own: np.ndarray, eps_km: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the points of its block within ``eps_km`` of each point that is ``own``: their numbers, and the weights.

    A circle covers at every latitude an interval of longitudes. Of a strip of latitudes, the points within the least of
    its intervals are near for sure, and counted by the ranks of the interval's ends; those beyond the greatest are not;
    the few in between are compared. With more strips to a radius fewer are: their number follows the number of points,
    so that the work grows as the power 1.5 of the points in reach of each other and not as the square, until there are
    ``MAX_STRIPS``.
    """
    if not own.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    angle = min(max(eps_km / EARTH_RADIUS_KM, 0.0), math.pi)
    _, at = np.unique(block, return_inverse=True)
    points, asked = np.bincount(at), np.bincount(at, own)
    shares = int(np.clip(math.sqrt(STRIP_SHARE * float(points @ asked) / float(asked.sum()) / 12), 1, MAX_STRIPS))
    height = max(angle * 1.000001, MIN_ANGLE) / shares + 1e-9
    s = _Strips(block, lat, lng, weight, own, angle, height)
    found = np.zeros(len(s.left), np.int64)
    cosine = math.cos(angle)
    sin0, cos0 = np.sin(s.phi), np.cos(s.phi)
    levels, level = np.unique(s.strip, return_inverse=True)

    def widths(step: int) -> tuple[np.ndarray, ...]:
        """Sine at the lower edge of the strip ``step`` above a point's own, and what the circle covers there for sure, and at most."""
        edge = np.clip((levels + step) * height - math.pi / 2, -math.pi / 2, math.pi / 2)
        sin1, cos1 = np.sin(edge)[level], np.cos(edge)[level]
        return sin1, _half_width(cosine + SURE, sin0, cos0, sin1, cos1, 2.0), _half_width(cosine - SURE, sin0, cos0, sin1, cos1, -1.0)

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        # the latitude at which the circle is widest or, if it is more than half of the sphere, narrowest
        turning = sin0 / cosine
        side = math.copysign(1.0, cosine)
        extreme = side * np.sqrt(np.maximum(0.0, (cosine - side * SURE) ** 2 - sin0 * sin0 - 1e-15)) / cos0
        extreme = np.where(np.isnan(extreme), -side, extreme)
        extreme = np.where(extreme > 1, -1.0, np.arccos(np.clip(extreme, -1, 1)))
        low = widths(-shares)
        for step in range(-shares, shares + 1):
            high = widths(step + 1)
            holds = (turning >= low[0] - 1e-9) & (turning <= high[0] + 1e-9)
            sure, most = np.minimum(low[1], high[1]), np.maximum(low[2], high[2])
            if cosine > 0:
                most = np.where(holds, np.maximum(most, extreme), most)
            else:
                sure = np.where(holds, np.minimum(sure, extreme), sure)
            low = high
            key = s.key + step
            row = np.minimum(np.searchsorted(s.rows, key), len(s.rows) - 1)
            inside = (s.strip + step >= 0) & (s.strip + step < s.strips)
            who = np.flatnonzero(inside & (s.rows[row] == key) & (most >= 0))
            if not len(who):
                continue
            row, sure, most, place = row[who], sure[who], most[who], s.place[who]
            sure, most = sure / (2 * math.pi) * TURN, most / (2 * math.pi) * TURN
            first = np.floor(place - most).astype(np.int64) - 1
            last = np.minimum(np.ceil(place + most).astype(np.int64) + 2, first + TURN)
            begin = np.maximum(np.ceil(place - sure).astype(np.int64) + 1, first)
            end = np.minimum(np.floor(place + sure).astype(np.int64) - 1, last)
            none, all_ = end <= begin, sure >= TURN / 2
            begin, end = np.where(none | all_, first, begin), np.where(all_, first + TURN, np.where(none, first, end))
            last = np.where(all_, first + TURN, last)
            first, begin, end, last = (s.rank(row, q) for q in (first, begin, end, last))
            found[who] += s.weighed(row, end) - s.weighed(row, begin)
            s.compared(found, who, row, first, begin, eps_km)
            s.compared(found, who, row, end, last, eps_km)
    return s.order[s.left], found


def counted(batches: Iterator[pa.RecordBatch], eps_km: float) -> Iterator[pa.RecordBatch]:
    """``count_near`` of a task's rows ``(block, lat, lng, weight, own)``, as ``(lat, lng, n)`` of the points that are ``own``."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.Table.from_batches(tables)
    block, lat, lng, weight, own = (rows.column(c).to_numpy() for c in ("block", "lat", "lng", "weight", "own"))
    at, n = count_near(block, lat, lng, weight, own, eps_km)
    yield pa.RecordBatch.from_arrays([pa.array(lat[at]), pa.array(lng[at]), pa.array(n)], ["lat", "lng", "n"])
