"""Tours and vehicle routes: sweep, assignment, search and schedule.

A request is a handful of stops, so its search runs in one grouped call; requests, and the vehicles of a request, run
side by side. The search is bounded by counted evaluations, never by the clock: the same input gives the same routes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.errors import ROUTE_FAIL, DomainError, as_service_error
from waymark.functions.geo import np_distance_matrix, np_normalize_lng, py_round, shortest_lng_delta

EXACT_STOPS = 8
MAX_PASSES = 1000
EVALUATIONS, LEAST_EVALUATIONS = 40_000_000, 20_000
TIE = 1e-9
DEFAULT_SPEED_KMH = 40.0


# ---- tours -------------------------------------------------------------------------------------------------------


def tour_length(order: np.ndarray, km: np.ndarray, closed: bool) -> float:
    order = np.asarray(order)
    total = float(km[order[:-1], order[1:]].sum())
    return total + float(km[order[-1], order[0]]) if closed and len(order) > 1 else total


def _orders(n: int, start: int) -> np.ndarray:
    """All orders that begin at ``start``, a row each: every place is swapped in turn with each place behind it."""
    orders = np.array([[start, *(i for i in range(n) if i != start)]])
    for place in range(1, n - 1):
        orders = np.repeat(orders, n - place, axis=0)
        row = np.arange(len(orders))
        other = place + row % (n - place)
        here, there = orders[row, place], orders[row, other]
        orders[row, place], orders[row, other] = there, here
    return orders


def _exact(n: int, start: int, cost: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The best of all orders: least lateness, then least distance, then the first of ``_orders``."""
    orders = _orders(n, start)
    late, km = cost(orders)
    fine = np.flatnonzero(late <= late.min() + TIE)
    return orders[fine[np.flatnonzero(km[fine] <= km[fine].min() + TIE)[0]]]


def _lengths(orders: np.ndarray, km: np.ndarray, closed: bool) -> np.ndarray:
    total = km[orders[:, :-1], orders[:, 1:]].sum(axis=1)
    return total + km[orders[:, -1], orders[:, 0]] if closed and orders.shape[1] > 1 else total


def _greedy(n: int, start: int, km: np.ndarray) -> np.ndarray:
    """Always on to the nearest stop that is left."""
    order, left = [start], np.ones(n, bool)
    left[start] = False
    while left.any():
        row = np.where(left, km[order[-1]], np.inf)
        order.append(int(row.argmin()) if np.isfinite(row).any() else int(np.flatnonzero(left)[0]))
        left[order[-1]] = False
    return np.array(order)


def _reversal(order: np.ndarray, km: np.ndarray, closed: bool) -> np.ndarray | None:
    """The order after the reversal of a stretch that saves most, for costs that may differ by direction."""
    n = len(order)
    there = np.concatenate(([0.0], np.cumsum(km[order[:-1], order[1:]])))
    back = np.concatenate(([0.0], np.cumsum(km[order[1:], order[:-1]])))
    i, k = np.triu_indices(n, 1)
    i, k = i[i > 0], k[i > 0]
    if not len(i):
        return None
    after = order[(k + 1) % n]
    link = (k + 1 < n) | closed
    now = km[order[i - 1], order[i]] + there[k] - there[i] + np.where(link, km[order[k], after], 0.0)
    then = km[order[i - 1], order[k]] + back[k] - back[i] + np.where(link, km[order[i], after], 0.0)
    at = int((now - then).argmax())
    if now[at] - then[at] <= TIE:
        return None
    out = order.copy()
    out[i[at] : k[at] + 1] = order[i[at] : k[at] + 1][::-1]
    return out


def _moved(order: np.ndarray, km: np.ndarray, closed: bool) -> np.ndarray | None:
    """The order after the move of a segment, of up to three stops or (open tours) of the whole end, that saves most."""
    n = len(order)
    best, out = TIE, None
    sizes = [1, 2, 3] + ([m for m in range(4, n - 1)] if not closed else [])
    for size in sizes:
        starts = [n - size] if size > 3 else range(1, n - size + 1)
        for i in starts:
            if i < 1:
                continue
            end = i + size - 1
            rest = np.concatenate((order[:i], order[end + 1 :]))
            head, tail, before = order[i], order[end], order[i - 1]
            has_next = end + 1 < n or closed
            following = order[(end + 1) % n]
            saved = km[before, head] + (km[tail, following] - km[before, following] if has_next else 0.0)
            follow = np.concatenate((rest[1:], rest[:1]))
            joint = np.ones(len(rest), bool)
            joint[-1] = closed
            added = km[rest, head] + np.where(joint, km[tail, follow] - km[rest, follow], 0.0)
            added[i - 1] = np.inf
            at = int(added.argmin())
            if saved - added[at] > best:
                best, out = saved - added[at], np.concatenate((rest[: at + 1], order[i : end + 1], rest[at + 1 :]))
    return out


def _descend(order: np.ndarray, km: np.ndarray, closed: bool) -> np.ndarray:
    for _ in range(MAX_PASSES):
        better = _reversal(order, km, closed)
        if better is None:
            better = _moved(order, km, closed)
        if better is None:
            return order
        order = better
    return order


def solve_tsp(km: np.ndarray, closed: bool = True, start: int = 0, exact_stops: int = EXACT_STOPS) -> tuple[list[int], float]:
    """One tour over all stops of a cost matrix, and its length."""
    n = len(km)
    if n == 0:
        raise DomainError("EMPTY", "TSP requires at least one point")
    if not 0 <= start < n:
        raise DomainError("OUT_OF_RANGE", "startIndex is out of range")
    if n == 1:
        return [0], 0.0
    if n <= exact_stops:
        order = _exact(n, start, lambda o: (np.zeros(len(o)), _lengths(o, km, closed)))
    else:
        order = _descend(_greedy(n, start, km), km, closed)
    return order.tolist(), tour_length(order, km, closed)


# ---- schedules ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stops:
    """Stops of a request, the depot among them; NaN where a time is not given."""

    lat: np.ndarray
    lng: np.ndarray
    demand: np.ndarray
    ready: np.ndarray
    due: np.ndarray
    service: np.ndarray

    def __len__(self) -> int:
        return len(self.lat)

    @property
    def timed(self) -> np.ndarray:
        return ~(np.isnan(self.ready) & np.isnan(self.due))


@dataclass(frozen=True)
class Costs:
    km: np.ndarray
    minutes: np.ndarray
    closed: bool


def lateness(orders: np.ndarray, stops: Stops, costs: Costs) -> np.ndarray:
    """Total minutes late of each of many orders (rows), all advanced stop by stop."""
    ready, service = np.nan_to_num(stops.ready), np.nan_to_num(stops.service)
    due = np.where(np.isnan(stops.due), np.inf, stops.due)
    clock, late = np.zeros(len(orders)), np.zeros(len(orders))
    for place in range(orders.shape[1]):
        at = orders[:, place]
        if place:
            clock = clock + costs.minutes[orders[:, place - 1], at]
            late += np.maximum(0, clock - due[at])
        clock = np.maximum(clock, ready[at]) + service[at]
    if costs.closed and orders.shape[1] > 1:
        clock = clock + costs.minutes[orders[:, -1], orders[:, 0]]
        late += np.maximum(0, clock - due[orders[:, 0]])
    return late


def schedule(order: list[int], stops: Stops, costs: Costs) -> dict:
    """Arrivals, waits and departures along an order, and what is late; the depot is only due on the way back."""
    at = np.array(order, int)
    path = np.append(at, at[0]) if costs.closed and len(at) > 1 else at
    legs = np.concatenate(([0.0], costs.minutes[path[:-1], path[1:]]))
    ready, service, due = np.nan_to_num(stops.ready[path]), np.nan_to_num(stops.service[path]), stops.due[path]
    # a departure follows from the one before it, as in ``schedule_orders``
    left = np.fromiter(itertools.accumulate(zip(legs, ready, service), lambda clock, x: max(clock + x[0], x[1]) + x[2], initial=0.0), float)
    arrival, departure = left[:-1] + legs, left[1:]
    late = np.where(np.arange(len(path)) > 0, np.fmax(arrival - due, 0.0), 0.0)
    wait = np.maximum(ready - arrival, 0.0)
    visits = [
        {"index": i, "arrival_min": a, "wait_min": w, "departure_min": d, "late_min": x if x > 0 else None}
        for i, a, w, d, x in zip(at.tolist(), arrival.tolist(), wait.tolist(), departure.tolist(), late.tolist())
    ]
    violations = [
        {"index": int(path[k]), "arrival_min": float(arrival[k]), "due_time_min": float(due[k]), "late_min": float(late[k]), "return_to_depot": True if k == len(at) else None}
        for k in np.flatnonzero(late > 0).tolist()
    ]
    back = len(path) > len(at)
    return {
        "stops": visits, "violations": violations, "distance_km": tour_length(at, costs.km, costs.closed),
        "duration_min": float(arrival[-1] if back else departure[-1]) if len(at) else 0.0,
    }


def _repair(order: np.ndarray, stops: Stops, costs: Costs) -> np.ndarray:
    """Best reversal or move of one stop, judged by lateness and then distance, until none helps or the budget is spent."""
    n = len(order)
    left = max(LEAST_EVALUATIONS, EVALUATIONS // n)

    def judged(orders: np.ndarray) -> tuple[float, float, np.ndarray]:
        late, km = lateness(orders, stops, costs), _lengths(orders, costs.km, costs.closed)
        fine = np.flatnonzero(late <= late.min() + TIE)
        at = fine[int(km[fine].argmin())]
        return float(late[at]), float(km[at]), orders[at]

    late, km, order = judged(order[None, :])
    for _ in range(MAX_PASSES):
        options = [np.concatenate((order[:i], order[i : k + 1][::-1], order[k + 1 :])) for i in range(1, n - 1) for k in range(i + 1, n)]
        for i in range(1, n):
            rest = np.delete(order, i)
            options += [np.insert(rest, j, order[i]) for j in range(1, n) if j != i]
        options = options[:left]
        if not options:
            break
        left -= len(options)
        new = judged(np.array(options))
        if not (new[0] < late - TIE or (abs(new[0] - late) <= TIE and new[1] < km - TIE)):
            break
        late, km, order = new
        if left <= 0:
            break
    return order


def solve_route(group: list[int], stops: Stops, costs: Costs, exact_stops: int = EXACT_STOPS) -> dict:
    """Route of one vehicle over a group of stops whose first is the depot; never later than the greedy tour, nor longer
    and as late."""
    own = np.array(group)
    part = Stops(*(getattr(stops, f)[own] for f in ("lat", "lng", "demand", "ready", "due", "service")))
    local = Costs(costs.km[np.ix_(own, own)], costs.minutes[np.ix_(own, own)], costs.closed)
    timed = bool(part.timed.any())
    cost = lambda o: (lateness(o, part, local) if timed else np.zeros(len(o)), _lengths(o, local.km, costs.closed))
    if len(own) <= exact_stops:
        order = _exact(len(own), 0, cost)
    else:
        greedy = _greedy(len(own), 0, local.km)
        order = _descend(greedy, local.km, costs.closed)
        if timed and lateness(order[None, :], part, local)[0] > TIE:
            order = _repair(order, part, local)
        # shorter tours can be later: where the search ends above the greedy tour, it starts again from there, be stops
        # equally near taken in the order of the sweep or in that of the request
        given = np.concatenate(([0], 1 + np.argsort(own[1:], kind="stable")))
        for start in (greedy, given[_greedy(len(own), 0, local.km[np.ix_(given, given)])]):
            late, km = cost(np.array([order, start]))
            if late[1] < late[0] - TIE or (late[1] <= late[0] + TIE and km[1] < km[0] - TIE):
                order = _repair(start, part, local)
    found = schedule(own[order].tolist(), stops, costs)
    return {**found, "demand": float(np.nan_to_num(stops.demand[own[order][1:]]).sum())}


# ---- assignment --------------------------------------------------------------------------------------------------


def angles(north: pd.Series, east: pd.Series, lat: pd.Series) -> pd.Series:
    """Angle of each stop that lies ``north`` and ``east`` degrees of a depot at ``lat``.

    By the functions of the C library, one number at a time: those of the JVM and numpy's vector versions may differ in
    the last bit, which is all that tells stops in line with the depot apart.
    """
    # nowhere without a finite latitude
    return pd.Series([math.atan2(n, e * math.cos(math.radians(a))) if math.isfinite(a) else math.nan for n, e, a in zip(north, east, lat)], dtype=float)


def sweep(stops: Stops, depot: int) -> list[int]:
    """All stops but the depot by angle around it, starting behind the widest gap."""
    others = np.array([i for i in range(len(stops)) if i != depot], int)
    if not len(others):
        return []
    north, east = stops.lat[others] - stops.lat[depot], np_normalize_lng(stops.lng[others] - stops.lng[depot])
    angle = angles(north.tolist(), east.tolist(), itertools.repeat(float(stops.lat[depot]))).to_numpy()
    order = np.lexsort((others, angle))
    gaps = np.diff(angle[order], prepend=angle[order[-1]] - 2 * math.pi)
    # of gaps within the tolerance of the widest, the first
    return np.roll(others[order], -int((gaps >= gaps.max() - TIE).argmax())).tolist()


def assign(stops: Stops, depot: int, vehicles: int, capacity: float | None) -> tuple[list[list[int]], list[int]]:
    """Stops of each vehicle that has any (depot first), and stops that none can take.

    The sweep is cut into runs, one a vehicle: as long as its even share, but no longer than its capacity reaches. What
    is left behind the last run goes stop by stop to the first vehicle with room, whatever its share.
    """
    order = np.array(sweep(stops, depot), int)
    demand, most = np.nan_to_num(stops.demand), math.inf if capacity is None else capacity
    fitting = order[demand[order] <= most]
    load, groups, done = np.zeros(vehicles), [], 0
    for vehicle, run in enumerate(np.array_split(order, vehicles)):
        reach = np.cumsum(demand[fitting[done : done + len(run)]])
        n = int(np.append(reach > most, True).argmax())
        groups.append([depot, *fitting[done : done + n].tolist()])
        load[vehicle] = reach[n - 1] if n else 0.0
        done += n
    unassigned = order[demand[order] > most].tolist()
    for stop in fitting[done:].tolist():
        room = np.flatnonzero(load + demand[stop] <= most)
        if len(room):
            groups[room[0]].append(stop)
            load[room[0]] += demand[stop]
        else:
            unassigned.append(stop)
    return [group for group in groups if len(group) > 1], sorted(unassigned)


def check(stops: Stops, km: np.ndarray, minutes: np.ndarray, depot: int) -> None:
    n = len(stops)
    if n < 2:
        raise DomainError("EMPTY", "VRP requires at least two waypoints")
    if not 0 <= depot < n:
        raise DomainError("OUT_OF_RANGE", f"startIndex {depot} is out of range")
    if km.shape != (n, n) or minutes.shape != (n, n):
        raise DomainError("MATRIX_SIZE", "cost matrix dimensions do not match the number of waypoints")
    for i in np.flatnonzero(stops.ready > stops.due):
        raise DomainError("INVALID_TIME_WINDOW", f"waypoint {i} has readyTimeMin greater than dueTimeMin")


def solve_vrp(
    stops: Stops, vehicles: int = 1, capacity: float | None = None, closed: bool = True, depot: int = 0, speed_kmh: float = DEFAULT_SPEED_KMH,
    km: np.ndarray | None = None, minutes: np.ndarray | None = None, exact_stops: int = EXACT_STOPS,
) -> dict:
    """Routes of all vehicles, stops left over, and totals. Without matrices: great-circle distances at ``speed_kmh``."""
    km = np_distance_matrix(stops.lat, stops.lng) if km is None else np.asarray(km, np.float64)
    if minutes is None:
        if speed_kmh <= 0:
            raise DomainError("INVALID_SPEED", "averageSpeedKmh must be positive")
        minutes = km / speed_kmh * 60
    check(stops, km, np.asarray(minutes), depot)
    costs = Costs(km, np.asarray(minutes, np.float64), closed)
    groups, unassigned = assign(stops, depot, vehicles, capacity)
    routes = [{"vehicle_id": v, **solve_route(g, stops, costs, exact_stops)} for v, g in enumerate(groups)]
    return {
        "routes": routes,
        "unassigned": unassigned,
        "total_distance_km": sum(r["distance_km"] for r in routes),
        "total_duration_min": sum(r["duration_min"] for r in routes),
        "feasible": not unassigned and not any(r["violations"] for r in routes),
    }


# ---- DataFrames --------------------------------------------------------------------------------------------------

STOP = "array<struct<index:int,id:string,arrival_min:double,wait_min:double,departure_min:double,late_min:double>>"
VIOLATION = "array<struct<index:int,arrival_min:double,due_time_min:double,late_min:double,return_to_depot:boolean>>"
WAYPOINT = ("lat", "lng", "demand", "ready_time_min", "due_time_min", "service_time_min")


def _stops(pdf: pd.DataFrame) -> Stops:
    return Stops(*(pdf[c].to_numpy(np.float64, na_value=np.nan) if c in pdf else np.full(len(pdf), np.nan) for c in WAYPOINT))


def _matrices(costs: pd.DataFrame, n: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Long-form costs (i, j, km, min) as matrices; without minutes, or without rows, the matrix is None."""
    if not len(costs):
        return None, None
    if len(costs) != n * n or costs["i"].max() >= n or costs["j"].max() >= n:
        raise DomainError("MATRIX_SIZE", "cost matrix dimensions do not match the number of waypoints")
    out = []
    for c in ("km", "min"):
        values = costs[c].to_numpy(np.float64, na_value=np.nan)
        m = np.full((n, n), np.nan)
        m[costs["i"].to_numpy(int), costs["j"].to_numpy(int)] = values
        out.append(None if np.isnan(m).any() else m)
    return out[0], out[1]


def optimize_routes(waypoints: DataFrame, options: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """One row a vehicle of each request: request_id, vehicle_id, stops, distance_km, duration_min, demand, violations,
    unassigned, distance_source, error (rounded as shown to callers: 3 and 2 decimals).

    ``waypoints``: request_id, idx, lat, lng and optionally id, demand, ready_time_min, due_time_min, service_time_min.
    ``options``: request_id, vehicle_count, capacity, closed, start_index, average_speed_kmh. ``costs``: optional road
    costs (request_id, i, j, km, min). Stops are assigned per request, then each vehicle is a group of its own, so the
    vehicles of a request are searched in parallel. A request without routes has one row without vehicle_id.
    """
    kind = waypoints.schema["request_id"].dataType.simpleString()
    point = F.struct("idx", *(F.col(c).cast("double").alias(c) if c in waypoints.columns else F.lit(None).cast("double").alias(c) for c in WAYPOINT),
                     (F.col("id").cast("string") if "id" in waypoints.columns else F.lit(None).cast("string")).alias("id"))
    requests = waypoints.groupBy("request_id").agg(F.array_sort(F.collect_list(point)).alias("points")).join(options, "request_id")
    if costs is None:
        requests = requests.withColumn("costs", F.lit(None).cast("array<struct<i:int,j:int,km:double,min:double>>"))
    else:
        table = costs.groupBy("request_id").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("km").cast("double").alias("km"), F.col("min").cast("double").alias("min"))).alias("costs"))
        requests = requests.join(table, "request_id", "left")
    split = "group array<int>, vehicle_id int, unassigned array<int>, error string"

    def problem(row: object) -> tuple[Stops, np.ndarray, np.ndarray]:
        stops = _stops(pd.DataFrame([p.asDict() if hasattr(p, "asDict") else p for p in row["points"]]))
        listed = row["costs"]
        table = pd.DataFrame([c.asDict() if hasattr(c, "asDict") else c for c in listed], columns=["i", "j", "km", "min"]) if listed is not None else pd.DataFrame(columns=["i", "j", "km", "min"])
        km, minutes = _matrices(table, len(stops))
        km = np_distance_matrix(stops.lat, stops.lng) if km is None else km
        if minutes is None:
            if row["average_speed_kmh"] <= 0:
                raise DomainError("INVALID_SPEED", "averageSpeedKmh must be positive")
            minutes = km / row["average_speed_kmh"] * 60
        return stops, km, minutes

    def assigned(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    stops, km, minutes = problem(row)
                    check(stops, km, minutes, int(row["start_index"]))
                    capacity = None if pd.isna(row["capacity"]) else float(row["capacity"])
                    groups, unassigned = assign(stops, int(row["start_index"]), int(row["vehicle_count"]), capacity)
                    parts = [(g, v, unassigned, None) for v, g in enumerate(groups)] or [(None, None, unassigned, None)]
                except DomainError as error:
                    parts = [(None, None, None, str(as_service_error(error, ROUTE_FAIL)))]
                rows += [{**row, "group": g, "vehicle_id": v, "unassigned": u, "error": e} for g, v, u, e in parts]
            yield pd.DataFrame(rows, columns=[*pdf.columns, "group", "vehicle_id", "unassigned", "error"]).astype({"vehicle_id": "Int32"})

    needed = requests.select("request_id", "points", "costs", "vehicle_count", "capacity", "closed", "start_index", "average_speed_kmh")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in needed.schema.fields)
    vehicles = needed.mapInPandas(assigned, f"{ddl}, {split}").repartition(F.col("request_id"), F.col("vehicle_id"))
    out = f"request_id {kind}, vehicle_id int, stops {STOP}, distance_km double, duration_min double, demand double, violations {VIOLATION}, unassigned array<int>, distance_source string, error string"

    def routed(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                source = "haversine" if row["costs"] is None else "table"
                if row["group"] is None:
                    rows.append((row["request_id"], None, None, None, None, None, None, row["unassigned"], source, row["error"]))
                    continue
                stops, km, minutes = problem(row)
                found = solve_route([int(i) for i in row["group"]], stops, Costs(km, minutes, bool(row["closed"])))
                names = [p["id"] for p in row["points"]]
                rows.append((
                    row["request_id"], int(row["vehicle_id"]), [shown({**s, "id": names[s["index"]]}) for s in found["stops"]], py_round(found["distance_km"], 3),
                    py_round(found["duration_min"], 2), found["demand"], [shown(x) for x in found["violations"]], row["unassigned"], source, None,
                ))
            columns = [c.split(" ")[0] for c in ("request_id", "vehicle_id", "stops", "distance_km", "duration_min", "demand", "violations", "unassigned", "distance_source", "error")]
            yield pd.DataFrame(rows, columns=columns).astype({"vehicle_id": "Int32"})

    return vehicles.mapInPandas(routed, out)


def shown(row: dict) -> dict:
    """A stop or violation with its minutes rounded; the due time stays as given."""
    return {k: py_round(v, 2) if k.endswith("_min") and k != "due_time_min" and v is not None else v for k, v in row.items()}


def route_summary(routes: DataFrame) -> DataFrame:
    """One row a request: request_id, feasible, total_distance_km, total_duration_min, n_routes, unassigned, error."""
    return routes.groupBy("request_id").agg(
        (F.bool_and(F.coalesce(F.size("violations") == 0, F.lit(True))) & F.bool_and(F.coalesce(F.size("unassigned") == 0, F.lit(False)))).alias("feasible"),
        F.coalesce(F.sum("distance_km"), F.lit(0.0)).alias("total_distance_km"), F.coalesce(F.sum("duration_min"), F.lit(0.0)).alias("total_duration_min"),
        F.count("vehicle_id").alias("n_routes"), F.first("unassigned").alias("unassigned"), F.first("error").alias("error"),
    )


def sweep_order(points: DataFrame, key: str, idx: str, depot: Column) -> DataFrame:
    """``(key, idx, seq)``: stops of each group by angle around its depot row, from behind the widest gap; windows, and the
    angles of ``sweep``, as Spark's own arc tangent puts stops in line with the depot into another order."""
    base = points.where(depot).select(key, F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    north, east = F.col("lat") - F.col("_lat"), shortest_lng_delta("_lng", "lng")
    rows = points.where(~depot).join(base, key).select(key, idx, F.pandas_udf(angles, "double")(north, east, "_lat").alias("angle"))
    w = Window.partitionBy(key).orderBy("angle", idx)
    whole = Window.partitionBy(key)
    gap = F.col("angle") - F.coalesce(F.lag("angle").over(w), F.max("angle").over(whole) - 2 * math.pi)
    placed = rows.withColumn("n", F.row_number().over(w)).withColumn("gap", gap)
    # of gaps within the tolerance of the widest, the first
    placed = placed.withColumn("widest", F.max("gap").over(whole))
    placed = placed.withColumn("start", F.min(F.when(F.col("gap") >= F.col("widest") - TIE, F.col("n"))).over(whole))
    seq = F.pmod(F.col("n") - F.col("start"), F.count("*").over(whole)).cast("int")
    return placed.select(key, idx, seq.alias("seq"))


def assign_even(order: DataFrame, key: str, vehicles: int) -> DataFrame:
    """Vehicles without a capacity: even runs of the sweep order."""
    return order.withColumn("vehicle_id", (F.ntile(vehicles).over(Window.partitionBy(key).orderBy("seq")) - 1).cast("int"))


def schedule_orders(visits: DataFrame, key: str, closed: bool = False) -> DataFrame:
    """Times along given orders: ``(key, seq, arrival_min, wait_min, departure_min, late_min)``.

    ``visits``: key, seq, leg_min (from the visit before; ignored at the first), ready_min, due_min, service_min. Waits
    make a visit depend on the one before it, so each order is folded as an array, in SQL.
    """
    step = F.struct("seq", *(F.col(c).cast("double").alias(c) for c in ("leg_min", "ready_min", "due_min", "service_min")))
    orders = visits.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("v"))
    folded = F.expr("""
        aggregate(v, cast(array() as array<struct<seq:int,arrival_min:double,wait_min:double,departure_min:double,late_min:double>>), (acc, x) ->
          concat(acc, transform(array(if(size(acc) = 0, 0D, element_at(acc, -1).departure_min + x.leg_min)), a -> named_struct(
            'seq', cast(x.seq as int), 'arrival_min', a, 'wait_min', greatest(0D, coalesce(x.ready_min, 0D) - a),
            'departure_min', greatest(a, coalesce(x.ready_min, 0D)) + coalesce(x.service_min, 0D),
            'late_min', if(size(acc) = 0, 0D, greatest(0D, a - coalesce(x.due_min, a)))))))
    """)
    return orders.select(key, F.inline(folded))
