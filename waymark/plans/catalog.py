"""Registered queries over the harness tables and their DuckDB SQL.

The tables hold no coordinates, so each row's point is derived from its key by integer arithmetic, in the same text for
Spark and for DuckDB. Results are rounded as the public operations round them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.errors import MASK, PARAMETER, USER_INFO, redact_column
from waymark.functions.geo import (
    distinct_points,
    duration_min,
    haversine_km,
    line_distance_km,
    normalize_lng,
    round_deg,
    round_half_up,
    round_km,
    round_min,
    spherical_mean,
)
from waymark.functions.geojson import feature_collection_column, kept_by_simplification, simplify_column, validate_column
from waymark.functions.rng import Mulberry32
from waymark.operators import boundary, clustering, proximity, routing
from waymark.operators.requests import answer_requests
from waymark.session import checkpoint_dir, cut_lineage
from waymark.sources.geocoding import gazetteer_lookup
from waymark.streaming import geofence

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text that both engines read -----------------------------------------------------------------------------------


def lat_of(key: str) -> str:
    return f"((({key})*7919) % 17001)/100.0e0 - 85.0e0"


def lng_of(key: str) -> str:
    return f"((({key})*104729) % 36001)/100.0e0 - 180.0e0"


#: Forty towns some degrees apart, with a few hundred metres to a few kilometres between the points of each.
def town_lat(key: str) -> str:
    return f"(({key}) % 40)*3.5e0 - 68.0e0 + ((({key})*7919) % 211)/2000.0e0"


def town_lng(key: str) -> str:
    return f"((({key}) % 40)*47) % 360 - 180.0e0 + ((({key})*104729) % 223)/2000.0e0"


def points(df: DataFrame, key: str, *columns: str, lat: Callable = lat_of, lng: Callable = lng_of) -> DataFrame:
    return df.select(key, *columns, F.expr(lat(key)).alias("lat"), F.expr(lng(key)).alias("lng"))


def sql_norm(x: str) -> str:
    wrapped = f"((({x}) + 180.0e0) % 360.0e0 + 360.0e0) % 360.0e0 - 180.0e0"
    return f"(case when ({x}) between -180.0e0 and 180.0e0 then ({x}) when {wrapped} = -180.0e0 and ({x}) > 0 then 180.0e0 else {wrapped} end)"


def sql_km(alat: str, alng: str, blat: str, blng: str) -> str:
    side = f"sin(radians({sql_norm(f'({blng}) - ({alng})')})/2)"
    up = f"sin(radians(({blat}) - ({alat}))/2)"
    return f"(12742.0e0*asin(least(1.0e0, sqrt({up}*{up} + cos(radians({alat}))*cos(radians({blat}))*{side}*{side}))))"


def sql_round(x: str, digits: int) -> str:
    return f"(floor(({x})*1e{digits} + 0.5e0)/1e{digits} + 0.0e0)"


def _points_sql(name: str, key: str, *columns: str, lat: Callable = lat_of, lng: Callable = lng_of) -> str:
    return f"(select {', '.join((key, *columns))}, {lat(key)} as lat, {lng(key)} as lng from {name})"


CUSTOMERS, SUPPLIERS = _points_sql("customer", "c_custkey", "c_nationkey"), _points_sql("supplier", "s_suppkey", "s_nationkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey")


# ---- distances -----------------------------------------------------------------------------------------------------


@query(f"""
select c_custkey, s_suppkey, {sql_round('km', 3)} as km, {sql_round('km/40.0e0*60', 2)} as duration_min
from (select c_custkey, s_suppkey, {sql_km('c.lat', 'c.lng', 's.lat', 's.lng')} as km from {CUSTOMERS} c cross join {SUPPLIERS} s)
""")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.distance_matrix(customers(spark, sf_dir).drop("c_nationkey"), suppliers(spark, sf_dir).drop("s_nationkey"), max_cells=None)


@query(f"""
select c_custkey, s_suppkey, {sql_round('km', 3)} as km from (
  select *, row_number() over (partition by c_custkey order by km, s_suppkey) as n
  from (select c_custkey, s_suppkey, {sql_km('c.lat', 'c.lng', 's.lat', 's.lng')} as km from {CUSTOMERS} c cross join {SUPPLIERS} s)
) where n = 1
""")
def nearest_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proximity.nearest(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey")
    return found.withColumn("km", round_km("km"))


EPS_KM = 250.5


@query(f"""
select a.c_custkey as c_custkey, count(*) as n_neighbors from {CUSTOMERS} a join {CUSTOMERS} b
on {sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= {EPS_KM}e0 group by a.c_custkey
""")
def region_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.region_query(customers(spark, sf_dir), "c_custkey", EPS_KM)


@query(f"""
select c_custkey, s_suppkey, {sql_round('km', 3)} as km
from (select c_custkey, s_suppkey, {sql_km('c.lat', 'c.lng', 's.lat', 's.lng')} as km from {CUSTOMERS} c cross join {SUPPLIERS} s)
where km <= 900.5e0
""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = proximity.range_join(customers(spark, sf_dir).drop("c_nationkey"), suppliers(spark, sf_dir).drop("s_nationkey"), 900.5)
    return pairs.select("c_custkey", "s_suppkey", round_km("km").alias("km"))


#: Suppliers on each side of a matrix, about: nations of more are several requests.
MATRIX_SIDE = 200


@query(f"""
select a.s_nationkey as s_nationkey, a.s_suppkey as from_key, b.s_suppkey as to_key, {sql_round(sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng'), 3)} as km,
  {sql_round(sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng') + '/50.0e0*60', 2)} as duration_min
from {SUPPLIERS} a join {SUPPLIERS} b on a.s_nationkey = b.s_nationkey
""")
def request_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested matrices of the suppliers of each nation, unnested again.

    A nation of many suppliers makes several requests, one for each two blocks of about ``MATRIX_SIDE`` of them.
    """
    s = suppliers(spark, sf_dir)
    blocks = s.groupBy("s_nationkey").agg(F.ceil(F.count("*") / MATRIX_SIDE).cast("int").alias("blocks"))
    listed = s.join(blocks, "s_nationkey").withColumn("block", F.pmod(F.xxhash64("s_suppkey"), F.col("blocks")).cast("int"))
    listed = listed.groupBy("s_nationkey", "blocks", "block").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "lat", "lng"))).alias("p"))
    asked = listed.select("s_nationkey", F.col("p").alias("origins"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    requests = asked.join(listed.select("s_nationkey", "block", F.col("p").alias("destinations")), ["s_nationkey", "block"]).select(
        F.struct("s_nationkey", F.col("origins.s_suppkey").alias("from"), F.col("destinations.s_suppkey").alias("to")).alias("request_id"),
        "origins", "destinations", F.lit(50.0).alias("average_speed_kmh"),
    )
    # requests are small and their matrices are not: dealt out by number, which adaptive execution leaves alone
    requests = requests.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    nested = proximity.request_matrices(requests, max_cells=2**31 - 1)
    rows = nested.select("request_id", F.explode(F.arrays_zip(F.col("request_id.from").alias("from"), "distances_km", "durations_min")).alias("row"))
    cells = F.arrays_zip(F.col("request_id.to").alias("to"), F.col("row.distances_km").alias("km"), F.col("row.durations_min").alias("min"))
    cells = rows.select(F.col("request_id.s_nationkey").alias("s_nationkey"), F.col("row.from").alias("from_key"), F.explode(cells).alias("c"))
    return cells.select("s_nationkey", "from_key", F.col("c.to").alias("to_key"), F.col("c.km").alias("km"), F.col("c.min").alias("duration_min"))


# ---- scalars -------------------------------------------------------------------------------------------------------

_WIDE_LNG = "((o_orderkey*104729) % 360001)/100.0e0 - 1800.0e0"


@query(f"select o_orderkey, {sql_round(sql_norm(_WIDE_LNG), 6)} as lng_norm, {sql_round(sql_norm(f'10.0e0 - ({_WIDE_LNG})'), 6)} as delta from orders")
def normalize_longitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_WIDE_LNG).alias("x"))
    return o.select("o_orderkey", round_deg(normalize_lng("x")).alias("lng_norm"), round_deg(normalize_lng(F.lit(10.0) - F.col("x"))).alias("delta"))


_SIGNED = "(((o_orderkey*31) % 4001) - 2000)/1000.0e0"


@query(f"""
select o_orderkey, {sql_round(_SIGNED, 2)} as rounded_2, {sql_round(_SIGNED, 0)} as rounded_0, {sql_round('abs(' + _SIGNED + ')/60.0e0*60', 2)} as minutes
from orders
""")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SIGNED).alias("x"))
    return o.select("o_orderkey", round_half_up("x", 2).alias("rounded_2"), round_half_up("x", 0).alias("rounded_0"), round_min(duration_min(F.abs("x"), 60.0)).alias("minutes"))


def _sql_height() -> str:
    base, left, right = sql_km("0.0e0", "0.0e0", "10.0e0", "170.0e0"), sql_km("0.0e0", "0.0e0", "lat", "lng"), sql_km("10.0e0", "170.0e0", "lat", "lng")
    return f"""
select c_custkey, {sql_round('2*sqrt(greatest(0.0e0, h*(h - base)*(h - l)*(h - r)))/base', 3)} as km
from (select *, (base + l + r)/2 as h from (select c_custkey, {base} as base, {left} as l, {right} as r from {CUSTOMERS}))
"""


@query(_sql_height())
def line_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each customer to the line through (0, 0) and (10, 170)."""
    at = [F.lit(x) for x in (0.0, 0.0, 10.0, 170.0)]
    return customers(spark, sf_dir).select("c_custkey", round_km(line_distance_km(F.col("lat"), F.col("lng"), *at)).alias("km"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""
select page_id, regexp_replace(regexp_replace(u, {_sql_text(PARAMETER)}, '\\1{MASK}', 'g'), {_sql_text(USER_INFO)}, '\\1{MASK}@', 'g') as redacted
from (select page_id, 'GET ' || replace(url, '://', '://user' || page_id || ':pw@') || '&Token=t' || page_id || '&k=1' as u from pages)
""")
def redact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials and tokens planted in the page URLs, removed again."""
    user = F.concat(F.lit("://user"), F.col("page_id"), F.lit(":pw@"))
    u = F.concat(F.lit("GET "), F.replace("url", F.lit("://"), user), F.lit("&Token=t"), F.col("page_id"), F.lit("&k=1"))
    return table(spark, sf_dir, "pages").select("page_id", redact_column(u).alias("redacted"))


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query(f"""
select c_nationkey, {sql_round('degrees(atan2(z, sqrt(x*x + y*y)))', 6)} as lat, {sql_round('degrees(atan2(y, x))', 6)} as lng from (
  select c_nationkey, sum(cos(radians(lat))*cos(radians(lng))) as x, sum(cos(radians(lat))*sin(radians(lng))) as y, sum(sin(radians(lat))) as z
  from {CUSTOMERS} group by c_nationkey)
""")
def spherical_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = spherical_mean("lat", "lng")
    found = customers(spark, sf_dir).groupBy("c_nationkey").agg(mean["lat"].alias("lat"), mean["lng"].alias("lng"))
    return found.select("c_nationkey", round_deg("lat").alias("lat"), round_deg("lng").alias("lng"))


_EAST = _points_sql("customer", "c_custkey", "c_nationkey", lng=lambda k: f"((({k})*104729) % 9001)/100.0e0 + 140.0e0")


@query(f"""
with p as (select c_nationkey, lat, {sql_norm('lng')} as lng from {_EAST}),
d as (select distinct c_nationkey, lng from p),
g as (select c_nationkey, lng, lng - lag(lng) over w as gap, lag(lng) over w as prev from d window w as (partition by c_nationkey order by lng)),
b as (select *, row_number() over (partition by c_nationkey order by gap desc, lng) as n from g where gap is not null),
e as (select c_nationkey, min(lat) as min_lat, max(lat) as max_lat, min(lng) as a, max(lng) as z from p group by c_nationkey)
select e.c_nationkey, min_lat, case when coalesce(gap > a + 360 - z, false) then b.lng else a end as min_lng, max_lat,
  case when coalesce(gap > a + 360 - z, false) then b.prev else z end as max_lng, coalesce(gap > a + 360 - z, false) as crosses
from e left join b on e.c_nationkey = b.c_nationkey and n = 1
""")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of customers laid out around the antimeridian."""
    p = points(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", lng=lambda k: f"((({k})*104729) % 9001)/100.0e0 + 140.0e0")
    return boundary.bounding_box(p, "c_nationkey")


@query(f"""
select c_nationkey, count(distinct (lat, {sql_norm('lng')})) as n_distinct
from (select c_nationkey, ((c_custkey*7919) % 17)*1.0e0 as lat, ((c_custkey*104729) % 13)*90.0e0 as lng from customer) group by c_nationkey
""")
def count_distinct_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.expr("((c_custkey*7919) % 17)*1.0e0").alias("lat"), F.expr("((c_custkey*104729) % 13)*90.0e0").alias("lng"))
    return c.groupBy("c_nationkey").agg(distinct_points("lat", "lng").alias("n_distinct"))


@query(f"""
select c_nationkey, min(c_custkey) as c_custkey
from (select c_nationkey, c_custkey, ((c_custkey*7919) % 17)*1.0e0 as lat, ((c_custkey*104729) % 13)*90.0e0 as lng from customer) group by c_nationkey, lat, {sql_norm('lng')}
""")
def unique_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer at each point of a nation."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.expr("((c_custkey*7919) % 17)*1.0e0").alias("lat"), F.expr("((c_custkey*104729) % 13)*90.0e0").alias("lng"))
    return boundary.unique_points(c, "c_nationkey", order="c_custkey").select("c_nationkey", "c_custkey")


# ---- polygons ------------------------------------------------------------------------------------------------------

POLYGONS = {
    1: [(-40.005, -60.005), (55.005, -70.005), (60.005, 40.005), (5.005, 10.005), (-30.005, 50.005)],
    2: [(-50.005, 150.005), (-50.005, -150.005), (45.005, -140.005), (50.005, 160.005)],
    3: [(0.005, 0.005), (0.005, 30.005), (30.005, 30.005), (30.005, 0.005)],
}


def _sql_polygons() -> str:
    edges = [
        (i, *a, *b, any(abs(v[(k + 1) % len(v)][1] - v[k][1]) > 180 for k in range(len(v))))
        for i, v in POLYGONS.items()
        for a, b in zip(v, v[1:] + v[:1])
    ]
    values = ", ".join(f"({i}, {a}e0, {b}e0, {c}e0, {d}e0, {str(w).lower()})" for i, a, b, c, d, w in edges)
    east = lambda x: f"(case when wide and {x} < 0 then {x} + 360.0e0 else {x} end)"
    return f"""
with e(poly_id, alat, alng, blat, blng, wide) as (values {values})
select c_custkey, poly_id, sum(case when (alat > lat) <> (blat > lat)
  and {east('lng')} < ({east('alng')} - {east('blng')})*(lat - blat)/nullif(alat - blat, 0) + {east('blng')} then 1 else 0 end) % 2 = 1 as inside
from {CUSTOMERS} cross join e group by c_custkey, poly_id
"""


@query(_sql_polygons())
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.in_polygons(customers(spark, sf_dir), POLYGONS).select("c_custkey", "poly_id", "inside")


def _sql_inside() -> str:
    return f"select c_custkey, poly_id from ({_sql_polygons()}) where inside"


@query(_sql_inside())
def geofence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same polygons as a table, joined by grid cells."""
    rows = [(i, [{"lat": a, "lng": b} for a, b in v]) for i, v in POLYGONS.items()]
    fences = spark.createDataFrame(rows, "poly_id int, polygon array<struct<lat:double,lng:double>>")
    return boundary.geofence_join(customers(spark, sf_dir), fences).select("c_custkey", "poly_id")


@query(f"""
with e(poly_id, south, west, north, east) as (values (3, 0.005e0, 0.005e0, 30.005e0, 30.005e0))
select event_id, poly_id from {_points_sql('events', 'event_id')} cross join e
where lat >= south and lat < north and lng >= west and lng < east
""")
def stream_geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of points, matched with a fence, run until all files are read."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = f"{checkpoint_dir(spark)}/fenced-{uuid.uuid4()}"
    matched = geofence(points(stream, "event_id"), {3: POLYGONS[3]}).select("event_id", "poly_id")
    running = matched.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(matched.schema).parquet(f"{folder}/rows")


@query("""
with d as (select distinct s_nationkey as k, ((s_suppkey*37) % 101)*1.0e0 as x, ((s_suppkey*53) % 89)*1.0e0 as y from supplier),
side as (select a.k, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from d a join d b on a.k = b.k and (a.x <> b.x or a.y <> b.y))
select distinct k as s_nationkey, y1 as lat, x1 as lng from side s where not exists (
  select 1 from d p where p.k = s.k and (
    (x2 - x1)*(p.y - y1) - (y2 - y1)*(p.x - x1) < 0
    or ((x2 - x1)*(p.y - y1) - (y2 - y1)*(p.x - x1) = 0
      and ((p.x - x1)*(x2 - x1) + (p.y - y1)*(y2 - y1) < 0 or (p.x - x2)*(x1 - x2) + (p.y - y2)*(y1 - y2) < 0))))
union all select k, min(y), min(x) from d group by k having count(*) = 1
""")
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the suppliers of each nation, on a lattice without close calls."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.expr("((s_suppkey*53) % 89)*1.0e0").alias("lat"), F.expr("((s_suppkey*37) % 101)*1.0e0").alias("lng"))
    return boundary.convex_hull(s, "s_nationkey").select("s_nationkey", "lat", "lng")


# ---- clusters ------------------------------------------------------------------------------------------------------

_TOWNS = _points_sql("customer", "c_custkey", lat=town_lat, lng=town_lng)
TOWN_EPS, TOWN_MIN = 1.205, 4


@query(f"""
with recursive p as {_TOWNS},
pairs as (select a.c_custkey as a, b.c_custkey as b from p a join p b on {sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= {TOWN_EPS}e0),
core as (select a from pairs group by a having count(*) >= {TOWN_MIN}),
links as (select a, b from pairs where a in (from core) and b in (from core)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a, min(b) as c from reach group by a),
num as (select c, row_number() over (order by c) - 1 as label from (select distinct c from comp)),
lab as (select a, label from comp join num using (c)),
border as (select pairs.a, min(label) as label from pairs join lab on pairs.b = lab.a where pairs.a not in (from core) group by pairs.a)
select c_custkey, cast(coalesce(lab.label, border.label, -1) as integer) as label
from p left join lab on c_custkey = lab.a left join border on c_custkey = border.a
""")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(table(spark, sf_dir, "customer"), "c_custkey", lat=town_lat, lng=town_lng)
    return clustering.large_dbscan(p, "c_custkey", TOWN_EPS, TOWN_MIN)


def _sql_mean(lat: str = "lat", lng: str = "lng") -> tuple[str, str]:
    x, y, z = f"sum(cos(radians({lat}))*cos(radians({lng})))", f"sum(cos(radians({lat}))*sin(radians({lng})))", f"sum(sin(radians({lat})))"
    return f"degrees(atan2({z}, sqrt({x}*{x} + {y}*{y})))", f"degrees(atan2({y}, {x}))"


def _sql_kmeans(rows: str, k: int, seed: int = clustering.DEFAULT_SEED, rounds: int = clustering.MAX_ROUNDS) -> str:
    """CTEs that end in ``labelled (g, id, lat, lng, c)``: k-means of each group of ``rows (g, id, lat, lng)``.

    Every seed and every round is a CTE of its own; the draws of the generator stand in the text as numbers.
    """
    random = Mulberry32(seed)
    mean = _sql_mean()
    out = [
        f"p as materialized (select *, row_number() over w as r, count(*) over (partition by g) as n from {rows} window w as (partition by g order by id))",
        f"s0 as materialized (select g, 0 as c, lat, lng from p where r = 1 + cast(floor({random.random()!r}e0*n) as bigint))",
        f"d0 as materialized (select p.*, {sql_km('p.lat', 'p.lng', 's0.lat', 's0.lng')} as km from p join s0 on p.g = s0.g)",
    ]
    for i in range(1, k):
        out += [
            f"w{i} as materialized (select *, sum(km*km) over (partition by g order by r) as up, sum(km*km) over (partition by g) as total from d{i - 1})",
            f"s{i} as materialized (select g, {i} as c, coalesce(min_by(lat, r) filter (up >= {random.random()!r}e0*total), max_by(lat, r)) as lat, "
            f"coalesce(min_by(lng, r) filter (up >= {{draw}}e0*total), max_by(lng, r)) as lng from w{i} where km > 0 and total > 0 group by g)",
            f"d{i} as materialized (select d{i - 1}.* exclude (km), least(km, coalesce({sql_km(f'd{i - 1}.lat', f'd{i - 1}.lng', f's{i}.lat', f's{i}.lng')}, km)) as km "
            f"from d{i - 1} left join s{i} on d{i - 1}.g = s{i}.g)",
        ]
        draw = out[-2].split("up >= ")[1].split("e0")[0]
        out[-2] = out[-2].replace("{draw}", draw)
    out.append("c0 as materialized (" + " union all ".join(f"select * from s{i}" for i in range(k)) + ")")
    near = f"select p.g, p.id, p.lat, p.lng, arg_min(c.c, ({sql_km('p.lat', 'p.lng', 'c.lat', 'c.lng')}, c.c)) as c from p join c{{}} c on p.g = c.g group by p.g, p.id, p.lat, p.lng"
    for t in range(1, rounds + 1):
        out.append(
            f"c{t} as materialized (select o.g, o.c, coalesce(m.lat, o.lat) as lat, coalesce(m.lng, o.lng) as lng from c{t - 1} o "
            f"left join (select g, c, {mean[0]} as lat, {mean[1]} as lng from ({near.format(t - 1)}) group by g, c) m on o.g = m.g and o.c = m.c)"
        )
    out.append(f"labelled as (select g, id, lat, lng, dense_rank() over (partition by g order by c) - 1 as c from ({near.format(rounds)}))")
    return ", ".join(out)


@query(f"""
with {_sql_kmeans(f'(select 0 as g, s_suppkey as id, lat, lng from {SUPPLIERS})', 8)} select id as s_suppkey, cast(c as integer) as cluster_id from labelled
""")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, _ = clustering.large_kmeans(suppliers(spark, sf_dir), "s_suppkey", 8)
    return labels


CLUSTER_K, CLUSTER_EPS, CLUSTER_MIN = 3, 2500.0, 2


@query(f"""
with recursive {_sql_kmeans(f'(select s_nationkey as g, s_suppkey as id, lat, lng from {SUPPLIERS})', CLUSTER_K)},
pairs as (select a.g, a.id as a, b.id as b from p a join p b on a.g = b.g and {sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= {CLUSTER_EPS}e0),
core as (select g, a from pairs group by g, a having count(*) >= {CLUSTER_MIN}),
links as (select pairs.* from pairs join core x on pairs.a = x.a join core y on pairs.b = y.a),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a, min(b) as c from reach group by a),
num as (select p.g, p.id, p.lat, p.lng, dense_rank() over (partition by p.g order by comp.c) - 1 as c from p join comp on comp.a = p.id),
lab as (select * from num union all
  select p.g, p.id, p.lat, p.lng, min(num.c) from p join pairs on pairs.a = p.id join num on num.id = pairs.b where p.id not in (select a from comp) group by p.g, p.id, p.lat, p.lng),
every as (select 'kmeans-' || g as request_id, c, lat, lng, cast(null as boolean) as noise from labelled
  union all select 'dbscan-' || g, c, lat, lng, null from lab
  union all select 'dbscan-' || p.g, coalesce(top, -1) + 1, lat, lng, true from p left join (select g, max(c) as top from lab group by g) t on p.g = t.g where p.id not in (select id from lab))
select request_id, cast(c as integer) as id, cast(count(*) as integer) as size, {sql_round(_sql_mean()[0], 6)} as lat, {sql_round(_sql_mean()[1], 6)} as lng, any_value(noise) as noise
from every group by request_id, c
""")
def cluster_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A k-means request and a DBSCAN request for each nation's suppliers."""
    s = suppliers(spark, sf_dir).withColumn("idx", (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("int"))
    both = F.explode(F.array(F.lit("kmeans"), F.lit("dbscan")))
    p = s.withColumn("algorithm", both).withColumn("request_id", F.concat_ws("-", "algorithm", "s_nationkey"))
    options = p.select("request_id", "algorithm").distinct().select(
        "request_id", "algorithm", F.lit(CLUSTER_K).alias("k"), F.lit(CLUSTER_EPS).alias("eps_km"), F.lit(CLUSTER_MIN).alias("min_pts"), F.lit(clustering.DEFAULT_SEED).cast("long").alias("seed")
    )
    found = clustering.clusters(p.select("request_id", "idx", "lat", "lng"), clustering.cluster_requests(p, options))
    return found.select("request_id", "id", "size", F.col("centroid.lat").alias("lat"), F.col("centroid.lng").alias("lng"), "noise")


# ---- routes --------------------------------------------------------------------------------------------------------

_SWEEP = f"""
s as (select s_nationkey as k, s_suppkey as i, lat, lng, row_number() over (partition by s_nationkey order by s_suppkey) as r from {SUPPLIERS}),
base as (select k, lat as blat, lng as blng from s where r = 1),
ang as (select s.k, i, atan2(lat - blat, {sql_norm('lng - blng')}*cos(radians(blat))) as angle from s join base on s.k = base.k where r > 1),
gap as (select *, row_number() over w as n, angle - coalesce(lag(angle) over w, max(angle) over (partition by k) - 2*pi()) as gap from ang
  window w as (partition by k order by angle, i)),
start as (select k, min(n) as first, any_value(c) as c from (select k, n, gap, max(gap) over (partition by k) as widest, count(*) over (partition by k) as c from gap)
  where gap >= widest - 1e-9 group by k),
sweep as (select gap.k as s_nationkey, i as s_suppkey, cast((n - first + c) % c as integer) as seq from gap join start on gap.k = start.k)
"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    return routing.sweep_order(s, "s_nationkey", "s_suppkey", F.col("r") == 1)


@query(f"with {_SWEEP} select s_nationkey, s_suppkey, seq from sweep")
def sweep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation by angle around the first one."""
    return _sweep(spark, sf_dir)


@query(f"""
with {_SWEEP} select s_nationkey, s_suppkey, cast(ntile(3) over (partition by s_nationkey order by seq) - 1 as integer) as vehicle_id from sweep
""")
def assign_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.assign_even(_sweep(spark, sf_dir), "s_nationkey", 3).drop("seq")


#: Requests of at most so many stops, made of the suppliers of a nation in the order of their keys.
TSP_STOPS, VRP_STOPS = 6, 40


def _requests(df: DataFrame, key: str, nation: str, size: int) -> DataFrame:
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(nation).orderBy(key)) - 1)
    return numbered.withColumn("request_id", F.col(nation) * 100000 + F.floor(F.col("_n") / size).cast("int")).withColumn("idx", (F.col("_n") % size).cast("int")).drop("_n")


@query(f"""
with recursive p as (
  select s_nationkey*100000 + cast(floor((r - 1)/{TSP_STOPS}.0e0) as integer) as q, cast((r - 1) % {TSP_STOPS} as integer) as i, lat, lng
  from (select *, row_number() over (partition by s_nationkey order by s_suppkey) as r from {SUPPLIERS})),
n as (select q, count(*) as n from p group by q),
km as (select a.q, a.i, b.i as j, {sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} as km from p a join p b on a.q = b.q),
walk(q, pos, seen, km, steps) as (
  select q, 0, 1, 0.0e0, 1 from n
  union all select w.q, km.j, w.seen | (1 << km.j), w.km + km.km, w.steps + 1 from walk w join km on km.q = w.q and km.i = w.pos and (w.seen & (1 << km.j)) = 0)
select w.q as request_id, cast(n.n as integer) as n_points, {sql_round('min(w.km + km.km)', 3)} as km
from walk w join n on n.q = w.q and n.n = w.steps join km on km.q = w.q and km.i = w.pos and km.j = 0 group by w.q, n.n
""")
def tsp_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest closed tours over requests of a few suppliers."""
    w = _requests(suppliers(spark, sf_dir), "s_suppkey", "s_nationkey", TSP_STOPS)
    counts = w.groupBy("request_id").agg(F.count("*").cast("int").alias("n_points"))
    # a request of one stop is answered with an error, and has no length
    length = routing.optimize_routes(w, _options(w, 1, None)).select("request_id", F.col("distance_km").alias("km"))
    return counts.join(length, "request_id", "left").select("request_id", "n_points", F.coalesce("km", F.lit(0.0)).alias("km"))


def _options(w: DataFrame, vehicles: int, capacity: float | None) -> DataFrame:
    return w.select("request_id").distinct().select(
        "request_id", F.lit(vehicles).alias("vehicle_count"), F.lit(capacity).cast("double").alias("capacity"), F.lit(True).alias("closed"),
        F.lit(0).alias("start_index"), F.lit(40.0).alias("average_speed_kmh"),
    )


def _sql_requests(rows: str, key: str, nation: str, size: int) -> str:
    """What ``_requests`` gives: (q, i, k, lat, lng)."""
    return f"""(select {nation}*100000 + cast(floor((r - 1)/{size}.0e0) as integer) as q, cast((r - 1) % {size} as integer) as i, {key} as k, lat, lng
  from (select *, row_number() over (partition by {nation} order by {key}) as r from {rows}))"""


def _sql_sweep(rows: str) -> str:
    """CTEs that end in ``swept (q, i, k, seq, n)``: the stops of each request but its first, in sweep order."""
    return f"""
s as (select * from {rows}),
ang as (select s.q, s.i, s.k, atan2(s.lat - b.lat, {sql_norm('s.lng - b.lng')}*cos(radians(b.lat))) as angle from s join s b on s.q = b.q and b.i = 0 where s.i > 0),
gap as (select *, row_number() over w as pos, angle - coalesce(lag(angle) over w, max(angle) over (partition by q) - 2*pi()) as gap from ang
  window w as (partition by q order by angle, i)),
start as (select q, min(pos) as first, any_value(n) as n from (select q, pos, gap, max(gap) over (partition by q) as widest, count(*) over (partition by q) as n from gap)
  where gap >= widest - 1e-9 group by q),
swept as (select gap.q, i, k, (pos - first + n) % n as seq, n from gap join start on gap.q = start.q)"""


VEHICLES, CAPACITY = 3, 40.0
NO_ROUTE = "VRP requires at least two waypoints"


def _sql_assigned() -> str:
    """Vehicles by a scan of the sweep: the next stop goes on, to the next vehicle, or waits for the first with room."""
    share = lambda v: f"(n // {VEHICLES} + case when {v} < n % {VEHICLES} then 1 else 0 end)"
    return f"""
with recursive {_sql_sweep(_sql_requests(CUSTOMERS, 'c_custkey', 'c_nationkey', VRP_STOPS))},
stop as (select q, i, seq, n, 1.0e0 + k % 4 as demand from swept),
walk(q, i, seq, n, demand, v, used, load) as (
  select q, i, seq, n, demand, 0, 1, demand from stop where seq = 0
  union all
  select q, i, seq, n, demand, v, case when v = was then used + 1 else 1 end, case when v = was then load + demand else demand end from (
    select x.*, w.used, w.load, w.v as was, case when w.v = {VEHICLES} or (w.used < {share('w.v').replace('(n', '(x.n').replace('< n', '< x.n')} and w.load + x.demand <= {CAPACITY}e0) then w.v
      when w.v + 1 < {VEHICLES} and w.v + 1 < x.n then w.v + 1 else {VEHICLES} end as v
    from walk w join stop x on x.q = w.q and x.seq = w.seq + 1)),
later as (select *, row_number() over (partition by q order by seq) as turn from walk where v = {VEHICLES}),
fill(q, i, turn, demand, loads, v) as (
  select q, cast(null as integer), cast(0 as bigint), 0.0e0, [{', '.join(f'coalesce(sum(demand) filter (v = {v}), 0.0e0)' for v in range(VEHICLES))}], cast(null as integer) from walk group by q
  union all
  select q, i, turn, demand, list_transform(loads, lambda x, j: case when j = coalesce(fit, 0) then x + demand else x end), fit - 1 from (
    select l.q, l.i, l.turn, l.demand, f.loads, list_position(list_transform(f.loads, lambda x: x + l.demand <= {CAPACITY}e0), true) as fit
    from fill f join later l on l.q = f.q and l.turn = f.turn + 1)),
placed as (select q, v, demand from walk where v < {VEHICLES} union all select q, v, demand from fill where v is not null),
total as (select q, v, count(*) as n, sum(demand) as demand, dense_rank() over (partition by q order by v) - 1 as vehicle from placed group by q, v)
select s.q as request_id, cast(t.vehicle as integer) as vehicle_id, cast(t.n + 1 as integer) as n_stops, t.demand,
  cast((select count(*) from s x where x.q = s.q) - 1 - (select sum(n) from total x where x.q = s.q) as integer) as n_unassigned,
  case when t.n is not null then true end as each_once, case when t.n is not null then true end as on_time, case when t.n is not null then true end as not_above_greedy,
  case when t.n is null then '{NO_ROUTE}' end as error
from s left join total t on s.q = t.q where s.i = 0
"""


def _audited(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whether a route's times and length follow from its order, and whether always going to the nearest stop left is no
    better (less late, or as late and shorter), reckoned stop by stop."""
    rows = pdf.sort_values("pos").to_dict("records")

    def km(a: dict, b: dict) -> float:
        side = math.sin(math.radians((b["lng"] - a["lng"] + 180) % 360 - 180) / 2) ** 2 * math.cos(math.radians(a["lat"])) * math.cos(math.radians(b["lat"]))
        return 12742.0 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(b["lat"] - a["lat"]) / 2) ** 2 + side)))

    def followed(order: list[dict]) -> tuple[float, float, list[tuple[float, float]]]:
        clock = length = late = 0.0
        times = []
        for before, at in zip([None, *order], [*order, order[0]]):
            leg = km(before, at) if before else 0.0
            length, clock = length + leg, clock + leg / 40.0 * 60.0
            late += max(0.0, clock - at["due_time_min"]) if before and at["due_time_min"] == at["due_time_min"] else 0.0
            times.append((clock, clock + at["service_time_min"]))
            clock = times[-1][1]
        return late, length, times

    late, length, times = followed(rows)
    right = all(abs(a - r["arrival_min"]) < 0.006 and abs(d - r["departure_min"]) < 0.006 for r, (a, d) in zip(rows, times))
    left, order = sorted(rows[1:], key=lambda r: r["idx"]), [rows[0]]
    while left:
        order.append(min(left, key=lambda r: km(order[-1], r)))
        left.remove(order[-1])
    greedy = followed(order)
    better = late < greedy[0] - 1e-6 or (late <= greedy[0] + 1e-6 and length <= greedy[1] + 1e-6)
    return pd.DataFrame({
        "request_id": [rows[0]["request_id"]], "vehicle_id": [rows[0]["vehicle_id"]], "demand": [sum(r["demand"] for r in rows[1:])],
        "each_once": [len({r["idx"] for r in rows}) == len(rows) and rows[0]["idx"] == 0], "on_time": [right and abs(length - rows[0]["distance_km"]) < 0.0006], "not_above_greedy": [better],
    })


@query(_sql_assigned())
def vrp_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of three vehicles with a capacity and due times, over requests of up to forty customers, audited.

    The stops and the load of each vehicle are SQL's too; that a route serves each of its stops once, that its times and
    length follow from its order, and that it is not above the greedy tour is reckoned again from its stops.
    """
    w = _requests(customers(spark, sf_dir), "c_custkey", "c_nationkey", VRP_STOPS)
    w = w.select(
        "request_id", "idx", "lat", "lng", F.expr("1 + c_custkey % 4").cast("double").alias("demand"),
        F.when(F.col("idx") % 9 == 4, F.lit(60000.0)).alias("due_time_min"), F.lit(10.0).alias("service_time_min"),
    )
    routes = cut_lineage(routing.optimize_routes(w, _options(w, VEHICLES, CAPACITY)))
    visits = routes.select("request_id", "vehicle_id", "distance_km", F.posexplode("stops").alias("pos", "stop"))
    visits = visits.select("request_id", "vehicle_id", "distance_km", "pos", F.col("stop.index").alias("idx"), "stop.arrival_min", "stop.departure_min").join(w, ["request_id", "idx"])
    kind = w.schema["request_id"].dataType.simpleString()
    audit = visits.groupBy("request_id", "vehicle_id").applyInPandas(
        _audited, f"request_id {kind}, vehicle_id int, demand double, each_once boolean, on_time boolean, not_above_greedy boolean"
    )
    shown = routes.select("request_id", "vehicle_id", F.size("stops").alias("n_stops"), F.size("unassigned").alias("n_unassigned"), "error").join(audit, ["request_id", "vehicle_id"], "left")
    return shown.select("request_id", "vehicle_id", F.when(F.col("error").isNull(), F.col("n_stops")).alias("n_stops"), "demand",
                        F.when(F.col("error").isNull(), F.col("n_unassigned")).alias("n_unassigned"), "each_once", "on_time", "not_above_greedy", "error")


def _sql_best(groups: str, measured: str = "") -> str:
    """CTEs that end in ``best (q, v, n, km)``: the shortest closed tour of each group of ``groups`` (q, v, j, lat, lng),
    whose j count from 0, the depot."""
    return f"""
m as (select * from {groups}),
size as (select q, v, count(*) as n from m group by q, v),
leg as (select a.q, a.v, a.j, b.j as to_j, {sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} as km from m a join m b on a.q = b.q and a.v = b.v),
tour(q, v, j, seen, km, n) as (
  select q, v, 0, 1, 0.0e0, 1 from size
  union all select t.q, t.v, leg.to_j, t.seen | (1 << leg.to_j), t.km + leg.km, t.n + 1 from tour t join leg on leg.q = t.q and leg.v = t.v and leg.j = t.j and (t.seen & (1 << leg.to_j)) = 0),
best as (select t.q, t.v, size.n, min(t.km + leg.km) as km from tour t join size on size.q = t.q and size.v = t.v and size.n = t.n
  join leg on leg.q = t.q and leg.v = t.v and leg.j = t.j and leg.to_j = 0 group by t.q, t.v, size.n)"""


#: Requests of so many stops leave each of two vehicles few enough for the exact search, which SQL can follow.
SUMMARY_STOPS = 12


@query(f"""
with recursive {_sql_sweep(_sql_requests(SUPPLIERS, 's_suppkey', 's_nationkey', SUMMARY_STOPS))},
half as (select q, i, seq, ntile(2) over (partition by q order by seq) as v from swept),
{_sql_best("(select half.q, half.v, cast(row_number() over (partition by half.q, half.v order by seq) as integer) as j, lat, lng from half join s on s.q = half.q and s.i = half.i"
           " union all select distinct half.q, half.v, 0, lat, lng from half join s on s.q = half.q and s.i = 0)")}
select s.q as request_id, count(best.v) > 0 as feasible, {sql_round('coalesce(sum(' + sql_round('best.km', 3) + '), 0)', 3)} as km,
  {sql_round('coalesce(sum(' + sql_round('best.km/40.0e0*60', 2) + '), 0)', 2)} as minutes, count(best.v) as n_routes
from s left join best on best.q = s.q where s.i = 0 group by s.q
""")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two vehicles each; a request of one stop has no routes and is not feasible."""
    w = _requests(suppliers(spark, sf_dir), "s_suppkey", "s_nationkey", SUMMARY_STOPS).select("request_id", "idx", "lat", "lng")
    found = routing.route_summary(routing.optimize_routes(w, _options(w, 2, None)))
    return found.select("request_id", "feasible", round_km("total_distance_km").alias("km"), round_min("total_duration_min").alias("minutes"), "n_routes")


_WINDOW = {
    "ready_time_min": "case when s_suppkey % 3 = 0 then ((s_suppkey*11) % 400)*10.0e0 end",
    "due_time_min": "case when s_suppkey % 2 = 0 then 4000.0e0 + ((s_suppkey*13) % 300)*60.0e0 end",
    "service_time_min": "(s_suppkey % 5)*2.5e0",
}


@query(f"""
with recursive s as (select q, i, lat, lng, {', '.join(f'{x.replace("s_suppkey", "k")} as {c}' for c, x in _WINDOW.items())} from {_sql_requests(SUPPLIERS, 's_suppkey', 's_nationkey', TSP_STOPS)}),
n as (select q, count(*) as n from s group by q),
leg as (select a.q, a.i, b.i as j, {sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} as km from s a join s b on a.q = b.q),
walk(q, pos, seen, n, km, clock, late, lates) as (
  select q, 0, 1, 1, 0.0e0, coalesce(ready_time_min, 0.0e0) + service_time_min, 0.0e0, 0 from s where i = 0
  union all
  select q, j, seen | (1 << j), n + 1, km, greatest(arrived, coalesce(ready_time_min, 0.0e0)) + service_time_min, late + greatest(0.0e0, arrived - coalesce(due_time_min, arrived)),
    lates + case when arrived > due_time_min then 1 else 0 end from (
    select w.q, leg.j, w.seen, w.n, w.km + leg.km as km, w.clock + leg.km/40.0e0*60 as arrived, w.late, w.lates, x.ready_time_min, x.due_time_min, x.service_time_min
    from walk w join leg on leg.q = w.q and leg.i = w.pos and (w.seen & (1 << leg.j)) = 0 join s x on x.q = w.q and x.i = leg.j)),
back as (select w.q, w.n, w.km + leg.km as km, w.late + greatest(0.0e0, w.clock + leg.km/40.0e0*60 - coalesce(d.due_time_min, w.clock + leg.km/40.0e0*60)) as late,
  w.lates + case when w.clock + leg.km/40.0e0*60 > d.due_time_min then 1 else 0 end as lates
  from walk w join n on n.q = w.q and n.n = w.n join leg on leg.q = w.q and leg.i = w.pos and leg.j = 0 join s d on d.q = w.q and d.i = 0 where w.n > 1),
least as (select *, min(late) over (partition by q) as least_late from back),
best as (select q, arg_min(km, km) as km, arg_min(late, km) as late, arg_min(lates, km) as lates from least where late <= least_late + 1e-9 group by q)
select n.q as request_id, cast(n.n as integer) as n_points, {sql_round('km', 3)} as km, cast(lates as integer) as n_violations, {sql_round('late', 0)} as late_min
from n left join best on best.q = n.q
""")
def vrp_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least late, then shortest, closed route of one vehicle over a few suppliers with time windows."""
    w = _requests(suppliers(spark, sf_dir).withColumns({c: F.expr(x) for c, x in _WINDOW.items()}), "s_suppkey", "s_nationkey", TSP_STOPS)
    counts = w.groupBy("request_id").agg(F.count("*").cast("int").alias("n_points"))
    routes = routing.optimize_routes(w, _options(w, 1, None)).where("error is null")
    late = F.aggregate("violations", F.lit(0.0), lambda total, x: total + x["late_min"])
    found = routes.select("request_id", F.col("distance_km").alias("km"), F.size("violations").alias("n_violations"), round_half_up(late, 0).alias("late_min"))
    return counts.join(found, "request_id", "left")


_VISITS = """select s_nationkey, cast(row_number() over (partition by s_nationkey order by s_suppkey) - 1 as integer) as seq,
  ((s_suppkey*7) % 50)*1.5e0 as leg_min, case when s_suppkey % 3 = 0 then ((s_suppkey*11) % 400)*1.0e0 end as ready_min,
  case when s_suppkey % 2 = 0 then ((s_suppkey*13) % 300)*1.0e0 end as due_min, (s_suppkey % 5)*2.5e0 as service_min from supplier"""


@query(f"""
with recursive v as ({_VISITS}),
t(s_nationkey, seq, arrival_min, wait_min, departure_min, late_min) as (
  select s_nationkey, seq, 0.0e0, greatest(0.0e0, coalesce(ready_min, 0.0e0)), greatest(0.0e0, coalesce(ready_min, 0.0e0)) + service_min, 0.0e0 from v where seq = 0
  union all
  select v.s_nationkey, v.seq, departure_min + leg_min, greatest(0.0e0, coalesce(ready_min, 0.0e0) - (departure_min + leg_min)),
    greatest(departure_min + leg_min, coalesce(ready_min, 0.0e0)) + service_min, greatest(0.0e0, departure_min + leg_min - coalesce(due_min, departure_min + leg_min))
  from t join v on v.s_nationkey = t.s_nationkey and v.seq = t.seq + 1)
select s_nationkey, seq, {', '.join(f'{sql_round(c, 2)} as {c}' for c in ('arrival_min', 'wait_min', 'departure_min', 'late_min'))} from t
""")
def vrp_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals, waits and departures along the suppliers of each nation in the order of their keys."""
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_supplier_visits")
    visits = spark.sql(_VISITS.replace("from supplier", "from _supplier_visits"))
    found = routing.schedule_orders(visits, "s_nationkey")
    return found.select("s_nationkey", "seq", *(round_min(c).alias(c) for c in ("arrival_min", "wait_min", "departure_min", "late_min")))


@query(f"""
select s_nationkey, {sql_round('sum(' + sql_km('lat', 'lng', 'to_lat', 'to_lng') + ')', 3)} as km from (
  select s_nationkey, lat, lng, coalesce(lead(lat) over w, first_value(lat) over w) as to_lat, coalesce(lead(lng) over w, first_value(lng) over w) as to_lng
  from {SUPPLIERS} window w as (partition by s_nationkey order by s_suppkey))
group by s_nationkey
""")
def path_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the closed path over the suppliers of each nation in the order of their keys."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    legs = suppliers(spark, sf_dir).select(
        "s_nationkey", "lat", "lng", *(F.coalesce(F.lead(c).over(w), F.first(c).over(w)).alias(f"next_{c}") for c in ("lat", "lng"))
    )
    return legs.groupBy("s_nationkey").agg(round_km(F.sum(haversine_km("lat", "lng", "next_lat", "next_lng"))).alias("km"))


# ---- lines and GeoJSON ---------------------------------------------------------------------------------------------

TOLERANCE_KM = 2000.5


def _sql_kept() -> str:
    """CTEs that end in ``kept (user_id, i)``: the numbers of the events that simplification keeps of each user's line.

    A stretch is split at its farthest event as long as that lies beyond the tolerance.
    """
    return f"""p as (select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as i, lat, lng
  from {_points_sql('events', 'event_id', 'user_id', 'ts')}),
d as materialized (select a.user_id, a.i, b.i as j, {sql_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} as km from p a join p b on a.user_id = b.user_id),
r(user_id, a, b) as (
  select user_id, 0, max(i) from p group by user_id
  union all
  select user_id, unnest([a, far.m]), unnest([far.m, b]) from (
    select user_id, a, b, min({{'km': -km, 'm': m}}) as far from (
      select r.user_id, r.a, r.b, x.j as m, (s.km + x.km + y.km)/2 as h,
        case when s.km = 0 then x.km else 2*sqrt(greatest(0.0e0, h*(h - s.km)*(h - x.km)*(h - y.km)))/s.km end as km
      from r join d s on s.user_id = r.user_id and s.i = r.a and s.j = r.b join d x on x.user_id = r.user_id and x.i = r.a and x.j > r.a and x.j < r.b
        join d y on y.user_id = r.user_id and y.i = r.b and y.j = x.j)
    group by user_id, a, b) where -far.km > {TOLERANCE_KM}e0),
kept as (select user_id, a as i from r union select user_id, b from r)"""


@query(f"with recursive {_sql_kept()} select p.user_id, event_id from kept join p on p.user_id = kept.user_id and p.i = kept.i")
def simplify_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the simplification of their user's whole line keeps."""

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        return pdf.iloc[kept_by_simplification(pdf["lat"].to_numpy(), pdf["lng"].to_numpy(), TOLERANCE_KM)][["user_id", "event_id"]]

    return _event_lines(spark, sf_dir).groupBy("user_id").applyInPandas(kept, "user_id long, event_id long")


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(table(spark, sf_dir, "events"), "event_id", "user_id", "ts")
    return p.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)


_LINES = """'{"type":"' || case when c_custkey % 7 = 0 then 'Curve' else 'LineString' end || '","coordinates":[[0,' || cast(c_custkey % 120 as varchar(20)) || '],['
 || case when c_custkey % 11 = 0 then '"x"' else '10' end || ',1]]}'"""


@query("""
select c_custkey, c_custkey % 7 <> 0 and c_custkey % 120 <= 90 and c_custkey % 11 <> 0 as valid,
  cast(case when c_custkey % 7 = 0 then 1 else case when c_custkey % 120 > 90 then 1 else 0 end + case when c_custkey % 11 = 0 then 1 else 0 end end as integer) as n_errors
from customer
""")
def geojson_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, some with a wrong type, a latitude out of range or a text for a number."""
    checked = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_LINES).alias("g")).select("c_custkey", validate_column("g").alias("v"))
    return checked.select("c_custkey", "v.valid", F.size("v.errors").alias("n_errors"))


@query(f"""
with recursive {_sql_kept()}
select p.user_id, cast(0 as bigint) as line, '{{"type":"LineString","coordinates":['
  || string_agg('[' || cast(lng as varchar) || ',' || cast(lat as varchar) || ']', ',' order by p.i) || ']}}' as geojson, cast(null as varchar) as error
from kept join p on p.user_id = kept.user_id and p.i = kept.i group by p.user_id
""")
def geojson_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a user as one line of GeoJSON text (number 0), simplified whole."""
    listed = _event_lines(spark, sf_dir).groupBy("user_id", F.lit(0).cast("long").alias("line")).agg(F.array_sort(F.collect_list(F.struct("r", "lng", "lat"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["lng"].cast("string"), F.lit(","), x["lat"].cast("string"), F.lit("]"))), ",")
    lines = listed.select("user_id", "line", F.concat(F.lit('{"type":"LineString","coordinates":['), body, F.lit("]}")).alias("geojson"))
    return lines.select("user_id", "line", simplify_column("geojson", TOLERANCE_KM).alias("s")).select("user_id", "line", "s.geojson", "s.error")


_NORTH = "cast(case when c_custkey % 3 = 0 then 91 + c_custkey % 5 else 1 end as varchar(9))"
_FEATURE = f"""'{{"type":"Feature","geometry":{{"type":"GeometryCollection","geometries":[{{"type":"Polygon","coordinates":[[[0,' || {_NORTH} || '],[1,0],[1,1]'
 || case when c_custkey % 7 = 0 then '' else ',[' || case when c_custkey % 4 = 0 then '2' else '0' end || ',' || {_NORTH} || ']' end
 || ']]}}]}},"properties":' || case when c_custkey % 5 = 0 then '7' else 'null' end || '}}'"""
_RING = "feature.geometry.geometries[0].coordinates[0]"


@query(f"""
select c_custkey, concat_ws('; ',
  case when c_custkey % 3 = 0 then '{_RING}[0]: latitude ' || {_NORTH} || ' is outside -90..90' end,
  case when c_custkey % 3 = 0 and c_custkey % 7 <> 0 then '{_RING}[3]: latitude ' || {_NORTH} || ' is outside -90..90' end,
  case when c_custkey % 7 = 0 then '{_RING}: must contain at least 4 positions' end,
  case when c_custkey % 7 <> 0 and c_custkey % 4 = 0 then '{_RING}: linear ring must be closed (first and last positions equal)' end,
  case when c_custkey % 5 = 0 then 'feature.properties: must be an object or null' end) as messages
from customer
""")
def geojson_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with features that hold a polygon in a collection: positions, rings and properties."""
    checked = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_FEATURE.replace("varchar(9)", "string")).alias("g"))
    return checked.select("c_custkey", F.array_join(validate_column("g")["errors"], "; ").alias("messages"))


@query("select s_nationkey, cast(count(*) as integer) as n_features from supplier group by s_nationkey")
def feature_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation as a feature collection, counted in the text."""
    listed = suppliers(spark, sf_dir).groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("id"), "lat", "lng"))).alias("p"))
    return listed.select("s_nationkey", feature_collection_column("p").alias("g")).select("s_nationkey", F.json_array_length(F.get_json_object("g", "$.features")).alias("n_features"))


# ---- lookups and requests ------------------------------------------------------------------------------------------


@query(f"select n_name, lat, lng from {_points_sql('nation', 'n_nationkey', 'n_name')}")
def geocode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names, written differently, looked up in a table of places."""
    n = table(spark, sf_dir, "nation")
    places = points(n, "n_nationkey", "n_name").select(F.col("n_name").alias("address"), "lat", "lng")
    asked = n.select("n_name", F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("address"))
    return gazetteer_lookup(asked, places).select("n_name", "lat", "lng")


@query(f"select s_suppkey, {sql_round(sql_km('0.0e0', '0.0e0', 'lat', 'lng'), 3)} as km from {SUPPLIERS}")
def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distance request in JSON for each supplier."""
    to = F.to_json(F.struct(F.array(F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"))).alias("origins"), F.array(F.struct("lat", "lng")).alias("destinations")))
    asked = suppliers(spark, sf_dir).select("s_suppkey", F.lit("distance_matrix").alias("operation"), to.alias("payload"))
    found = answer_requests(asked, id_col="s_suppkey")
    return found.select("s_suppkey", F.get_json_object("result", "$.distancesKm[0][0]").cast("double").alias("km"))


#: A request of each other operation for a supplier's point: its payload, and where in the result its number stands.
_PAIR = """'[{"lat":0,"lng":0},{"lat":' || lat || ',"lng":' || lng || '}]'"""
_ASKED = {
    "optimize_route": (f"""'{{"closed":false,"waypoints":' || {_PAIR} || '}}'""", "$.totalDistanceKm"),
    "cluster_points": (f"""'{{"algorithm":"kmeans","k":1,"points":' || {_PAIR} || '}}'""", "$[0].centroid.lat"),
    "boundary_check": (f"""'{{"operation":"bounding_box","points":' || {_PAIR} || '}}'""", "$.bbox.minLat"),
    "geojson_utils": (f"""'{{"operation":"to_feature_collection","points":' || {_PAIR} || '}}'""", "$.features[1].geometry.coordinates[1]"),
    "geocode": ("""'{"lat":' || lat || ',"lng":' || lng || '}'""", "$.none"),
}


def _sql_answers() -> str:
    middle = _sql_mean()[0]
    numbers = {
        "optimize_route": sql_round(sql_km("0.0e0", "0.0e0", "lat", "lng"), 3),
        "cluster_points": sql_round(f"(select {middle} from (values (0.0e0, 0.0e0), (p.lat, p.lng)) as two(lat, lng))", 6),
        "boundary_check": "least(0.0e0, lat)", "geojson_utils": "lat", "geocode": "cast(null as double)",
    }
    code = lambda name: "'GeocodingFailed'" if name == "geocode" else "cast(null as varchar)"
    return " union all ".join(f"select s_suppkey, '{name}' as operation, {x} as number, {code(name)} as error_code from {SUPPLIERS} p" for name, x in numbers.items())


@query(_sql_answers())
def json_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request in JSON of each of the other operations for each supplier; no geocoding service is set up."""
    p = suppliers(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("lat", "lng")})
    asked = [p.select("s_suppkey", F.lit(name).alias("operation"), F.expr(payload).alias("payload")) for name, (payload, _) in _ASKED.items()]
    rows = asked[0]
    for other in asked[1:]:
        rows = rows.unionByName(other)
    found = answer_requests(rows.withColumn("id", F.concat_ws("/", "s_suppkey", "operation")), id_col="id")
    number = F.coalesce(*(F.when(F.col("operation") == name, F.get_json_object("result", path)) for name, (_, path) in _ASKED.items())).cast("double")
    return found.select(F.substring_index("id", "/", 1).cast("long").alias("s_suppkey"), "operation", number.alias("number"), F.get_json_object("error", "$.code").alias("error_code"))
