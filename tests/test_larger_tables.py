"""Queries whose rows only differ from their SQL, or only grow out of bounds, on tables larger than those at hand."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import DATA
from tests.test_catalog import rows
from waymark.functions.geo import np_distance_matrix, np_haversine_km
from waymark.operators import clustering, proximity, routing
from waymark.plans import catalog
from waymark.session import cut_lineage


def against_sql(spark, folder, name: str, table: str, sql: str) -> None:
    """``name`` on a folder with one table of the rows of ``sql``."""
    con = duckdb.connect()
    con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = catalog.QUERIES[name](spark, str(folder)).toPandas()
    assert rows(found) == rows(con.execute(catalog.ORACLE_SQL[name]).fetchdf())


#: A supplier and two in line with it, whose angles differ in the last bit.
IN_LINE = [(60, 785, 2235), (1, 1057, 1321), (39, 557, 1075)]


@pytest.mark.parametrize("name", ["sweep_order", "assign_vehicles"])
def test_stops_in_line_with_the_depot(spark, tmp_path, name):
    keys = ", ".join(f"({k}, {nation})" for nation, line in enumerate(IN_LINE) for k in line)
    against_sql(spark, tmp_path, name, "supplier", f"select k::bigint as s_suppkey, n::bigint as s_nationkey from (values {keys}) t(k, n)")


#: Keys of customers that one vehicle serves, the depot first, and their places in the request.
LATE = [76270, 77278, 77190, 76477, 77215, 76863, 76282, 76359, 77052, 76284, 77055, 76924, 76966, 76571]
PLACES = [0, 39, 36, 8, 38, 22, 1, 5, 31, 2, 32, 25, 28, 9]


def test_route_is_not_above_the_greedy_tour():
    """Stops at which the shortest tour found is late, and the repaired one as late as the greedy tour but longer."""
    keys = np.array(LATE)
    lat, lng = (keys * 7919 % 17001) / 100.0 - 85.0, (keys * 104729 % 36001) / 100.0 - 180.0
    none, place = np.full(len(keys), np.nan), np.array(PLACES)
    stops = routing.Stops(lat, lng, 1.0 + keys % 4, none, np.where(place % 9 == 4, 60000.0, np.nan), np.full(len(keys), 10.0))
    km = np_distance_matrix(lat, lng)
    costs = routing.Costs(km, km / 40.0 * 60.0, True)
    found = routing.solve_route(list(range(len(keys))), stops, costs)
    greedy = routing.schedule(routing._greedy(len(keys), 0, km).tolist(), stops, costs)
    late = lambda route: sum(v["late_min"] for v in route["violations"])
    assert late(found) < late(greedy) - 1e-9 or (late(found) <= late(greedy) + 1e-9 and found["distance_km"] <= greedy["distance_km"] + 1e-9)
    assert sorted(v["index"] for v in found["stops"]) == list(range(len(keys)))


def test_dbscan_does_not_list_the_pairs_of_a_crowd(spark, monkeypatch):
    """Two crowds a little more than the radius apart, a bridge of single points, and a stray: 2 x 400 x 399 pairs."""
    rng = np.random.default_rng(5)
    lat = np.concatenate((rng.uniform(0, 0.004, 400), rng.uniform(0.02, 0.024, 400), [0.009, 0.012, 0.015, 1.0]))
    lng = np.concatenate(((rng.uniform(0, 0.004, 800) + 359.998) % 360, [0.0, 0.0, 0.0, 1.0]))
    listed = []
    monkeypatch.setattr(clustering, "cut_lineage", lambda df: listed.append(df.count()) or cut_lineage(df))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lng))] + [(900, None, 0.0)], "k int, lat double, lng double")
    for eps in (0.7, 0.4):
        found = [r.label for r in clustering.large_dbscan(df, "k", eps, 4).orderBy("k").collect()]
        assert found == [*clustering.dbscan_labels(lat, lng, eps, 4).tolist(), -1]
    assert max(listed) < 2000


def test_request_matrices_of_a_large_nation(spark, tmp_path, monkeypatch):
    """No request holds the whole matrix of a nation of 700 suppliers."""
    sides = []
    plain = catalog.proximity.request_matrices

    def seen(requests, **options):
        sides.append(requests.selectExpr("max(size(origins) * size(destinations)) as n").first()["n"])
        return plain(requests, **options)

    monkeypatch.setattr(catalog.proximity, "request_matrices", seen)
    against_sql(spark, tmp_path, "request_matrices", "supplier", "select i::bigint as s_suppkey, (i // 700)::bigint as s_nationkey from range(703) r(i)")
    assert sides[0] < 2 * catalog.MATRIX_SIDE**2


#: Bytecodes of a method from which on the JVM leaves it to its interpreter.
HUGE_METHOD = 8000


def generated_methods(spark, name: str, folder: str) -> list[tuple[str, int]]:
    """Each generated stage of ``name``, and the size of its largest method."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        parts = re.split(r"== Subtree \d+ / \d+ \(maxMethodCodeSize:", debug.codegenString(plan))[1:]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [(x.split("Generated code:")[0], int(x.split(";")[0])) for x in parts]


@pytest.mark.parametrize("name", ["range_join", "region_query"])
def test_pairs_are_compiled(spark, name):
    stages = generated_methods(spark, name, DATA)
    assert any("Join" in tree for tree, _ in stages) and max(size for _, size in stages) <= HUGE_METHOD


def test_range_join_of_one_small_file_is_many_tasks(spark):
    assert catalog.QUERIES["range_join"](spark, DATA).rdd.getNumPartitions() > 1


def test_region_query_of_equal_points(spark, tmp_path):
    """Four hundred places with three customers each, against SQL."""
    keys = "select (i * 36001 * 17001 + j * 17)::bigint as c_custkey, 0::bigint as c_nationkey from range(3) a(i), range(400) b(j)"
    against_sql(spark, tmp_path, "region_query", "customer", keys)


def test_files_of_a_wide_matrix_do_not_repeat_the_keys(spark, tmp_path):
    """20,000 destinations of one file: every pair is there, and a destination's key takes less than a byte a row."""
    o = spark.range(40).selectExpr("id as k", "id * 2.0 as lat", "id * 7.0 as lng")
    d = spark.range(0, 20_000, 1, 1).selectExpr("id as c", "if(id = 7, null, id % 171 - 85.0D) as lat", "id % 361 - 180.0D as lng")
    # else Spark broadcasts the 40 origins, which a table of many is too large for
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        proximity.distance_matrix(o, d, max_cells=None).write.parquet(f"{tmp_path}/matrix")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    groups = [m.row_group(i) for f in (tmp_path / "matrix").glob("*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    keys = [g.column(i) for g in groups for i in range(g.num_columns) if g.column(i).path_in_schema == "c"]
    assert sum(x.total_compressed_size for x in keys) < sum(x.num_values for x in keys) == 800_000
    found = pq.read_table(tmp_path / "matrix").to_pandas().sort_values(["k", "c"])
    k, c = np.repeat(np.arange(40), 20_000), np.tile(np.arange(20_000), 40)
    assert (found.k.to_numpy() == k).all() and (found.c.to_numpy() == c).all()
    km = np.where(c == 7, np.nan, np_haversine_km(k * 2.0, k * 7.0, c % 171 - 85.0, c % 361 - 180.0))
    np.testing.assert_allclose(found.km, km, atol=0.00051)
    np.testing.assert_allclose(found.duration_min, km / 40 * 60, atol=0.0051)
