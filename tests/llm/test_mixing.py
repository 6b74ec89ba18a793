from __future__ import annotations

from fractions import Fraction

import duckdb
import pytest

from tests.llm.helpers import clashing, corpus
from waymark.llm import mixing


def slots(rows):
    """First row of each block, by slot."""
    blocks = {(r.source, r.mix.block): r.mix for r in rows}
    return sorted((m.slot, s, m) for (s, _), m in blocks.items())


def worst_lag(order, weights):
    """Greatest deviation from the fluid schedule until a source runs out."""
    total = sum(weights.values())
    last = {s: max(t for t, x, _ in order if x == s) for s in weights}
    sent, worst = dict.fromkeys(weights, 0), Fraction(0)
    for t, s, _ in order:
        if t > min(last.values()):
            break
        sent[s] += 1
        worst = max(worst, *(abs(Fraction(weights[x] * (t + 1), total) - sent[x]) for x in weights))
    return worst


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 2, "c": 3}, {"a": 97, "b": 2, "c": 1}, {"a": 7, "b": 11, "c": 13, "d": 17}])
def test_less_than_one_block_of_deviation(spark, weights):
    df = spark.createDataFrame([(i, s) for k, s in enumerate(weights) for i in range(k * 10_000, k * 10_000 + 260 + 40 * k)], "doc_id long, source string")
    rows = mixing.mix(df, weights, block_rows=4).collect()
    order = slots(rows)
    assert len({t for t, _, _ in order}) == len(order) and worst_lag(order, weights) < 1
    assert all(m.release <= m.slot < m.deadline for _, _, m in order)
    places = sorted((r.source, r.mix.block, r.mix.place) for r in rows)
    assert places == sorted((s, i // 4, i % 4) for k, s in enumerate(weights) for i in range(260 + 40 * k))


def test_against_sql(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}" if i % 2 else "hot") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted((tuple(r) for r in mixing.mix(df).select("doc_id", "source", "mix.*").collect()), key=repr)
    con = duckdb.connect()
    pdf = df.toPandas()
    con.register("documents", pdf)
    want = con.execute(mixing.oracle()).fetchall()
    assert got == sorted(want, key=repr)


def test_order_is_durable(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 4 == 0]) for i in range(500)], "doc_id long, source string")
    mixed = mixing.mix(df)
    by_rank = [r.doc_id for r in mixed.orderBy("mix.slot", "mix.place").collect()]
    mixing.in_order(mixed).write.parquet(str(tmp_path / "m"))
    files = sorted((tmp_path / "m").glob("part-*"))
    assert [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == by_rank


def test_odd_tables(spark):
    docs = clashing(spark, corpus(2, 30))
    mixed = mixing.mix(docs)
    assert sorted(map(repr, mixed.drop("mix").collect())) == sorted(map(repr, docs.drop("mix").collect()))
    assert mixing.mix(docs.limit(0)).collect() == []
    one = mixing.mix(spark.createDataFrame([(1, None), (1, None)], "doc_id long, source string")).collect()
    assert sorted((r.mix.slot, r.mix.place) for r in one) == [(0, 0), (0, 1)]
    assert len(mixing.mix(docs, {None: 3, "s1": 2, "unused": 9}).collect()) == docs.count()
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s1": 0})
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s1": mixing.MAX_SLOTS, "s2": 1})


def test_number_of_sources_is_checked(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    df = spark.createDataFrame([(i, str(i)) for i in range(5)], "doc_id long, source string")
    with pytest.raises(Exception, match="more than 3 sources"):
        mixing.mix(df).collect()


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a")], "doc_id long, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
