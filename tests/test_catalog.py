"""Every registered query of the library itself, against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tests.conftest import DATA
from waymark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(map(repr, pdf[columns].astype(object).where(pdf[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_query_against_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    assert rows(found) == rows(duck.execute(catalog.ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1500
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
