"""Every query of the catalogue against its SQL, on the tables of the correctness run."""

from __future__ import annotations

import os

import duckdb
import pytest

from cardloom import catalogue

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, tables, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    wanted = tables.sql(catalogue.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    got = sorted(tuple(map(repr, r)) for r in frame.select(*columns).collect())
    want = sorted(tuple(map(repr, r)) for r in wanted.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got and got == want


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
