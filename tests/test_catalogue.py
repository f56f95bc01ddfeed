"""Every registered query outside the llm subpackage against its oracle in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from examloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = ordered(df.select(sorted(df.columns)).collect())
    oracle = catalogue.oracle_sql().get(name)
    if oracle is None:
        assert got
        return
    columns = sorted(duck.sql(oracle).columns)
    assert sorted(df.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert got == ordered(duck.sql(f"select {listed} from ({oracle})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
