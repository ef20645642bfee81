"""Queries against their SQL, and what is registered."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.llm.queries import ORACLES, QUERIES


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sum(q.startswith("op") for q in QUERIES) == 13 and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    wanted = con.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(wanted.select(*columns).fetchall())
