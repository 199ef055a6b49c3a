"""Registered queries of the subpackage against their SQL twins on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from polyglint.llm import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows(names, found):
    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL.keys() & registry.QUERIES.keys()))
def test_query_equals_sql(spark, sql, name):
    found = entry.queries()[name](spark, FOLDER)
    table = sql.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(found.columns) == sorted(table.column_names)
    names = sorted(found.columns)
    assert rows(names, (r.asDict() for r in found.collect())) == rows(names, table.to_pylist())

