"""Every registered query against its SQL in DuckDB, on the smallest tables. Names, types that hash alike and values must agree."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tessera.queries import load

QUERIES, SQL = load()


#: Queries whose answer on the smallest tables is empty, which says nothing: these are asked of the next larger ones.
LARGER, LARGER_DIR = ("key_or_hash_lookup", "repeat_cohorts", "version_chain"), "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf_dir):
    def over(tables):
        con = duckdb.connect()
        for name in os.listdir(tables):
            path = f"{tables}/{name}"
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
        return con

    return {tables: over(tables) for tables in (sf_dir, LARGER_DIR)}


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    tables = LARGER_DIR if name in LARGER else sf_dir
    df = QUERIES[name](spark, tables)
    found = [r.asDict() for r in df.collect()]
    assert found  # equal to nothing says nothing
    if name not in SQL:
        return
    result = duck[tables].execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    wanted = [[plain(v) for _, v in sorted(zip(columns, row, strict=True))] for row in result.fetchall()]
    assert sorted(([plain(r[c]) for c in order] for r in found), key=str) == sorted(wanted, key=str)


def test_queries_read_no_more_than_they_need(spark, sf_dir):
    """Filters reach the scan, and unneeded columns do not leave it."""
    plan = QUERIES["tenant_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "text" not in plan.split("ReadSchema")[1]
    top = QUERIES["recent_pool"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
