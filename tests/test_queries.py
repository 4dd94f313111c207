"""Every registered query against its SQL in DuckDB, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm
from galeframe.plans import all_queries

# the library's own queries; those of the corpus operators have their tests in tests/llm
QUERIES, ORACLES = all_queries().QUERIES, all_queries().ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(norm(v) for v in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n[0] in "pafjgw"])
def test_no_cross_join_and_no_python_rows(spark, sf_dir, name):
    if name.startswith(("s", "t")):
        pytest.skip("writes")
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name != "g5_smooth_box":
        assert "InPandas" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["f3_clip_years"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"basin", "threshold", "count", "days"} <= set(df.columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
