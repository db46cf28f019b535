"""Every image query against its SQL on the small tables."""

import math

import duckdb
import pytest

from pixelmill.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = ("embeddings", "pages", "documents", "lineitem", "part")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple("~" if v is None else repr(v) for v in r))


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    names = sorted(df.columns)
    result = duck.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(n) for n in names]
    want = ordered(tuple(r[i] for i in at) for r in result.fetchall())
    assert ordered(tuple(r[n] for n in names) for r in df.collect()) == want and want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_finite_rows(spark, name):
    rows = catalog.queries()[name](spark, DIR).collect()
    assert rows and all(v is None or math.isfinite(v) for r in rows for v in r)


def test_plans_push_down_and_stay_out_of_python(spark):
    plan = lambda n: catalog.queries()[n](spark, DIR)._jdf.queryExecution().toString()
    assert "Exchange" not in plan("gaussian_blur").split("Physical Plan")[1] and "Python" not in plan("apc_response")
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan("otsu_lineitem")


def test_features_are_of_real_regions(spark):
    rows = catalog.queries()["pipeline_features"](spark, DIR)
    for name in rows.columns:
        assert rows.where(f"{name} is not null").count() > 100, name
