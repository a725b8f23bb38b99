"""Every query of the engine against its SQL on the same tables."""

import math

import duckdb
import pytest

from lattica.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 4) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=str)
    result = con.execute(catalog.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == names
    theirs = sorted((tuple(plain(r[order.index(c)]) for c in names) for r in result.fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).limit(5).collect()


def test_flagship_pushes_its_filter(spark):
    df = catalog.flagship(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    assert "l_orderkey" not in plan
    assert df.count() > 0
