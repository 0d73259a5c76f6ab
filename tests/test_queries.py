"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomtrace import imported, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "orders", "conversations"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    out = [tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", [*queries.queries(), *imported.queries()])
def test_equals_sql(spark, duck, name):
    module = imported if name in imported.queries() else queries
    got, want = module.queries()[name](spark, SF).toPandas(), duck.sql(module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from loomtrace.bindings import bound
    from loomtrace.engine import Engine

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    web = Engine(bound(spark, SF, "web"))
    p = plan(web.query("select e:name where e:total > 50 and e:timestamp >= '2024-01-10T00:00:00Z' and e:name in ('click', 'view')"))
    assert "GreaterThan(value,50.0)" in p and "GreaterThanOrEqual(ts," in p and "In(event_type, [click,view])" in p
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in p
    assert "Exchange" not in p and "Join" not in p
    flat = plan(web.query("select t:name, count(e:name) group by t:name order by count(e:name) limit 9"))
    assert flat.count("hashpartitioning") == 1 and "SortAggregate" not in flat and "TakeOrderedAndProject" in flat
    assert plan(web.query("select sum(e:total) group by ^e:name")).count("hashpartitioning") == 2
    assert "TakeOrderedAndProject" in plan(web.query("select e:name order by e:total desc limit 5"))
    one = plan(web.query("select e:name where t:name = '8|2024-01-01' limit 100"))
    assert "EqualTo(user_id,8)" in one
    traces = plan(web.query("select t:name, t:day where t:user < 9 and t:name like '%02%'"))
    assert "LessThan(user_id,9)" in traces and traces.count("hashpartitioning") == 1
    assert web.query("select e:name where t:name = 'it\\'s|x\\\\'").count() == 0
