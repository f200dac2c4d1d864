"""Every registered query of the reference's operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from scoutline.plans import PLANS, proxies, score_queries

QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in PLANS for name, sql in plan.SQL.items()}


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.sql("SET threads = 2")
    for t in proxies.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x if x is None or isinstance(x, (int, bool)) else str(x)


def rows(values):
    return sorted((tuple(map(plain, r)) for r in values), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    right = duck.sql(SQL[name])
    assert sorted(right.columns) == cols
    at = [list(right.columns).index(c) for c in cols]
    assert rows([r[c] for c in cols] for r in df.collect()) == rows([r[i] for i in at] for r in right.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_scoring_plan_has_no_python(spark, tiny):
    plan = score_queries.rescore_all(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
