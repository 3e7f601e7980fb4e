"""Every catalog query gives the rows of its SQL."""

import duckdb
import pytest

from tidewheel.plans import catalog, catalog_jobs, catalog_stored  # noqa: F401

SF = "/root/testdata/sf0.001"
#: Queries that read a data source written in Python.
PYTHON = ("paged_posts", "resumed_posts")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(rows):
    return sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and ("Python" not in plan or name in PYTHON)
    columns = sorted(df.columns)
    got = _norm(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    out = duck.execute(catalog.SQL[name])
    place = [c[0] for c in out.description]
    assert sorted(place) == columns
    assert got == _norm(tuple(r[place.index(c)] for c in columns) for r in out.fetchall())


def test_plan_of_the_flagship(spark):
    plan = catalog.hot_list(spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert any("GreaterThanOrEqual(l_shipdate" in x and "LessThan(l_shipdate" in x for x in pushed) and any("GreaterThanOrEqual(o_totalprice" in x for x in pushed)
    assert "WindowGroupLimit" in plan and "Python" not in plan
