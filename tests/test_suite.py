"""Every query of the library proper against its SQL, at the smallest size."""

import duckdb
import pytest

from quern.plans import suite

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def texts(rows):
    return [tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows]


def plain(rows):
    return sorted(texts(rows))


@pytest.mark.parametrize("name", suite.queries())
def test_query_equals_its_sql(spark, duck, small, name):
    df = suite.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = duck.sql(suite.oracle_sql()[name])
    assert sorted(want.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    got, rows = df.select(*[f"`{c}`" for c in columns]).collect(), want.project(picked).fetchall()
    if "ORDER BY" in suite.oracle_sql()[name].rsplit(")", 1)[-1] and name != "lookup_filtered_sorted":  # the order of the result itself
        assert texts(got) == texts(rows)
    assert plain(got) == plain(rows)


def test_orders_are_seen():
    assert sum("ORDER BY" in sql.rsplit(")", 1)[-1] for sql in suite.oracle_sql().values()) > 10


def test_plans_stay_in_the_jvm(spark, small):
    for name in ("flagship", "gb_multi", "lookup_first", "lsm_merge", "filter_not", "stats_equidepth_hist"):
        plan = suite.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "SortAggregate" not in plan, name


def test_topk_and_pruning(spark, small):
    plan = suite.flagship(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_linestatus:string>" in suite.session(spark, small).sql("gomail lineitem gremb bi l_linestatus sep l_quantity")._jdf.queryExecution().executedPlan().toString()
