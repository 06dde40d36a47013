import importlib.util

import pytest

from leafmill import plans
from tests.helpers import SMALL, duck, rows


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, name):
    got, want = plans.QUERIES[name](spark, SMALL).toPandas(), duck().sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_other_queries_run(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert (importlib.util.find_spec("leafmill.llm") is not None) == ("pipeline" in e.queries())


def test_intervals_with_nulls_and_ties_equal_sql(spark, tmp_path):
    """Its SQL sorts twice by (a, b): on one thread, where equal rows keep their order."""
    con = duck()
    con.execute("set threads = 1")
    con.execute(f"""copy (SELECT * REPLACE (l_suppkey % 3 AS l_suppkey, CASE WHEN l_orderkey % 5 <> 0 THEN l_linenumber END AS l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_shipdate END AS l_shipdate)
      FROM lineitem WHERE l_partkey % 20 = 0 ORDER BY l_orderkey) to '{tmp_path}/lineitem.parquet'""")
    con.execute(f"create or replace view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert rows(plans.QUERIES["interval_merge"](spark, str(tmp_path)).toPandas()) == rows(con.sql(plans.ORACLES["interval_merge"]).df())
