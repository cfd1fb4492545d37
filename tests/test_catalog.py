"""Every registered query against DuckDB, where SQL states its result."""

import duckdb
import pytest

from stratalex.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, db, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got)
        return
    want = db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    want, got = (x[order].sort_values(order, key=lambda c: c.astype(str)).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got)
    for c in order:
        assert (want[c].astype(str) == got[c].astype(str)).all(), c


def test_the_entry_runs(spark):
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalog.dedup_first(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    plan = catalog.knn_l2(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
