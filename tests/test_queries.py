"""Every registered query against its reference SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tallyspark.plans import catalog
from tests.compare import connect, difference

QUERIES = catalog.all_queries()
SQL = catalog.all_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    mine = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(mine, con.execute(SQL[name]).df()) is None
    assert len(mine) > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry_has_winners(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 47
    assert {r["contest"] for r in rows if r["winner"]} == {"Mayor", "Council", "Measure"}
