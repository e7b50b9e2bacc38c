"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()

# These need more messages than the smallest tables hold.
LARGER = {"w4_backlog_phases": "/root/testdata/sf0.01"}


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(spark, QUERIES[name], ORACLES[name], LARGER.get(name, sf_dir)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
