"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from tidegrid.plans.registry import all_queries, all_sql
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return duck(SF)


@pytest.mark.parametrize("name", list(all_sql()))
def test_query_matches_sql(spark, oracle, name):
    result, _ = compare(name, all_queries()[name](spark, SF), oracle, all_sql()[name])
    assert result == "ok"


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["county_name"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_sql()) <= set(entry.oracle_sql())
