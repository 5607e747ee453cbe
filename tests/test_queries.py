"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from sparkfen.plans import catalog
from tests.differential import compare

DIR = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(catalog.queries()[name], SQL[name], spark, DIR)


#: Those without SQL, which tests/test_values.py holds against plain computations.
VALUES = {"category_statistics", "fisher_enrichment", "kendall_distance_mic", "leaf_order", "louvain", "murmur3_fmh", "tests_with_p", "upgma"}


def test_every_query_has_a_counterpart():
    assert set(catalog.queries()) - set(SQL) == VALUES


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
