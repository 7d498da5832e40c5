"""Every registered query that has SQL gives the same rows as the SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    _, _, wrong = compare(spark, con, name, queries()[name], oracle_sql()[name], FOLDER)
    assert wrong is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["label", "n", "edit_density", "dissimilarity"] and df.count() == 3
