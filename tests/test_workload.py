"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from check_oracles import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, name):
    good, told = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert good, told


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["doi", "tag", "similarity"] and df.count() > 0
