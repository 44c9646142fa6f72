"""Every registered raster query against its SQL."""

from pathlib import Path

import pytest

from helpers import duck, rows
from rasterloom.oracles import ORACLE_SQL
from rasterloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return duck(SF)


def test_all_but_one_have_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"simplify_dp"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(ORACLE_SQL[name]).df())


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
