"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__
from tools.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("key", list(__spark_entry__.queries()))
def test_query(spark, db, key):
    assert differences(spark, db, key, SF) is None


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"category", "count", "weight"} == set(rows[0].asDict())
